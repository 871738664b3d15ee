"""Matched slices, elements within sequences, report texts and audits on small tables."""

from pyspark.sql import functions as F

from slicelake import catalog
from slicelake.functions import locale
from slicelake.operators import deid as E
from slicelake.operators import relations as R


def test_slices_of_a_pair_match_by_their_origins(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "pre string, post string")
    slices = [("a", k, 0.0, 0.0, 3.0 * k, 3.0) for k in range(4)]
    slices += [("b", k, 0.9, 0.9, 3.0 * k + 0.4, 3.0) for k in range(4)]  # 1.33 mm off, within half a spacing
    slices += [("c", k, 0.0, 0.0, 3.0 * k + (1.6 if k == 3 else -0.2), 2.0) for k in range(4)]
    got = {(r.post, r.k): (r.kb, r.aligned) for r in R.match_slices(pairs, spark.createDataFrame(slices, "series_uid string, k int, x double, y double, z double, dz double")).collect()}
    assert {k: v for k, v in got.items() if k[0] == "b"} == {("b", k): (k, True) for k in range(4)}
    assert {k: v for k, v in got.items() if k[0] == "c"} == {("c", k): (None if k == 3 else k, False) for k in range(4)}


def test_fusion_positions_reach_over_all_that_a_pair_shares(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0, 6.0)], "a_uid string, b_uid string, lo double, hi double")
    slices = spark.createDataFrame([("a", k, float(k)) for k in range(8)] + [("b", k, 2.0 * k) for k in range(4)], "series_uid string, k int, z double")
    got = lambda *x: sorted((r.z, r.ka, r.kb) for r in R.fusion_positions(pairs, slices, *x).collect())
    assert got() == [(1.0, 1, 0), (2.0, 2, 1), (3.0, 3, 1), (4.0, 4, 2), (5.0, 5, 2), (6.0, 6, 3)]  # of two that are equally near the first
    assert got(2.0, 1.5, 5.0) == [(3.0, 3, 1), (5.0, 5, 2)]
    sf = "/root/testdata/sf0.001"
    whole = {(r.a_uid, r.b_uid): (r.hi, int(r.hi - r.lo) + 1) for r in catalog.QUERIES["j09_pair_modalities"](spark, sf).collect()}
    per = catalog.QUERIES["p12_fusion_positions"](spark, sf).groupBy("a_uid", "b_uid").agg(F.max("z").alias("top"), F.count("*").alias("n"))
    assert whole and {(r.a_uid, r.b_uid): (r.top, r.n) for r in per.collect()} == whole


def test_what_a_removed_sequence_holds_goes_too(spark):
    rows = [
        ("1", "", "00081110", "SQ", "", "kept below"), ("1", "00081110[0]", "00081155", "UI", "ReferencedSOPInstanceUID", "1.2"), ("1", "00081110[0]/0040A170[3]", "00080100", "SH", "CodeValue", "x"),
        ("1", "00081140[0]", "00081155", "UI", "ReferencedSOPInstanceUID", "1.2"), ("1", "00081140[0]/00191010[0]", "00080100", "SH", "CodeValue", "x"), ("1", "00081140[0]/0040A170[0]", "00080100", "SH", "CodeValue", "x"),
        ("1", None, "00280010", "US", "Rows", "5"),
    ]
    df = spark.createDataFrame(rows, "sop_uid string, path string, tag string, vr string, keyword string, value string").withColumns({x: F.lit(v) for x, v in (("creator", ""), ("patient_id", "P1"), ("patient_name", "A^B"), ("accession", "N1"))})
    got = {(r.path, r.tag): (r.outcome, r.new_value) for r in E.apply_profile(df, "key", -5).collect()}
    gone = ("removed_with_parent", None)
    assert got["", "00081110"] == ("removed", None) and got["00081110[0]", "00081155"] == gone and got["00081110[0]/0040A170[3]", "00080100"] == gone
    assert got["00081140[0]", "00081155"][0] == "uid" and got["00081140[0]", "00081155"][1].startswith("2.25.")
    assert got["00081140[0]/00191010[0]", "00080100"] == gone and got["00081140[0]/0040A170[0]", "00080100"] == ("kept", "x") and got["", "00280010"] == ("kept", "5")


def test_templates_are_filled_once(spark):
    df = spark.range(1).select(F.create_map(F.lit("text"), F.lit("a {unit} b"), F.lit("unit"), F.lit("mm")).alias("v"))
    row = df.select(locale.filled_in(F.lit("{text} in {unit}: {missing}"), F.col("v")).alias("x"), locale.date_in(F.lit("20260903"), F.lit("dd.MM.yyyy")).alias("d"), locale.date_in(F.lit("2026"), F.lit("dd.MM.yyyy")).alias("e")).first()
    assert row.x == "a {unit} b in mm: {missing}" and row.d == "03.09.2026" and row.e == "2026"
    assert all(len(v) == len(locale.DATES) and all(v) for v in locale.TEXTS.values())
    places = lambda t: sorted(__import__("re").findall(r"\{(\w+)\}", t))
    assert all(places(v[0]) == places(v[1]) for v in locale.TEXTS.values())


def test_audit_by_kind_and_disclosure(spark):
    own = spark.createDataFrame([(1, "a", "nodule", 10.0), (1, "b", "mass", 50.0), (1, "c", "nodule", 30.0), (1, "d", "mass", 5.0), (1, "e", "nodule", 5.0)], "patient int, site string, kind string, size double")
    truth = spark.createDataFrame([(1, "a", "nodule", 12.0), (1, "b", "mass", 60.0), (1, "c", "nodule", 33.0), (1, "d", "nodule", 5.0), (1, "f", "mass", 5.0)], "patient int, site string, kind string, size double")
    got = {r.site: r.status for r in R.audit_match(own, truth, spark.createDataFrame([(1, "b")], "patient int, site string")).collect()}
    assert got == {"a": "matched", "b": "matched (leaked)", "c": "partial", "d": "partial", "e": "overcalled", "f": "missed"}
