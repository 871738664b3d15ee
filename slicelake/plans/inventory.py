"""Queries over slice headers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slicelake import fixtures as X
from slicelake.operators import inventory as I
from slicelake.plans.registry import query
from slicelake.plans.scalars import MR_SQL, NORMAL, PLANE  # noqa: F401

c = F.col
ORD = "so AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_uid ORDER BY z, sop_uid) - 1 AS INT) AS k FROM instances), gp AS (SELECT *, z - lag(z) OVER (PARTITION BY series_uid ORDER BY k) AS gap FROM so)"
SPC = ORD + ", sp AS (SELECT series_uid, count(*) AS n, CASE WHEN count(*) > 1 THEN quantile_cont(gap, 0.5) ELSE arg_min(slice_thickness, path) END AS dz FROM gp GROUP BY series_uid)"
GAPS = SPC + """, gq AS (SELECT series_uid, n, dz, count(*) FILTER (gap <= 1e-4) AS duplicates, count(*) FILTER (gap > 1.5 * dz) AS missing, coalesce(bool_or(abs(gap - dz) > greatest(0.05, dz * 0.02::DOUBLE)), false) AS strict_bad, coalesce(max(gap) - min(gap) > 0.05::DOUBLE * dz + 1e-3, false) AS advisory_bad FROM gp JOIN sp USING (series_uid) GROUP BY series_uid, n, dz)"""
FIRST = "first_row AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_uid ORDER BY path, sop_uid) AS rn FROM instances) WHERE rn = 1)"


@query("w01_slice_order", "instances", f"{ORD} SELECT sop_uid, series_uid, z, k FROM so")
def _(s, d):
    return I.slice_order(X.instances(s, d)).select("sop_uid", "series_uid", "z", "k")


@query("a03_slice_spacing", "instances", f"{SPC} SELECT * FROM sp")
def _(s, d):
    return I.slice_spacing(X.instances(s, d))


@query("w02_spacing_gaps", "instances", f"{GAPS} SELECT * FROM gq")
def _(s, d):
    return I.spacing_gaps(X.instances(s, d))


INV = f"""{GAPS}, {FIRST}, ag AS (SELECT series_uid, count(*) AS images, min(z) AS z_min, max(z) AS z_max, bool_or(number_of_frames > 1) AS multiframe, array_to_string(list_sort(list_distinct(list(folder))), ';') AS folders FROM instances GROUP BY series_uid),
inv AS (SELECT f.series_uid, study_uid, modality, series_number, n_rows, n_cols, row_sp, slice_thickness, CASE WHEN modality = 'CT' THEN rescale_slope END AS rescale_slope, CASE WHEN modality = 'PT' THEN units END AS units, CASE WHEN modality = 'PT' THEN decay_correction END AS decay_correction, CASE WHEN modality = 'PT' THEN patient_weight END AS patient_weight,
CASE WHEN modality = 'MR' THEN te END AS te, CASE WHEN modality = 'MR' THEN tr END AS tr, CASE WHEN modality = 'MR' THEN ti END AS ti, {PLANE} AS plane, images, z_min, z_max, multiframe, folders, z_max - z_min AS coverage_mm, dz, duplicates, missing, strict_bad, advisory_bad FROM first_row f JOIN ag USING (series_uid) JOIN gq USING (series_uid))"""


@query("a01_series_inventory", "instances", f"{INV} SELECT * FROM inv")
def _(s, d):
    return I.series_inventory(X.instances(s, d))


@query("a02_study_cards", "instances", """f AS (SELECT study_uid, list_distinct(list(folder)) AS fs, min(study_date) AS date, count(DISTINCT study_date) > 1 AS dates_differ, array_to_string(list_sort(list_distinct(list(modality))), ',') AS modalities, count(DISTINCT series_uid) AS series, count(*) AS images FROM instances GROUP BY study_uid),
g AS (SELECT study_uid, unnest(range(1, 6)) AS n, fs FROM f), h AS (SELECT study_uid, max(n) AS n FROM g WHERE len(list_distinct(list_transform(fs, lambda x : array_to_string(string_split(x, '/')[1:n], '/')))) = 1 AND n <= list_min(list_transform(fs, lambda x : len(string_split(x, '/')))) GROUP BY study_uid)
SELECT f.study_uid, array_to_string(string_split(fs[1], '/')[1:coalesce(n, 0)], '/') AS folder, date, dates_differ, modalities, series, images, true AS supported FROM f LEFT JOIN h USING (study_uid)""")
def _(s, d):
    return I.study_cards(X.instances(s, d))


@query("a04_distinct_dimensions", "instances", """SELECT series_uid, array_to_string(list_sort(list_distinct(list(sequence_name))), ',') AS sequences, coalesce(array_to_string(list_transform(list_sort(list_distinct(list(b_value))), lambda b : CAST(CAST(b AS INT) AS VARCHAR)), ','), '') AS b_values, count(DISTINCT {a: sequence_name, b: te, c: ti, d: b_value}) AS stacks FROM instances GROUP BY series_uid""")
def _(s, d):
    return I.distinct_dimensions(X.instances(s, d))


@query("a04_stack_split", "instances", "SELECT sop_uid, CAST(dense_rank() OVER (PARTITION BY series_uid ORDER BY sequence_name NULLS FIRST, te NULLS FIRST, ti NULLS FIRST, b_value NULLS FIRST) AS INT) AS stack FROM instances")
def _(s, d):
    return I.stack_split(X.instances(s, d)).select("sop_uid", "stack")


@query("a28_series_cards", "instances", f"""{GAPS}, {FIRST}, ag AS (SELECT series_uid, count(*) AS images, bool_or(number_of_frames > 1) AS multi, bool_and(iop IS NOT NULL) AS placed FROM instances GROUP BY series_uid)
SELECT series_uid, study_uid, modality, series_number, images, CASE WHEN NOT placed THEN 'unknown' WHEN advisory_bad OR NOT dz > 0 THEN 'irregular' ELSE 'regular' END AS geometry, NOT multi AND placed AS renderable FROM first_row JOIN ag USING (series_uid) JOIN gq USING (series_uid)""")
def _(s, d):
    return I.series_cards(X.instances(s, d))


def series_of(instances):
    """(study_uid, series_uid, modality, series_number) of each series."""
    return instances.groupBy("series_uid").agg(I.first_header("study_uid", "modality", "series_number", "frame_uid", "sequence_name", "tr", "te", "ti", F.array_join("image_type", "/").alias("image_types"))).select("series_uid", "header.*")


SER = FIRST + ", ser AS (SELECT series_uid, study_uid, modality, series_number, frame_uid, sequence_name, tr, te, ti, array_to_string(image_type, '/') AS image_types FROM first_row)"


@query("p01_select_series", "instances", f"""{SER}, rq AS (SELECT series_uid || '?' AS request, study_uid, CASE WHEN right(study_uid, 1) IN ('1', '2', '3') THEN series_uid WHEN right(study_uid, 1) = '4' THEN '99' ELSE series_number END AS wanted FROM ser),
n AS (SELECT study_uid, series_number AS wanted, count(DISTINCT series_uid) AS n, min(series_uid) AS b FROM ser GROUP BY ALL)
SELECT request, CASE WHEN a.series_uid IS NOT NULL THEN 'ok' WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, coalesce(a.series_uid, CASE WHEN n = 1 THEN b END) AS series_uid FROM rq LEFT JOIN ser a ON rq.study_uid = a.study_uid AND wanted = a.series_uid LEFT JOIN n ON rq.study_uid = n.study_uid AND rq.wanted = n.wanted""")
def _(s, d):
    series = series_of(X.instances(s, d))
    last = F.substring("study_uid", -1, 1)
    return I.select_series(series, series.select(F.concat("series_uid", F.lit("?")).alias("request"), "study_uid", F.when(last.isin("1", "2", "3"), c("series_uid")).when(last == "4", "99").otherwise(c("series_number")).alias("wanted")))


@query("p02_redact", "instances", "SELECT sop_uid, '<redacted>' AS accession, '<redacted>' AS patient_id, '<redacted>' AS institution FROM instances")
def _(s, d):
    return I.redact(X.instances(s, d)).select("sop_uid", "accession", "patient_id", "institution")


@query("p03_sample_slices", "instances", f"{SPC} SELECT sop_uid, k FROM so JOIN sp USING (series_uid) WHERE k % CASE WHEN dz > 0 THEN greatest(1, CAST(round_even(2.0 / dz, 0) AS INT)) ELSE 1 END = 0 AND z BETWEEN 2 AND 6")
def _(s, d):
    i = X.instances(s, d)
    return I.sample_slices(I.slice_order(i), I.slice_spacing(i), 2.0, 2.0, 6.0).select("sop_uid", "k")


@query("p06_supported_studies", "instances", "SELECT study_uid, bool_or(modality IN ('CT', 'PT')) AS supported FROM instances GROUP BY study_uid")
def _(s, d):
    return X.instances(s, d).groupBy("study_uid").agg(F.collect_set("modality").alias("m")).select("study_uid", F.arrays_overlap("m", F.array(F.lit("CT"), F.lit("PT"))).alias("supported"))


@query("p07_reject_reasons", "instances", """r AS (SELECT series_uid, unnest(list_value(CASE WHEN number_of_frames > 1 THEN 'multi-frame' END, CASE WHEN photometric NOT IN ('MONOCHROME1', 'MONOCHROME2') THEN 'colour' END, CASE WHEN iop IS NULL THEN 'geometry missing' END, CASE WHEN modality = 'CT' AND (rescale_slope IS NULL OR rescale_intercept IS NULL) THEN 'calibration missing' END)) AS reason FROM instances) SELECT DISTINCT series_uid, reason FROM r WHERE reason IS NOT NULL""")
def _(s, d):
    return I.reject_reasons(X.instances(s, d))


@query("j12_repeated_acquisitions", "instances", f"""{SER}, w AS (SELECT series_uid, first_value(series_uid) OVER o AS fu, first_value(series_number) OVER o AS repeat_of FROM (SELECT *, split_part(study_uid, '.', 3)::BIGINT % 50 AS g FROM ser) WINDOW o AS (PARTITION BY g, sequence_name, tr, te, ti, image_types ORDER BY TRY_CAST(series_number AS INT) IS NULL, TRY_CAST(series_number AS INT) NULLS FIRST, series_number, series_uid))
SELECT series_uid, repeat_of FROM w WHERE fu <> series_uid""")
def _(s, d):
    return I.repeated_acquisitions(series_of(X.instances(s, d)).withColumn("study_uid", F.split_part("study_uid", F.lit("."), F.lit(3)).cast("bigint") % 50))


@query("j17_shares_folder", "instances", """f AS (SELECT study_uid, min(folder) AS folder FROM instances GROUP BY study_uid), n AS (SELECT *, count(*) OVER (PARTITION BY folder) AS n FROM f) SELECT study_uid, folder, n > 1 AS shared FROM n""")
def _(s, d):
    f = X.instances(s, d).groupBy("study_uid").agg(F.min("folder").alias("folder"))
    return f.withColumn("shared", F.count("*").over(Window.partitionBy("folder")) > 1)


@query("o01_natural_series_order", "instances", f"{SER} SELECT series_uid, CAST(row_number() OVER (PARTITION BY study_uid ORDER BY TRY_CAST(series_number AS INT) IS NULL, TRY_CAST(series_number AS INT) NULLS FIRST, series_number, series_uid) AS INT) AS place FROM ser")
def _(s, d):
    return I.natural_series_order(series_of(X.instances(s, d))).select("series_uid", "place")


@query("o06_reading_order", "instances", "SELECT sop_uid, CAST(row_number() OVER (PARTITION BY series_uid ORDER BY z DESC, sop_uid) AS INT) AS place FROM instances")
def _(s, d):
    return X.instances(s, d).select("sop_uid", F.row_number().over(Window.partitionBy("series_uid").orderBy(c("z").desc(), "sop_uid")).alias("place"))


TILT = """h AS (SELECT *, row_number() OVER (PARTITION BY series_uid ORDER BY path, sop_uid) AS rn FROM instances WHERE iop IS NOT NULL), q AS (SELECT series_uid, iop AS o, row_sp AS rs, col_sp AS cs FROM h WHERE rn = 1),
n AS (SELECT *, list_value(o[2] * o[6] - o[3] * o[5], o[3] * o[4] - o[1] * o[6], o[1] * o[5] - o[2] * o[4]) AS n FROM q),
a AS (SELECT i.series_uid, sop_uid, iop, list_value(ipp_x, ipp_y, ipp_z) AS p, n, o, rs, cs, list_dot_product(list_value(ipp_x, ipp_y, ipp_z), n) AS z FROM instances i JOIN n USING (series_uid) WHERE iop IS NOT NULL),
f AS (SELECT *, first_value(p) OVER w AS p0, z - first_value(z) OVER w AS d, z - lag(z) OVER w AS gap, len(list_filter(list_zip(iop, o), lambda t : abs(t[1] - t[2]) > 1e-4)) > 0 AS turned FROM a WINDOW w AS (PARTITION BY series_uid ORDER BY z, sop_uid)),
r AS (SELECT *, p[1] - p0[1] - d * n[1] AS r1, p[2] - p0[2] - d * n[2] AS r2, p[3] - p0[3] - d * n[3] AS r3 FROM f),
s AS (SELECT series_uid, CASE WHEN sum(d * d) > 0 THEN sum(d * r1) / sum(d * d) ELSE 0 END AS s1, CASE WHEN sum(d * d) > 0 THEN sum(d * r2) / sum(d * d) ELSE 0 END AS s2, CASE WHEN sum(d * d) > 0 THEN sum(d * r3) / sum(d * d) ELSE 0 END AS s3, coalesce(quantile_cont(gap, 0.5), 0) AS dz, bool_or(turned) AS turned FROM r GROUP BY series_uid),
g AS (SELECT series_uid, any_value(o) AS o, any_value(rs) AS rs, any_value(cs) AS cs, s1, s2, s3, dz, s.turned, max(greatest(abs(r1), abs(r2), abs(r3))) AS off, max(greatest(abs(r1 - d * s1), abs(r2 - d * s2), abs(r3 - d * s3))) AS rest FROM r JOIN s USING (series_uid) GROUP BY series_uid, s1, s2, s3, dz, s.turned),
t AS (SELECT series_uid, o, rs, cs, dz, CASE WHEN off > 0.1::DOUBLE THEN s1 ELSE 0 END AS x, CASE WHEN off > 0.1::DOUBLE THEN s2 ELSE 0 END AS y, CASE WHEN off > 0.1::DOUBLE THEN s3 ELSE 0 END AS z, CASE WHEN turned THEN 'mixed' WHEN off <= 0.1::DOUBLE THEN 'straight' WHEN rest <= 0.1::DOUBLE THEN 'tilted' ELSE 'not a line' END AS status FROM g)
SELECT series_uid, round(x, 6) + 0.0::DOUBLE AS shear_x, round(y, 6) + 0.0::DOUBLE AS shear_y, round(z, 6) + 0.0::DOUBLE AS shear_z, round(degrees(atan(sqrt(x * x + y * y + z * z))), 6) AS tilt_deg, round((x * o[4] + y * o[5] + z * o[6]) * dz / rs, 6) + 0.0::DOUBLE AS row_drift, round((x * o[1] + y * o[2] + z * o[3]) * dz / cs, 6) + 0.0::DOUBLE AS col_drift, status FROM t"""


@query("v14_tilt_fit", "instances", TILT)
def _(s, d):
    rounded = {x: F.round(x, 6) + 0.0 for x in ("shear_x", "shear_y", "shear_z", "tilt_deg", "row_drift", "col_drift")}
    return I.tilt_fit(X.instances(s, d)).withColumns(rounded)


@query("s09_inventory_lines", "instances", f"""{INV} SELECT series_uid, '| ' || concat_ws(' | ', series_number, modality, CAST(images AS VARCHAR), plane, CASE modality WHEN 'CT' THEN 'slope ' || coalesce(CAST(CAST(rescale_slope AS INT) AS VARCHAR), '?') WHEN 'PT' THEN concat_ws(' ', units, decay_correction) ELSE 'TE ' || coalesce(CAST(CAST(te AS INT) AS VARCHAR), '?') END) || ' |' AS line FROM inv""")
def _(s, d):
    return I.inventory_lines(I.series_inventory(X.instances(s, d)))
