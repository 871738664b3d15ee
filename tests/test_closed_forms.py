"""Values that can be worked out by hand, and properties that hold whatever the data."""

import hashlib
import hmac
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicelake import scratch
from slicelake.functions import geometry as G
from slicelake.functions import keyed as K
from slicelake.functions import labels as L
from slicelake.functions import quantities as Q
from slicelake.graph import connected_components
from slicelake.operators import features as E
from slicelake.operators import voxels as V
from slicelake.streaming import attest as T

HALF, DOSE, WEIGHT = 6586.2, 300e6, 73.0


def pet(spark, **changed):
    row = {"total_dose": DOSE, "half_life": HALF, "rp_start_dt": "20260101100000", "rp_start_time": None, "series_date": "20260101", "patient_weight": WEIGHT, "units": "BQML", "decay_correction": "START", "activity_scale": None, "suv_scale": None, "start": "2026-01-01 11:00:00"} | changed
    kinds = "total_dose double, half_life double, rp_start_dt string, rp_start_time string, series_date string, patient_weight double, units string, decay_correction string, activity_scale double, suv_scale double, start string"
    df = spark.createDataFrame([row], kinds).withColumn("start", F.col("start").cast("timestamp_ntz"))
    return df.select(*[c.alias(n) for n, c in Q.suv_factor(F.col("start")).items()]).first()


@pytest.mark.parametrize(
    ("changed", "factor"),
    [({}, 73000 / (DOSE * 2 ** (-3600 / HALF))), ({"decay_correction": "ADMIN"}, 73000 / DOSE), ({"units": "CNTS", "activity_scale": 0.5}, 0.5 * 73000 / (DOSE * 2 ** (-3600 / HALF))), ({"units": "CNTS", "suv_scale": 0.0021}, 0.0021), ({"units": "GML"}, 1.0)],
)
def test_suv_factor(spark, changed, factor):
    out = pet(spark, **changed)
    assert out.error is None
    assert out.factor == pytest.approx(factor, rel=1e-12)


@pytest.mark.parametrize(
    ("changed", "error"),
    [({"start": "2026-01-01 09:00:00"}, "injection after scan start"), ({"patient_weight": None}, "weight missing"), ({"patient_weight": 10.0}, "implausible weight"), ({"units": "PROPCPS"}, "units not supported"), ({"decay_correction": "NONE"}, "decay correction not supported"), ({"half_life": 0.0}, "invalid dose or half-life"), ({"total_dose": None}, "no radiopharmaceutical")],
)
def test_suv_errors(spark, changed, error):
    out = pet(spark, **changed)
    assert (out.error, out.factor) == (error, None)


def test_lean_mass_and_diameters(spark):
    row = spark.range(1).select(Q.lean_body_mass(F.lit(80.0), F.lit(1.8), F.lit("M")).alias("m"), *[Q.reported_diameter(F.lit(8.0), F.lit(6.0), F.lit(a), F.lit(b))[0].alias(f"d{i}") for i, (a, b) in enumerate([("recist", "node"), ("fleischner", "nodule"), ("recist", "nodule")])], Q.reported_diameter(F.lit(14.0), F.lit(12.0), F.lit("fleischner"), F.lit("nodule"))[0].alias("large")).first()
    assert row.m == pytest.approx(9270 * 80 / (6680 + 216 * 80 / 1.8**2))
    assert (row.d0, row.d1, row.d2, row.large) == (6, 7, 8, 14)


def test_geometry(spark):
    cells = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0)])
    p = G.patient_point([F.lit(1.0), F.lit(2.0), F.lit(3.0)], cells, F.lit(2.0), F.lit(1.0), F.lit(4), F.lit(3))
    row = spark.range(1).select(*[v.alias(n) for v, n in zip(p, "xyz", strict=True)], G.plane_of(cells).alias("plane"), G.direction_label(F.lit(0.2), F.lit(-0.9), F.lit(0.05)).alias("label")).first()
    assert (row.x, row.y, row.z, row.plane, row.label) == (4, 10, 3, "AX", "AL")


def test_keyed_digest_is_hmac(spark):
    for key in ("k", "k" * 100):
        got = spark.range(1).select(K.hmac_sha256(key, F.lit("väl")).alias("h")).first().h
        assert got == hmac.new(key.encode(), "väl".encode(), hashlib.sha256).hexdigest()
    uid = spark.range(1).select(K.pseudo_uid("k", F.lit("1.2")).alias("u")).first().u
    assert uid == "2.25." + str(int(hmac.new(b"k", b"1.2", hashlib.sha256).hexdigest()[:32], 16))


def test_decimals_of_128_bits(spark):
    rng = random.Random(2)
    numbers = [0, 1, 10**10 - 1, 10**10, 2**64 - 1, 2**64, 10**38, 2**128 - 1, *(rng.getrandbits(rng.randint(1, 128)) for _ in range(200))]
    rows = spark.createDataFrame([(f"{n:032x}", str(n)) for n in numbers], "h string, want string")
    assert rows.select(K.decimal_of_hex(F.col("h")).alias("got"), "want").where("got <> want or got is null").collect() == []


def test_labels_of_texts(spark):
    one = spark.range(1)
    tissue = lambda *x: one.select(L.expected_tissue(*map(F.lit, x)).alias("t")).first().t
    assert tissue("sağda kitle", "bül komşuluğunda kitle").label == "yumuşak doku"  # the headline decides
    assert tissue("sağ üst lob", "BÜL komşuluğunda").label == "hava"
    assert tissue("sağ üst lob", "değişmedi") is None
    place = lambda x: one.select(L.classify_blocker(F.lit(x)).alias("p")).first().p
    assert place("Series 4: read series has no pages") == "series" and place("Series 4 5: read series has no pages") is None
    assert place("lung, right: source references missing") == "region" and place("C1: measurement output changed") == "claim"
    assert place("C1: invalid timepoint") == "comparison" and place("Record model/reader") == "session" and place("page") is None
    assert place("page marked reviewed without a view attestation: a.png (S1)") == "pages"
    guess = lambda **x: one.select(L.mr_guess(*[F.lit(x.get(n)).cast(t) for n, t in (("image_type", "array<string>"), ("scanning", "array<string>"), ("te", "double"), ("tr", "double"), ("ti", "double"), ("name", "string"), ("thickness", "double"), ("contrast", "string"), ("protocol", "string"))]).alias("g")).first().g
    assert guess(image_type=["original", "diffusion"], name="", protocol="EP_b1000") == "DWI trace b=1000"
    assert guess(scanning=["SE"], te=20.0, tr=0.0) == "unclassified"  # no repetition time
    assert guess(scanning=["SE"], te=20.0, tr=500.0, contrast="") == "T1 SE"
    assert guess(ti=1800.0, te=90.0, thickness=0.0) == "T2 FLAIR" and guess(ti=1800.0, te=90.0, thickness=1.0) == "T2 FLAIR 3D"


def test_grid(spark):
    g = L.fit_grid(F.lit(512), F.lit(512), F.lit("auto"), F.lit(1568))
    row = spark.range(1).select(*[v.alias(k) for k, v in g.items()]).first()
    assert (row.cols, row.rows, row.status) == (3, 3, "ok")


def test_components_of_a_shuffled_chain(spark, monkeypatch):
    rng, steps, plain = random.Random(1), [], scratch.Tables.written
    monkeypatch.setattr(scratch.Tables, "written", lambda self, df, name="part": steps.append(name) or plain(self, df, name))
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(10_000)]
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (ids[0], ids[0]), (None, ids[5])], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == dict.fromkeys(ids, min(ids))
    assert steps.count("step") < 20


def test_components_of_stars_cliques_and_nothing(spark):
    edges = [(10 * i, 10 * i + k) for i in range(20) for k in range(1, 5)] + [(1000 + i, 1000 + j) for i in range(8) for j in range(i)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {10 * i + k: 10 * i for i in range(20) for k in range(5)} | {1000 + i: 1000 for i in range(8)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mean_of_a_region_is_the_same_in_any_order(spark):
    # their sum is the halfway case -86.6667 / 20; added from the least up, it comes out nearer to zero
    v = [440.0, -240.0, -320.0, 440.0, -120.0, -960.0, -440.0, -80.0, 660.0, 760.0, -240.0, -560.0, -546.6667, -760.0, 960.0, 40.0, 280.0, 280.0, -200.0, 520.0]
    rng = random.Random(3)
    orders = [v, sorted(v), sorted(v, reverse=True), *(rng.sample(v, len(v)) for _ in range(5))]
    wide = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-6, 6) for _ in range(500)]
    groups = {f"o{i}": x for i, x in enumerate(orders)} | {"wide": wide, "back": wide[::-1], "third": [0.1] * 10, "none": [None], "some": [None, 0.5, None], "vast": [1e300, 1.0], "inf": [float("inf"), 1.5], "nan": [float("nan"), 1.5]}
    rows = spark.createDataFrame([(g, x) for g, vs in groups.items() for x in vs], "roi string, v double").coalesce(1)
    got = {r.roi: r.mean for r in V.roi_stats(rows).collect()}
    assert {got[f"o{i}"] for i in range(len(orders))} == {math.fsum(v) / len(v)} == {-4.333335}
    assert got["wide"] == got["back"] == math.fsum(wide) / len(wide) and got["third"] == 0.1
    assert (got["none"], got["some"], got["vast"], got["inf"]) == (None, 0.5, 5e299, float("inf")) and math.isnan(got["nan"])


def volume(spark, a: np.ndarray):
    k, r, c = np.indices(a.shape).reshape(3, -1)
    return spark.createDataFrame([(0, int(x), int(y), int(z), float(v)) for x, y, z, v in zip(k, r, c, a.ravel(), strict=True)], "series int, k int, r int, c int, v double")


def phantom() -> np.ndarray:
    z, y, x = np.indices((20, 24, 40))
    a = np.full(z.shape, -800.0)
    a[(z - 10) ** 2 + (y - 12) ** 2 + (x - 10) ** 2 <= 9] = -100
    a[(y - 12) ** 2 + (x - 30) ** 2 <= 9] = -100
    return a


def test_features_rank_a_sphere_over_a_cylinder_and_ignore_blocks(spark):
    df = volume(spark, phantom())
    order = ["k", "r", "c"]
    whole = E.hessian_features(df, (20, 24, 40), (2.0,), 200.0, block=64).toPandas().sort_values(order)
    parts = E.hessian_features(df, (20, 24, 40), (2.0,), 200.0, block=8).toPandas().sort_values(order)
    assert np.allclose(whole[["blob", "vessel"]], parts[["blob", "vessel"]], atol=1e-9)
    at = whole.set_index(order)
    assert at.loc[(10, 12, 10), "blob"] > 3 * at.loc[(10, 12, 30), "blob"]
    assert at.loc[(10, 12, 30), "vessel"] > at.loc[(10, 12, 10), "vessel"]


def plain_responses(a: np.ndarray, sigma: float, contrast: float) -> tuple[np.ndarray, np.ndarray]:
    """Blob and vessel of every voxel from sums over whole kernels in space and a general eigenvalue solver."""
    n = int(4 * sigma + 0.5)
    t = np.arange(-n, n + 1)
    g = np.exp(-(t**2) / (2 * sigma**2)) / np.exp(-(t**2) / (2 * sigma**2)).sum()
    d1, d2 = -t / sigma**2 * g, (t**2 / sigma**4 - 1 / sigma**2) * g
    d2 = d2 - d2.sum() * g
    wide = np.pad(a, n, mode="symmetric")
    cubes = np.lib.stride_tricks.sliding_window_view(wide, (2 * n + 1,) * 3)
    h = np.empty((*a.shape, 3, 3))
    for i in range(3):
        for j in range(3):
            w = [(g, d1, d2)[(x == i) + (x == j)] for x in range(3)]
            h[..., i, j] = np.einsum("abcxyz,x,y,z->abc", cubes, *w) * sigma**2
    e = np.linalg.eigvalsh(h)
    e = np.take_along_axis(e, np.abs(e).argsort(axis=-1), axis=-1)
    l1, l2, l3 = np.moveaxis(e, -1, 0)
    s = 1 - np.exp(-(l1**2 + l2**2 + l3**2) / (2 * contrast**2))
    with np.errstate(divide="ignore", invalid="ignore"):
        blob = np.where((e < -1e-6).all(axis=-1), np.abs(l1 * l2 / l3) * s, 0)
        vessel = np.where((e[..., 1:] < -1e-6).all(axis=-1), (1 - np.exp(-2 * (l2 / l3) ** 2)) * np.exp(-2 * l1**2 / np.abs(l2 * l3)) * s, 0)
    return blob, vessel


def test_features_against_whole_kernels(spark):
    a = np.random.default_rng(3).normal(-500, 200, (6, 9, 11))
    scales = (1.0, 1.5)
    got = E.hessian_features(volume(spark, a), a.shape, scales, 50.0, block=4).toPandas().sort_values(["k", "r", "c"])
    blobs, vessels = (np.stack(x) for x in zip(*(plain_responses(a, s, 50.0) for s in scales), strict=True))
    best = blobs.max(axis=0)
    assert np.allclose(got["blob"], (best / best.max()).ravel(), atol=1e-6)
    assert np.allclose(got["vessel"], vessels.max(axis=0).ravel(), atol=1e-6)
    assert (got["scale"].to_numpy() == np.where(best > 0, np.array(scales)[blobs.argmax(axis=0)], 0).ravel()).all()


def test_candidates_of_a_sphere_say_where_it_lies(spark):
    df = volume(spark, phantom())
    inside = df.where("not (k < 4)")
    features = E.hessian_features(df, (20, 24, 40), block=16, mask=inside)
    assert features.count() == inside.count()
    slices = spark.createDataFrame([(0, k, f"1.{k}", 2.0, 0.5, 0.8, -50.0, 1.0, 2.0) for k in range(10)], "series int, k int, sop_uid string, dz double, dy double, dx double, z0 double, y0 double, x0 double")
    row = E.candidate_passport(features, slices).orderBy("place").first()
    assert (row.id, row.k, row.r, row.c, row.score, row.sop_uid, row.near_k) == ("N01", 10, 12, 10, 1.0, "1.5", 5)
    assert (row.z, row.y, row.x, row.source_k, row.source_r, row.source_c) == (-40.0, 13.0, 12.0, 5.0, 24.0, 12.5)
    assert row.scale in E.SCALES and 4 <= row.diameter_mm <= 9


def test_suppression_is_greedy_and_bounded(spark):
    rows = [(0, 0, 0, i, float(100 - i)) for i in range(50)]
    got = E.suppress_neighbours(spark.createDataFrame(rows, "series int, k int, r int, c int, v double"), 4).toPandas().sort_values("place")
    assert got["c"].tolist() == [0, 3, 6, 9]


def test_morphology(spark):
    block = spark.createDataFrame([(0, 0, r, c) for r in range(3, 8) for c in range(3, 8)], "series int, k int, r int, c int")
    cross = V.offsets(4)
    assert V.erode(block, cross).count() == 9
    assert V.opened(block, cross).count() == 21
    ring = block.where("not (r = 5 and c = 5)")
    assert V.fill_holes(ring, 12, 12).count() == 25
    assert V.boundary(block).count() == 16


def test_lesion_drafts_and_lung(spark):
    a = np.full((6, 20, 20), -1000.0)
    a[:, 2:18, 2:18] = 40.0
    a[1:5, 5:9, 5:9] = -800.0
    a[1:5, 11:15, 11:15] = -800.0
    df = volume(spark, a)
    assert V.lung_mask(df, 20, 20).count() == 2 * 4 * 16  # the opening takes the corners of each square, what was there before gives them back
    a[2, 6, 6] = 40.0  # a nodule within
    a[4, 17, 4] = -1000.0
    a[5, 6:8, 6:8] = -350.0
    smaller = {tuple(r) for r in V.lung_mask(volume(spark, a), 20, 20).select("k", "r", "c").collect()}
    assert smaller == {(k, r, q) for k in range(1, 5) for r in (*range(5, 9), *range(11, 15)) for q in range(5 if r < 9 else 11, 9 if r < 9 else 15)} | {(5, r, q) for r in (6, 7) for q in (6, 7)}
    seeds = spark.createDataFrame([(1, 0, 3, 6, 6)], "seed int, series int, sk int, sr int, sc int")
    row = E.threshold_lesions(seeds, df, 3.0, (1.0, 1.0, 1.0)).first()
    assert row.voxels > 10 and row["mean"] == -800 and row.status == "needs-review"


def test_series_of_any_number_stay_apart(spark):
    """300 series, with numbers that differ by powers of two, each with a ring about one voxel and, in every other one, a gap in it."""
    ids = [0, 256, 1 << 14, 1 << 22, (1 << 31) - 1, *range(1, 256), *range(257, 297)]
    ring = [(r, q) for r in range(2, 5) for q in range(2, 5) if (r, q) != (3, 3)]
    mask = spark.createDataFrame([(s, 0, r, q) for i, s in enumerate(ids) for r, q in ring if not (i % 2 and (r, q) == (2, 3))], "series int, k int, r int, c int")
    whole = {s for i, s in enumerate(ids) if i % 2 == 0}
    filled = V.fill_holes(mask, 8, 8).join(mask, list(V.KEY), "left_anti")
    assert {tuple(r) for r in filled.collect()} == {(s, 0, 3, 3) for s in whole}
    sizes = V.connected_components(mask, 4).select("series", "size").distinct().collect()
    assert {r.series: r["size"] for r in sizes} == {s: 8 if s in whole else 7 for s in ids} and len(sizes) == len(ids)
    volume_ = V.full_grid(mask, 8, 8).join(mask.withColumn("in", F.lit(True)), list(V.KEY), "left").select(*V.KEY, F.when(F.col("in"), 40.0).otherwise(-1000.0).alias("v"))
    assert {(r.series, r.fraction) for r in V.aerated_fraction(volume_, 8, 8).collect()} == {(s, 1 / 64 if s in whole else 0.0) for s in ids}
    assert {tuple(r) for r in V.lung_mask(volume_, 8, 8).collect()} == {(s, 0, 3, 3) for s in whole}
    seeds = mask.where("r = 4 and c = 4").select((F.col("series").cast("long") * 1000).alias("seed"), "series", F.lit(0).alias("sk"), F.lit(4).alias("sr"), F.lit(4).alias("sc"))
    grown = V.grow_region(seeds, volume_, 0, 100, 9.0, 4, (1.0, 1.0, 1.0)).groupBy("seed").count().collect()
    assert {r.seed: r["count"] for r in grown} == {s * 1000: 8 if s in whole else 7 for s in ids}


def test_row_runs_round_trip(spark):
    mask = spark.createDataFrame([(0, 0, 1, c) for c in (1, 2, 3, 7, 9, 10)], "series int, k int, r int, c int")
    runs = V.row_runs(mask)
    assert sorted((x.c0, x.c1) for x in runs.collect()) == [(1, 3), (7, 7), (9, 10)]
    assert sorted(V.unpack_runs(runs).collect()) == sorted(mask.collect())


def test_tilt_of_a_known_shear():
    assert math.degrees(math.atan(0.5)) == pytest.approx(26.565, abs=1e-3)


def events(spark):
    rows = [(i, f"2026-01-01 10:00:{i:02d}", "r1", "s", "x" if i < 3 else "y", 500.0 + i, 1.0 + i / 10, i != 4, True, "viewer", None) for i in range(8)]
    kinds = "event_id long, ts string, reader string, session_id string, sop_uid string, dwell_ms double, scale double, focused boolean, visible boolean, source string, page_path string"
    return spark.createDataFrame(rows, kinds).withColumn("ts", F.col("ts").cast("timestamp"))


def test_streams_give_what_tables_give(spark, tmp_path):
    table = events(spark)
    source = f"file://{tmp_path}/events"
    table.repartition(1).write.parquet(source)
    stream = T.event_stream(spark, source, table.schema)
    T.attest_stream(stream, f"file://{tmp_path}/ok", f"file://{tmp_path}/no", f"file://{tmp_path}/offsets").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/ok").count() == T.accepted(table).count() == 7
    assert spark.read.parquet(f"file://{tmp_path}/no").count() == 1
    # the last segment is still open when the stream's input ends
    out = T.segment_stream(T.event_stream(spark, source, table.schema)).writeStream.format("memory").queryName("segments").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    closed = {(r.sop_uid, r.n, r.dwell_ms) for r in spark.table("segments").collect()}
    batch = {(r.sop_uid, r.n, r.dwell_ms) for r in T.dwell_segments(table).collect()}
    assert closed <= batch and len(batch) - len(closed) == 1


def test_reporting_once_and_reading_sessions_on_streams(spark, tmp_path):
    table = events(spark)
    source = f"file://{tmp_path}/events"
    table.repartition(1).write.parquet(source)
    out = T.dedup_reported(T.event_stream(spark, source, table.schema)).writeStream.format("memory").queryName("once").option("checkpointLocation", f"file://{tmp_path}/a").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("once").count() == T.dedup_reported(table).count() == 2
