"""Components, distances, tilt and bricks against plain ones."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicelake.operators import dense as D
from slicelake.operators import inventory as I
from slicelake.operators import voxels as V


def plain_labels(places, conn):
    """The least number that each place reaches, by flooding."""
    number = {p: ((p[0] << 21) + p[1] << 21) + p[2] for p in places}
    steps, out = V.offsets(conn), {}
    for p in sorted(places):
        if p not in out:
            out[p], edge = number[p], [p]
            while edge:
                x = edge.pop()
                for o in steps:
                    q = tuple(a + b for a, b in zip(x, o, strict=True))
                    if q in number and q not in out:
                        out[q] = number[p]
                        edge.append(q)
    return out


@pytest.mark.parametrize("conn", [4, 8, 6, 18, 26])
def test_components(conn):
    rng = np.random.default_rng(conn)
    for share in (0.2, 0.5, 0.8):
        at = np.argwhere(rng.random((4, 9, 11)) < share)
        at = rng.permutation(np.concatenate([at, at[:5]]))  # some stand twice
        want = plain_labels({tuple(p) for p in at.tolist()}, conn)
        assert D.components(*at.T, conn).tolist() == [want[tuple(p)] for p in at.tolist()]
    assert len(D.components(*np.zeros((3, 0), "i4"), conn)) == 0


@pytest.mark.parametrize("spacing", [(1.0,), (2.0, 0.7), (2.5, 1.0, 0.4)])
def test_squared_distance(spacing):
    rng = np.random.default_rng(5)
    zeros = rng.random((9, 8, 7)[: len(spacing)]) < 0.04
    zeros.flat[3] = True
    at = np.argwhere(zeros) * spacing
    want = [((np.array(p) * spacing - at) ** 2).sum(axis=1).min() for p in np.ndindex(zeros.shape)]
    assert np.allclose(D.squared_distance(zeros, spacing).ravel(), want)
    assert np.isinf(D.squared_distance(zeros & False, spacing)).all()


@pytest.mark.parametrize("conn, slab", [(26, 8), (26, 1), (18, 2), (6, 3)])
def test_labels_meet_over_slabs(spark, conn, slab, monkeypatch):
    monkeypatch.setattr(V, "SLAB", slab)
    rng = np.random.default_rng(slab)
    rows = [(s, *p, float(i)) for s in (0, 1) for i, p in enumerate(np.argwhere(rng.random((9, 8, 8)) < 0.3).tolist())]
    mask = spark.createDataFrame(rows, "series int, k int, r int, c int, v double")
    got = V.connected_components(mask, conn, 2).collect()
    want = {}
    for s in (0, 1):
        found = plain_labels({x[1:4] for x in rows if x[0] == s}, conn)
        sizes = {x: list(found.values()).count(x) for x in set(found.values())}
        want |= {(s, *p): (x, sizes[x]) for p, x in found.items() if sizes[x] > 1}
    assert {(x.series, x.k, x.r, x.c): (x.component, x.size) for x in got} == want and len(got) == len(want)
    assert V.connected_components(mask.limit(0), conn).count() == 0


def test_lungs_of_large_slices(spark):
    """Two lungs of air with vessels in a body, 512 by 512: the filled lungs, and no air outside."""
    k, y, x = np.mgrid[0:3, 0:512, 0:512]
    body = ((y - 256) / 200) ** 2 + ((x - 256) / 240) ** 2 < 1
    lung = (((y - 256) / 120) ** 2 + ((np.abs(x - 256) - 110) / 80) ** 2) < 1
    vessel = ((y - 250) ** 2 + (np.abs(x - 256) - 100) ** 2) < 16
    v = np.where(lung & ~vessel, -800.0, np.where(body, 40.0, -1000.0))
    df = spark.createDataFrame([(0, [float(z) for z in p.ravel()], i) for i, p in enumerate(v)], "series int, image array<double>, k int")
    voxels = df.select("series", "k", F.posexplode("image").alias("at", "v")).select("series", "k", F.floor(F.col("at") / 512).cast("int").alias("r"), (F.col("at") % 512).cast("int").alias("c"), "v")
    got = V.lung_mask(voxels, 512, 512)
    assert got.count() == int(lung.sum()) and got.where("c < 256").count() == int(lung[:, :, :256].sum())


ORIENTATIONS = {"axial": [1, 0, 0, 0, 1, 0], "coronal": [1, 0, 0, 0, 0, -1], "sagittal": [0, 1, 0, 0, 0, -1], "oblique": [math.sqrt(0.5), math.sqrt(0.5), 0, 0, 0, -1]}


@pytest.mark.parametrize("name", ORIENTATIONS)
def test_tilt_by_the_normal(spark, name):
    """Stacks 2 mm apart: straight; sheared by 0.5 mm a mm along columns and by a quarter of it along rows; bent; turned."""
    iop = np.array(ORIENTATIONS[name], float)
    rows, cols = iop[:3], iop[3:]
    normal = np.cross(rows, cols)
    at = {
        "straight": lambda i: normal * 2 * i, "tilted": lambda i: normal * 2 * i + (0.5 * cols + 0.125 * rows) * 2 * i, "not a line": lambda i: normal * 2 * i + cols * (i % 3),
        "mixed": lambda i: normal * 2 * i, "alone": lambda i: normal,
    }
    data = [
        (s, f"{s}.{i}", f"{i:03}", *(100 + f(i)).tolist(), (iop[::-1] if s == "mixed" and i == 3 else iop).tolist(), 0.5, 0.25)
        for s, f in at.items() for i in range(1 if s == "alone" else 8)
    ]
    df = spark.createDataFrame([*data, ("none", "n", "0", 1.0, 1.0, 1.0, None, 1.0, 1.0)], "series_uid string, sop_uid string, path string, ipp_x double, ipp_y double, ipp_z double, iop array<double>, row_sp double, col_sp double")
    got = {r.series_uid: r for r in I.tilt_fit(df).collect()}
    assert {s: r.status for s, r in got.items()} == {"straight": "straight", "tilted": "tilted", "not a line": "not a line", "mixed": "mixed", "alone": "straight"}
    t = got["tilted"]
    assert t.tilt_deg == pytest.approx(math.degrees(math.atan(math.hypot(0.5, 0.125)))) and [t.shear_x, t.shear_y, t.shear_z] == pytest.approx((0.5 * cols + 0.125 * rows).tolist())
    assert t.row_drift == pytest.approx(0.5 * 2 / 0.5) and t.col_drift == pytest.approx(0.125 * 2 / 0.25)
    assert got["straight"].tilt_deg == 0 and got["straight"].row_drift == 0


def test_grown_regions_and_seed_status(spark):
    rng = np.random.default_rng(7)
    at = list(itertools.product(range(3), range(9), range(9)))
    v = {p: float(rng.integers(0, 100)) for p in at}
    voxels = spark.createDataFrame([(0, *p, x) for p, x in v.items()], "series int, k int, r int, c int, v double")
    seeds = spark.createDataFrame([(i, 0, *p) for i, p in enumerate([(1, 4, 4), (0, 0, 0), (2, 8, 8), (1, 3, 9)])], "seed long, series int, sk int, sr int, sc int")
    want = set()
    for i, seed in enumerate([(1, 4, 4), (0, 0, 0), (2, 8, 8)]):
        ball = {p for p in at if 40 < v[p] < 200 and sum((s * (a - b)) ** 2 for s, a, b in zip((2, 1, 1), p, seed, strict=True)) <= 16}
        found = plain_labels(ball, 26)
        want |= {(i, *p) for p in ball if seed in found and found[p] == found[seed]}
    got = V.grow_region(seeds, voxels, 40, 200, 4.0, 26, (2.0, 1.0, 1.0)).collect()
    assert {(x.seed, x.k, x.r, x.c) for x in got} == want
    status = {x.seed: x.status for x in V.seed_status(seeds, voxels, 40, 200).collect()}
    assert status[3] == "outside the image" and all(status[i] == ("grown" if 40 < v[p] < 200 else "outside the band") for i, p in enumerate([(1, 4, 4), (0, 0, 0), (2, 8, 8)]))


def test_exact_quantiles(spark):
    from slicelake.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(3)
    groups = {"float": rng.normal(size=1001) * 1e-3, "whole": rng.integers(-5, 5, 500).astype(float), "equal": np.full(300, -7.25), "one": np.array([3.0]), "far": np.array([-1e300, 1e300, 0.0, -0.0, 5e-324, -5e-324])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("float", None), ("float", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = {"a": 0.0, "b": 0.02, "m": 0.5, "z": 0.995}
    got = {r.g: r for r in exact_quantiles(df.repartition(4), ("g",), "x", shares).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert [got[g][n] for n in shares] == pytest.approx(np.quantile(v, list(shares.values())).tolist(), rel=1e-12), g
    assert exact_quantiles(df.limit(0), ("g",), "x", shares).count() == 0


@pytest.mark.parametrize("spacing", [(1.0, 1.0, 1.0), (2.0, 0.7, 0.9)])
def test_opening_scaled_to_the_lesion(spacing):
    """A ball with a thin tendril, against distances of all pairs."""
    from slicelake.operators.features import opened_lesion

    at = np.indices((24, 40, 40))
    ball = sum(((x - y) * s) ** 2 for x, y, s in zip(at, (12, 14, 14), spacing, strict=True)) <= 7**2
    mask = ball | ((at[0] == 12) & (at[1] == 14) & (at[2] >= 14) & (at[2] < 34))
    got = opened_lesion(mask, (12, 14, 14), spacing)
    calibre = float(np.clip(0.12 * 2 * (3 * mask.sum() * np.prod(spacing) / (4 * np.pi)) ** (1 / 3), 1, 3))
    inside, outside = np.argwhere(mask), np.argwhere(~mask)
    near = lambda a, b: np.array([np.sqrt((((b - p) * spacing) ** 2).sum(axis=1).min()) for p in a])
    core = inside[near(inside, outside) >= calibre]
    wide = np.argwhere(np.ones_like(mask))
    wide = wide[near(wide, core) <= calibre]
    kept = inside[near(inside, wide) <= calibre + min(spacing)]  # the dilated core is one component here
    assert {tuple(p) for p in np.argwhere(got)} == {tuple(p) for p in kept} and got.sum() < mask.sum() and (ball & ~got).sum() == 0
    small = np.zeros((9, 9, 9), bool)
    small[4, 4, 3:6] = True
    assert (opened_lesion(small, (4, 4, 4), (1.0, 1.0, 1.0)) == small).all()


def test_longest_chord():
    from slicelake.operators.features import longest_chord

    rng = np.random.default_rng(2)
    for spacing in ((1.0, 1.0), (0.7, 0.9)):
        for share in (0.5, 0.8, 0.95):
            image = np.pad(rng.random((9, 10)) < share, 1)
            edge = [p for p in np.argwhere(image).tolist() if not all(image[p[0] + a, p[1] + b] for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
            best = None
            for (a, b), (e, f) in itertools.combinations(edge, 2):
                n = 4 * max(abs(e - a), abs(f - b))
                if all(image[round(a + (e - a) * i / n), round(b + (f - b) * i / n)] for i in range(n + 1)):
                    d = (-round(math.hypot((e - a) * spacing[0], (f - b) * spacing[1]), 6), a, b, e, f)
                    best = d if best is None else min(best, d)
            got = longest_chord(image, spacing)
            assert (got and (-got[0], *got[1:])) == (best and pytest.approx(best))
    assert longest_chord(np.pad(np.ones((1, 1), bool), 1), (1.0, 1.0)) is None


def test_summary_of_a_crescent(spark):
    """The focus lies in the mask though the centroid doesn't; the id says what the mask holds, in any order."""
    at = [(0, r, q) for r in range(11) for q in range(11) if 16 <= (r - 5) ** 2 + (q - 5) ** 2 <= 30 and q < 8]
    rows = [(s, *p, float(p[1])) for s in (1, 2) for p in at] + [(3, *p, 1.0) for p in at[1:]]
    got = {r.seed: r for r in V.lesion_summary(spark.createDataFrame(rows[::-1], "seed long, k int, r int, c int, v double").repartition(4), (2.0, 1.0, 1.0)).collect()}
    one = got[1]
    assert (one.focus_k, one.focus_r, one.focus_c) in at and (round(one.r_mm), round(one.c_mm)) not in {p[1:] for p in at}
    assert one.id == got[2].id != got[3].id and one.voxels == len(at) and one.craniocaudal_mm == 2.0
    assert one.heat_lo == pytest.approx(np.quantile([p[1] for p in at], 0.02))
