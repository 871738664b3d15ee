"""Hard negatives against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicelake.llm import negatives as N


def plain(rows):
    own = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(c is not None and math.isfinite(c) for c in v):
            q = [math.floor(256 * float(c)) for c in v]
            own.append((i, q, int(math.fmod(label + 1, 10)) if i % 7 == 0 else label))
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(2**63)), 2**63 - 1)
    out = []
    for i, q, label in {(i, tuple(q), x) for i, q, x in own if i % 100 == 0}:
        every = sorted(((-score(q, r), j, x == label) for j, r, x in own if j != i))
        for s, j, _ in [x for x in every if x[2]][:5]:
            hits = [(n, -t) for t, n, same in every if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, rank, n, -s, t) for rank, (n, t) in enumerate(hits, 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, N.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("row_block, share", [(32_768, 24), (64, 3)])
def test_against_all_products(spark, row_block, share, monkeypatch):
    monkeypatch.setattr(N, "ROW_BLOCK", row_block)
    monkeypatch.setattr(N, "SHARE", share)
    rng = random.Random(2)
    common = [rng.uniform(-0.2, 0.4) for _ in range(20)]
    vector = lambda: [c + rng.gauss(0, 0.1) for c in common]
    rows = [(i, vector(), rng.randrange(3)) for i in range(500)]
    rows += [(1000 + i, common, i % 4) for i in range(200)]  # a third of all rows are copies: ties
    rows += [(100, vector(), 1), rows[100], rows[100], rows[7], (None, vector(), 1), (5000, None, 1), (5100, vector(), None), (5200, [0.1, None], 1), (5300, [float("nan")] * 20, 1), (5400, [float("inf")] * 20, 2), (5500, [], 1), (5600, [0.5, 0.5], 2), (-100, vector(), -1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({x: F.lit("clash") for x in ("anchor", "block", "q", "slot", "score", "nth", "asks")})
    got, want = found(df.repartition(3)), plain(rows)
    assert len(want) > 100 and got == want


def test_few_rows_and_vast_numbers(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert found(spark.createDataFrame([], schema)) == [] and found(spark.createDataFrame([(0, [1.0], 1)], schema)) == []
    rows = [(0, [2.0**22, 3.0], 1), (1, [2.0**20, 1.0], 1), (2, [2.0**21, 1.0], 2), (3, [2.0**20 + 2, 0.0], 3), (4, [2.0**60, 7.0], 1), (5, [2.0**20, 7.0], 2), (6, [1.0, 1.0], 4), (8, [2.0**19, 2.0], 3)]
    assert found(spark.createDataFrame(rows, schema)) == plain(rows) != []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-100, 100, (50, 32)).astype("f8"), rng.integers(-100, 100, (9, 32)).astype("f8")
    last = np.inf
    for s in N.LEVELS:
        (m, d), (a, b) = N.summaries(x, s), N.summaries(q, s)
        middle, width = s * a @ m.T, s * b @ d.T
        assert (np.abs(q @ x.T - middle) <= width + 1e-9).all() and width.mean() < last
        last = width.mean()
