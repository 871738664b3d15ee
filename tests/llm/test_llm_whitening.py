"""Whitening against dense eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicelake.llm import queries
from slicelake.llm import whitening as W


def dense(rows, components=16):
    """{vec_id: (deviation, whitened)}, explained, n: by the eigenvectors of the covariance."""
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array([[n * c - t for c, t in zip(v, s, strict=True)] for v in fit], "f8") / n
    value, vector = np.linalg.eigh(a.T @ a / n)
    order = np.argsort(-value)[:components]
    out = {}
    for i, v in x.items():
        own = [n * c - t for c, t in zip(v, s, strict=True)]
        out[i] = sum(c * c for c in own), np.array(own, "f8") / n @ vector[:, order] / np.sqrt(value[order])
    return out, value[order] / value.sum(), n


def check(got, rows, components=16):
    want, explained, n = dense(rows, components)
    k = len(explained)
    assert len(got) == k * len(rows) and (got["n"] == n).all() and (got["identity_error"] < 1e-6).all() and got["identity_error"].nunique() == 1
    table = got.sort_values(["vec_id", "component"])
    ids = table["vec_id"].to_numpy().reshape(-1, k)[:, 0]
    assert table["component"].tolist() == list(range(1, k + 1)) * len(ids)
    assert table["deviation"].to_numpy().reshape(-1, k)[:, 0].tolist() == [want[i][0] for i in ids]
    assert np.allclose(table["explained"].to_numpy().reshape(-1, k), explained, rtol=1e-9)
    own, other = table["whitened"].to_numpy().reshape(-1, k), np.array([want[i][1] for i in ids])
    sign = np.sign((own * other).sum(axis=0))
    assert np.allclose(own * sign, other, rtol=1e-6, atol=1e-8)


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(queries.QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001").toPandas(), rows)


def test_badly_conditioned_rows_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * [3e4, 3e4, 1, 1, 0.05, 0.05]).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a vector that many rows have
    df = spark.createDataFrame([*rows, (1, None), (2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3, [float("nan")] * 6), (4, [float("inf")] * 6)], "vec_id long, embedding array<double>").withColumns({x: F.lit("clash") for x in ("x", "n", "component", "label")})
    got = W.whitened(df.repartition(5)).toPandas()
    check(got, rows)


@pytest.mark.parametrize("rows, components", [([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (None, [0.0, 3.0])], 1), ([(0, [1.0, 2.0])], 0), ([(0, [0.5, 1.0]), (1, [])], 1), ([(0, []), (1, [])], 0), ([], 0)])
def test_few_equal_ragged_and_no_rows(spark, rows, components):
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == components * len(rows) and set(got["component"]) <= {1} and np.isfinite(got["whitened"]).all()


def test_vast_numbers(spark):
    rows = [(i, [float(v)]) for i, v in enumerate((1e300, -1e300, 2.0**40, 0.0))]
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    x = [2**53 + 10**6, -(2**53) + 10**6, 2**46 + 10**6, 10**6]
    want = {i: min((4 * v - sum(x)) ** 2, 2**63 - 1) for i, v in enumerate(x)}
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == want and np.isclose((got["whitened"] ** 2).mean(), 1)


def test_triangular_solve():
    rng = np.random.default_rng(1)
    a, r = rng.normal(size=(50, 7)), np.triu(rng.normal(size=(7, 7))) + 4 * np.eye(7)
    assert np.allclose(W.solved(a, r) @ r, a)
