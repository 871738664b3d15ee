"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions.

Rows are cut into blocks by their ids, queries too, and each pair of a query block with a row block is one
group. Within it the components stand dimension by dimension (vertical layout): the products of one block
of dimensions are added for every surviving row at a time; the norms of what remains of query and row
bound what is still to come, and rows whose bound falls below the query's k-th best lower bound are
dropped before the next block.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicelake.scratch import written

QUERY_BLOCK, ROW_BLOCK, GROUPS, DIMENSIONS = 512, 8192, 32, 16


def quantised(vectors: DataFrame, scale: int = 256, *more: Column) -> DataFrame:
    """(vec_id, q array<double>, *more): floor(scale * x), x as double; a product too large for a double is its largest. Null ids, null vectors and vectors with a null, NaN or infinite component take no part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: _floor(v * float(scale))).alias("q"), *more)


def _floor(v: Column) -> Column:
    """The largest whole number that isn't above v, as a double: floor() gives longs, and doubles of 2**52 or more are whole."""
    most = sys.float_info.max
    return F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(F.least(F.greatest(v, F.lit(-most)), F.lit(most)))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Dimension by row; shorter vectors are filled with zeros, which add nothing to a product."""
    out = np.zeros((width, len(column)), dtype=np.float64)
    for i, v in enumerate(column):
        out[: len(v), i] = v
    return out


def bounded_top_k(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (column of ``queries``) its id, the ids of its k best rows and their scores; ties to the smaller id.

    Products of integers stay exact in doubles below 2**53; larger ones are added as Python integers, and scores
    that no 64-bit integer holds are those nearest to them.
    """
    width, n = rows.shape
    if max(np.abs(queries).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * max(width, 1) >= 2**52:
        whole = np.vectorize(int, otypes=[object])
        queries, rows = (whole(x) if x.size else x.astype(object) for x in (queries, rows))
        for j, query in enumerate(query_ids.tolist()):
            scores = (queries[:, j : j + 1] * rows).sum(axis=0) if width else np.zeros(n, dtype=object)
            scores = np.array([min(max(x, -(2**63)), 2**63 - 1) for x in scores], dtype=object)
            best = sorted((i for i in range(n) if row_ids[i] != query), key=lambda i: (-scores[i], row_ids[i]))[:k]
            yield query, row_ids[best], scores[best]
        return
    steps = list(range(0, width, DIMENSIONS)) or [0]
    tail = lambda m: [np.sqrt((m[s:] ** 2).sum(axis=0)) for s in [*steps[1:], width]]  # noqa: E731  norms of what remains after each step
    row_tail, query_tail = tail(rows), tail(queries)
    first = queries[: steps[1] if len(steps) > 1 else width].T @ rows[: steps[1] if len(steps) > 1 else width]
    for j, query in enumerate(query_ids.tolist()):
        alive = np.flatnonzero(row_ids != query)
        score = first[j, alive]
        for step in range(len(steps)):
            if step:
                at = slice(steps[step], steps[step] + DIMENSIONS)
                score = score + queries[at, j] @ rows[at][:, alive]
            if len(alive) > k:
                rest = row_tail[step][alive] * query_tail[step][j] * (1 + 1e-9)
                least = np.partition(score - rest, len(alive) - k)[len(alive) - k]
                keep = score + rest >= least
                alive, score = alive[keep], score[keep]
        best = np.lexsort((row_ids[alive], -score))[:k]
        yield query, row_ids[alive][best], score[best]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row whose id is divisible by ``every``, itself left out.

    A query with fewer other rows has fewer; an empty table has none. Rows that repeat a vec_id are rows of
    their own, but none is a candidate for a query of its id.
    """
    rows = written(quantised(vectors, scale), "vectors")
    count, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    width = width or 0
    each = min(ROW_BLOCK, max(256, count // GROUPS))  # small tables are cut finer, so that all cores have a block
    row_blocks, query_blocks = max(1, -(-count // each)), max(1, -(-count // every // QUERY_BLOCK))
    asked = rows.where(F.col("vec_id") % every == 0)
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    lists = [
        rows.select(spread(row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"), F.lit(0).alias("asks"), "vec_id", "q"),
        asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("rb"), spread(query_blocks).alias("qb"), F.lit(1).alias("asks"), "vec_id", "q"),
    ]

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, own = pdf[pdf["asks"] == 1], pdf[pdf["asks"] == 0]
        ids = own["vec_id"].to_numpy()
        found = bounded_top_k(_matrix(asks["q"], width), asks["vec_id"].to_numpy(), _matrix(own["q"], width), ids, k) if len(own) else ()
        out = [(q, i, s) for q, best, scores in found for i, s in zip(best.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    near = lists[0].union(lists[1]).groupBy("rb", "qb").applyInPandas(block, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
