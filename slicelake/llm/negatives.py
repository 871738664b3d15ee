"""Hard negatives by segment summaries.

Vectors are cut into segments; of each a mean and a deviation are kept. Over a segment of m components the product of two
vectors is m (mean mean' + r dev dev') with r between -1 and 1, so means' products, plus or minus the deviations',
bound a score from both sides. An anchor meets a block of rows with bounds over long segments; rows that can't lie in any of
its windows, or can't be among the best of one, go; for the rest each segment is cut into shorter ones, which bound
closer; what is left is scored exactly.

Rows stay in blocks and anchors come to them. A first pass over a share of the blocks gives each anchor the score that its
k-th best row reaches there; the second, over all blocks, drops what lies below. So a block gives few rows,
and no row is lost: the k best of all lie at or above the k-th best of a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicelake.llm.blocks import block_of, met, numbered
from slicelake.llm.search import quantised
from slicelake.scratch import written

#: Rows in a block at most, and blocks at least, so that small tables use all cores too.
ROW_BLOCK, BLOCKS = 32_768, 24
#: One block in so many is read for the first, lower bound of the k-th best.
SHARE = 24
#: Components in a segment, coarse to fine.
LEVELS = (16, 4)
#: Anchors whose bounds are computed at a time.
TOGETHER = 32
FOUND = "anchor long, slot int, vec_id long, score long"


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A row for each vector; shorter ones are filled with zeros, which add nothing to a product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width))
    size = np.diff(column.offsets.to_numpy())
    out[np.arange(width)[None] < size[:, None]] = column.flatten().to_numpy()
    return out


def summaries(x: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment."""
    parts = x.reshape(len(x), -1, segment)
    return parts.mean(axis=2), parts.std(axis=2)


class Block:
    """Rows of one block and what bounds their scores."""

    def __init__(self, table: pa.Table, width: int, most: float):
        self.width = -(-max(width, 1) // LEVELS[0]) * LEVELS[0]
        self.x = matrix(table.column("q"), self.width)
        self.ids, self.labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        self.exact = most * most * self.width < 2**52  # products and their sums are whole numbers in doubles
        self.slack = 0.5 + 1e-12 * most * most * self.width
        self.levels = [np.hstack(summaries(self.x, s)) for s in LEVELS] if self.exact else []

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each level the factors of lower and upper bounds, to be multiplied with its summaries."""
        out = []
        for s in LEVELS:
            mean, dev = summaries(q, s)
            out.append((np.hstack([mean, -dev]) * s, np.hstack([mean, dev]) * s))
        return out

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact:
            return self.x[rows] @ q
        whole = [int(v) for v in q.tolist()]
        return np.array([sum(a * int(b) for a, b in zip(whole, x, strict=True)) for x in self.x[rows].tolist()], dtype=object)

    def best(self, batch: pa.RecordBatch, k: int, same: bool, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        """(anchor, slot, vec_id, score): for each anchor and slot the k best rows at most, of the anchor's label or of others, in the slot's window and not below its floor."""
        q, ids, labels, anchors, slots = matrix(batch.column("q"), self.width), batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("anchor").to_pylist(), batch.column("slots").to_pylist()
        factors = self.bounds(q) if self.exact else []
        for at in range(0, len(q), TOGETHER):
            own = slice(at, at + TOGETHER)
            first = [f[own] @ self.levels[0].T for f in factors[0]] if self.exact else None
            for i in range(at, min(at + TOGETHER, len(q))):
                rows = np.flatnonzero(((self.labels == labels[i]) == same) & (self.ids != ids[i]))
                windows = [Slot(s, low, high) for s in slots[i]]
                for level, f in enumerate(factors):
                    if len(rows):
                        lower, upper = (x[i - at, rows] for x in first) if level == 0 else (self.levels[level][rows] @ x[i] for x in f)
                        rows = rows[kept(lower - self.slack, upper + self.slack, windows, k)]
                score = self.scores(q[i], rows)
                for w in windows:
                    for j in w.top(score, self.ids[rows], k):
                        yield anchors[i], w.slot, int(self.ids[rows[j]]), min(max(int(score[j]), -(2**63)), 2**63 - 1)


class Slot:
    """A window of scores of one anchor, and the k-th best that is known to be in it."""

    def __init__(self, s: dict, low: int, high: int):
        self.slot, p = s["slot"], s["positive_score"]
        self.low, self.high = (None, None) if p is None else (-((-low * p) // 100), (high * p) // 100)
        self.floor, self.floor_id = s["floor"], s["floor_id"]

    def top(self, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        ok = np.ones(len(score), bool)
        if self.low is not None:
            ok &= (score >= self.low) & (score <= self.high)
        if self.floor is not None:
            ok &= (score > self.floor) | (score == self.floor) & (ids <= self.floor_id)
        at = np.flatnonzero(ok.astype(bool))
        return at[np.lexsort((ids[at], -score[at]))[:k]] if score.dtype != object else np.array(sorted(at, key=lambda j: (-score[j], ids[j]))[:k], dtype=int)


def kept(lower: np.ndarray, upper: np.ndarray, windows: list[Slot], k: int) -> np.ndarray:
    """Rows that may be among the k best of a window, by their bounds."""
    out = np.zeros(len(lower), bool)
    for w in windows:
        least = -np.inf if w.low is None else float(w.low)
        inside = lower >= least if w.high is None else (lower >= least) & (upper <= float(w.high))
        if inside.sum() >= k:  # so many are sure to be in it
            sure = lower[inside]
            least = max(least, np.partition(sure, len(sure) - k)[len(sure) - k])
        if w.floor is not None:
            least = max(least, float(w.floor))
        out |= upper >= least if w.high is None else (upper >= least) & (lower <= float(w.high))
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_rows(rows: DataFrame, anchors: DataFrame, blocks: int, width: int, most: float, k: int, same: bool, low: int = 0, high: int = 0) -> DataFrame:
    """(anchor, slot, vec_id, score, rank): the k best rows for each slot (slot, positive_score) of each anchor (anchor, vec_id, label, q, slots)."""

    def run(table: pa.Table, asks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(table, width, most)
        for batch in asks:
            found = list(block.best(batch, k, same, low, high))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor", "slot", "vec_id", "score"])

    dealt = rows.select(block_of(blocks).alias("block"), "vec_id", "label", "q")

    def over(asked: DataFrame, of: DataFrame, numbers: list[int]) -> DataFrame:
        return met(of, asked.withColumn("block", F.explode(F.array(*map(F.lit, numbers))) if len(numbers) <= 16 else F.explode(F.sequence(F.lit(numbers[0]), F.lit(numbers[-1]), F.lit(numbers[1] - numbers[0])))), run, FOUND)

    slot = lambda f: F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["positive_score"].alias("positive_score"), *f(s)))
    none = [F.lit(None).cast("long").alias(x) for x in ("floor", "floor_id")]
    part = list(range(0, blocks, SHARE))
    first = ranked(over(anchors.withColumn("slots", slot(lambda s: none)), dealt.where(F.col("block") % SHARE == 0), part), k).where(F.col("rank") == k)
    floors = first.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("score", "vec_id")))).alias("floors"))
    known = anchors.join(floors, "anchor", "left").withColumn("slots", slot(lambda s: [F.try_element_at(F.col("floors"), s["slot"])[x].alias(n) for x, n in (("score", "floor"), ("vec_id", "floor_id"))])).drop("floors")
    return ranked(over(known, dealt, list(range(blocks))), k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, noise: int = 7, labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive the best rows of other labels whose score lies from ``low`` to ``high`` hundredths of the positive's.

    Anchors are rows whose vec_id is divisible by ``every``; their positives the first ``positives`` other rows of their
    label, by score and then smaller vec_id. Labels of rows whose vec_id is divisible by ``noise`` first become (label + 1) % ``labels``.
    Rows with a null id, label, vector or component, or one that isn't finite, take no part. Where fewer rows
    exist, or lie in the window, there are fewer; a positive of a negative score has an empty window. Rows of the anchor's own id
    are neither its positives nor its negatives; rows that repeat an id are rows of their own, equal anchors one. A vector
    shorter than others counts as filled with zeros; products beyond 2**52 are exact too, scores beyond 64 bits are
    the nearest that fit. An empty table gives no rows; other columns are ignored.
    """
    label = F.when(F.col("vec_id") % noise == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long"))
    rows = written(numbered(quantised(vectors.where("label is not null"), scale, label.alias("label"))), "vectors")
    n, width, most = rows.agg(F.count("*"), F.max(F.size("q")), F.max(F.array_max(F.transform("q", F.abs)))).first()
    blocks = max(1, min(BLOCKS, n // 64), -(-n // ROW_BLOCK))
    # an anchor is its id, label and vector; its number joins what belongs to it
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.xxhash64("vec_id", "label", "q").alias("anchor"), "vec_id", "label", "q").dropDuplicates(["anchor"])
    anchors = written(anchors, "anchors")
    args = (blocks, width or 0, float(most or 0))
    one = F.array(F.struct(F.lit(0).alias("slot"), F.lit(None).cast("long").alias("positive_score")))
    near = best_rows(rows, anchors.withColumn("slots", one), *args, positives, True)
    near = written(near.select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    slots = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("slots"))  # ``positives`` of them at most
    far = best_rows(rows, written(anchors.join(slots, "anchor"), "asked"), *args, negatives, False, low, high)
    out = far.join(near, ["anchor", "slot"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x : floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
"""
