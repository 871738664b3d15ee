"""Exact Jaccard similarity within groups of candidates.

An index gives groups of texts that may be similar (components of candidate links). Here each text's shingle set is brought to
its group once, and pairs are verified by the sets themselves. Groups of up to CELL_TEXTS texts and CELL_SHINGLES
shingles are one cell. Larger ones are first compared with one of their members, the hub: what the hub is similar to is
one component already. The rest is dealt to parts, and meets the joined ones, and itself, part by part.
Cells give spanning forests of their links, which leaves the components as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelake.llm.common import small, texts
from slicelake.scratch import Tables

CELL_TEXTS, CELL_SHINGLES = 512, 1 << 20
#: Shingles that are columns of a matrix at a time.
COLUMNS = 4096


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sets shares."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    size = np.array([len(x) for x in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(m), size)
    new = np.cumsum(count > 1) - 1  # what one set alone has is shared by none
    some = count[code] > 1
    code, own = new[code[some]], own[some]
    order = np.argsort(code, kind="stable")
    code, own = code[order], own[order]
    out = np.zeros((m, m), "f8")
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [first, first + COLUMNS])
        x = np.zeros((m, COLUMNS), "f4")
        x[own[a:b], code[a:b] - first] = 1
        out += x @ x.T
    out[np.arange(m), np.arange(m)] = size
    return out


def similar(sets: list[np.ndarray], least: Fraction) -> np.ndarray:
    """Which pairs have a Jaccard similarity of ``least`` or more: shared * (q + p) >= p * (sizes' sum), least = p / q."""
    size = np.array([len(x) for x in sets], "f8")
    return common(sets) * (least.denominator + least.numerator) >= least.numerator * (size[:, None] + size[None])


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of a symmetric matrix."""
    left, a, b = np.ones(len(near), bool), [], []
    for i in range(len(near)):
        if left[i]:
            left[i], edge = False, [i]
            while edge:
                x = edge.pop()
                found = np.flatnonzero(near[x] & left)
                left[found] = False
                edge += found.tolist()
                a += [x] * len(found)
                b += found.tolist()
    return np.array(a, int), np.array(b, int)


def shingle_sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(component, id, n, elements) of each member (component, id, doc_id, h), h being the hash of its text; once, however often a row repeats."""
    from slicelake.llm.simhash import shingle_hashes

    text = texts(docs).withColumn("h", F.xxhash64("text")).where("doc_id is not null")
    one = text.join(members, ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("component").alias("component"), F.first("id").alias("id"), F.first(F.col("text").cast("binary")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("component"), b.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["component", "id", "n", "elements"])

    return one.select("component", "id", "text").mapInArrow(run, "component long, id long, n long, elements binary")


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, "u8") for b in column]


def links_within(sets: DataFrame, least: Fraction, own: Tables) -> DataFrame:
    """(a, b): links that join all ids (component, id, n, elements) of a component whose sets are similar, directly or over others."""
    parts = F.greatest(F.ceil(F.count("*") / CELL_TEXTS), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int")
    groups = own.written(sets.groupBy("component").agg(parts.alias("parts")), "groups")

    def small_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _runs(batches):
            a, b = forest(similar(_sets(pdf["elements"]), least))
            if len(a):
                ids = pdf["id"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    one = sets.join(groups.where("parts = 1"), "component", "left_semi").repartition("component").sortWithinPartitions("component", "id")
    links = own.written(one.mapInArrow(small_groups, "a long, b long"), "links")
    many = groups.where("parts > 1")
    if many.isEmpty():
        return links
    large = own.written(sets.join(many, "component"), "large")
    hubs = large.groupBy("component").agg(F.min_by(F.struct(F.col("id").alias("hub"), F.col("elements").alias("hub_elements")), F.xxhash64("id")).alias("p")).select("component", "p.*")

    def with_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("elements").to_pylist(), b.column("hub_elements").to_pylist(), strict=True)
            near = [bool(similar([np.frombuffer(x, "u8"), np.frombuffer(y, "u8")], least)[0, 1]) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([b.column("component"), b.column("id"), b.column("hub"), b.column("parts"), b.column("elements"), pa.array(near)], ["component", "id", "hub", "parts", "elements", "joined"])

    seen = own.written(large.join(hubs, "component").mapInArrow(with_hub, "component long, id long, hub long, parts int, elements binary, joined boolean"), "seen")
    links = links.union(seen.where("joined and id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    every: Column = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rest, joined = seen.where("not joined"), seen.where("joined")
    sides = rest.select("component", part.alias("x"), every.alias("y"), "joined", "id", "elements").union(joined.select("component", every.alias("x"), part.alias("y"), "joined", "id", "elements"))
    among = rest.select("component", part.alias("own"), every.alias("other"), "id", "elements").select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "elements")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        is_joined, ids = pdf["joined"].to_numpy(bool), pdf["id"].to_numpy()
        if is_joined.all() or not is_joined.any():
            return pd.DataFrame({"a": ids[:0], "b": ids[:0]})
        hit = similar(_sets(pdf["elements"]), least)[~is_joined][:, is_joined]
        some = hit.any(axis=1)  # one link into what the hub joins is enough
        return pd.DataFrame({"a": ids[~is_joined][some], "b": ids[is_joined][hit.argmax(axis=1)[some]]})

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(similar(_sets(pdf["elements"]), least))
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    found = sides.groupBy("component", "x", "y").applyInPandas(across, "a long, b long").union(among.groupBy("component", "x", "y").applyInPandas(within, "a long, b long"))
    return links.union(own.written(found, "across"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Rows of one component each, from rows that are sorted by it."""
    rest = None
    for b in batches:
        pdf = b.select(["component", "id", "elements"]).to_pandas()
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        cut = np.flatnonzero(np.r_[True, pdf["component"].to_numpy()[1:] != pdf["component"].to_numpy()[:-1]]) if len(pdf) else np.zeros(0, int)
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            yield pdf.iloc[i:j]
        rest = pdf.iloc[cut[-1] :] if len(cut) else None
    if rest is not None and len(rest):
        yield rest
