"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicelake.llm.common import small, texts
from slicelake.scratch import written

#: Random features, their seed, the ridge penalty for each row, and the bins that calibration is fitted on.
FEATURES, SEED, PENALTY, BINS = 256, 7, 1e-4, 400
#: At most about so many labelled rows are fitted on, chosen by a hash of doc_id.
FIT_ROWS = 200_000
_CLASS = np.zeros(256, dtype="u1")  # 0 other ASCII punctuation and symbols
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 6
_CLASS[:9] = 7
NAMES = ["log_bytes", "space", "digit", "upper", "lower", "high", "prose_marks", "symbols", "control", "word_mean", "word_sd", "log_longest", "distinct", "top_share", "letters_only", "ends_odd", "line_mean", "lines_distinct", "sentence_mean", "capitalised", "short_share", "pairs_distinct"]


def statistics(text: str) -> list[float]:
    """Numbers of one text that no label, language, source or id enters."""
    raw = text.encode("utf-8", "replace")
    n = max(len(raw), 1)
    c = np.bincount(_CLASS[np.frombuffer(raw, "u1")], minlength=8) / n
    words = text.split()
    m = max(len(words), 1)
    size = np.fromiter(map(len, words), "f8", len(words)) if words else np.zeros(1)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\")" for w in words) / m
    return [
        np.log1p(len(raw)), c[1], c[2], c[3], c[4], c[5], c[6], c[0], c[7], size.mean(), size.std(), np.log1p(size.max()), len(counts) / m, max(counts.values(), default=0) / m,
        sum(map(str.isalpha, words)) / m, ends, np.log1p(m / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), np.log1p(m / (1 + text.count(". ") + text.count(".\n"))),
        sum(w[:1].isupper() for w in words) / m, float((size <= 3).mean()), len(set(zip(words, words[1:], strict=False))) / m,
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, h, x array<double>): a hash and the statistics of each whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            x = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "h", "x"])

    return texts(docs).withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, h long, x array<double>")


class Model:
    """Standardisation, random Fourier features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), FEATURES))  # a Gaussian kernel of width sqrt(dimensions)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.knots, self.levels = np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1)

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to y under weights w, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for value, weight in zip(y.tolist(), w.tolist(), strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, u, n = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * u) / (blocks[-1][1] + u), blocks[-1][1] + u, blocks[-1][2] + n]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="f8")


def fit(rows: DataFrame) -> Model | None:
    """The model for rows (x, label 0 or 1); None without rows. What comes to the driver: two sums of the statistics, the summed normal equations, and counts of BINS bins."""
    n = len(NAMES)
    sums = rows.agg(F.count("*"), *[F.avg(F.col("x")[i]) for i in range(n)], *[F.stddev_pop(F.col("x")[i]) for i in range(n)]).first()
    if not sums[0]:
        return None
    model = Model(np.array(sums[1 : n + 1], "f8"), np.maximum(np.array(sums[n + 1 :], "f8"), 1e-6))
    size = FEATURES + 1

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, y = np.zeros((size, size)), np.zeros(size)
        for pdf in batches:
            for i in range(0, len(pdf), 2048):
                z = model.expand(_stacked(pdf["x"].iloc[i : i + 2048]))
                a += z.T @ z
                y += z.T @ pdf["label"].iloc[i : i + 2048].to_numpy("f8")
        i, j = np.triu_indices(size)
        yield pd.DataFrame({"i": np.r_[i, np.arange(size)].astype("i4"), "j": np.r_[j, np.full(size, size)].astype("i4"), "v": np.r_[a[i, j], y]})

    total = rows.select("x", "label").mapInPandas(equations, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    a = np.zeros((size, size + 1))
    a[total["i"], total["j"]] = total["v"]
    a[total["j"][total["j"] < size], total["i"][total["j"] < size]] = total["v"][total["j"] < size]
    model.weights = np.linalg.solve(a[:, :size] + PENALTY * sums[0] * np.eye(size), a[:, size])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                s = np.clip((model.raw(_stacked(pdf["x"])) + 1) / 3, 0, 1)  # raw scores lie about 0 and 1
                yield pd.DataFrame({"bin": np.minimum((s * BINS).astype("i4"), BINS - 1), "label": pdf["label"].to_numpy("i8")})

    bins = rows.select("x", "label").mapInPandas(binned, "bin int, label long").groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("w")).toPandas().sort_values("bin")
    model.knots, model.levels = (bins["bin"].to_numpy() + 0.5) / BINS * 3 - 1, isotonic(bins["y"].to_numpy(), bins["w"].to_numpy("f8"))
    return model


def held_out(every: int = 5, remainder: int = 0) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == remainder, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, h) for every row of ``docs``, repeated ones too; h is a hash of the text.

    A null text is empty; a null doc_id is not held out and has no label; an empty table gives no rows. Labels are learned from rows whose crc32(doc_id) mod 5 is not 0 and whose quality is 0 or 1; where a
    doc_id is labelled twice, the mean rules, and a tie is left out. Without any label every score is 0.5.
    """
    rows = written(features(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.avg("label").alias("label")).where("label <> 0.5").select("doc_id", F.round("label").cast("int").alias("label"))
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003))
    model = fit(written(rows.join(known, "doc_id").select("x", "label"), "labelled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4096):
            x = b.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype("i4")), b.column("h")], ["doc_id", "score", "predicted", "h"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int, h long").select("doc_id", held_out().alias("held_out"), "score", "predicted", "h")
