"""Embedding whitening by shifted CholeskyQR.

The centred rows A are never brought together. A pass sums the Gram matrix of the rows as far as they are
orthogonalised, Q = A R1^-1 R2^-1 ..., each factor by a triangular solve; the Cholesky factor of that sum is the next R. The first
sum is shifted by a multiple of the rounding error, so that its factor exists however badly conditioned the rows
are. When the sum is the identity but for rounding, R = Rk ... R2 R1 holds all of A but its orthonormal rows: the
SVD of R gives the eigenvectors and eigenvalues of the covariance without squaring what is small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelake.scratch import written

#: Rows that a task holds as matrices at a time.
CHUNK = 4096
#: Passes at most, and how near to the identity the Gram matrix has to be; three passes do for a full rank.
PASSES, NEAR = 6, 1e-13
#: Share of the greatest singular value below which a direction counts as constant.
RANK = 1e-11
#: Integers are kept within this many bits; a larger component is the nearest number that fits.
BITS = 53


def integers(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * c) + offset of each component; rows whose vector is null or holds a null, NaN or infinite component are left out."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = float(1 << BITS)
    return vectors.where(v.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-most)), F.lit(most))) + offset).alias("x"))


def filled(x: Column, width: int, offset: int) -> Column:
    """Arrays of one width: components that a vector lacks are zeros."""
    return F.when(F.size(x) < width, F.concat(x, F.array_repeat(F.lit(offset).cast("long"), F.lit(width) - F.size(x)))).otherwise(x)


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            b = batch.slice(i, CHUNK)
            yield b, b.column("x").flatten().to_numpy().reshape(-1, width)


def sums(rows: DataFrame, width: int) -> tuple[int, list[int], int]:
    """Number of rows, exact sums of each dimension, and the largest magnitude: ``width`` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        n, s, most = 0, [0] * width, 0
        for _, x in matrices(batches, width):
            high, low = x >> 24, x & ((1 << 24) - 1)  # of 53 bits: sums of either half fit
            s = [a + (h << 24) + lo for a, h, lo in zip(s, high.sum(axis=0).tolist(), low.sum(axis=0).tolist(), strict=True)]
            n, most = n + len(x), max(most, int(np.abs(x).max(initial=0)))
        out = pd.DataFrame({"i": range(width), "n": n, "s": [Decimal(a) for a in s], "most": most})
        yield pa.RecordBatch.from_pandas(out, schema=pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0)), ("most", pa.int64())]), preserve_index=False)

    found = rows.select("x").mapInArrow(run, "i int, n long, s decimal(38,0), most long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("most").alias("most")).collect()
    s = {r.i: int(r.s) for r in found}
    return (found[0].n, [s[i] for i in range(width)], found[0].most if width == 0 else max(r.most for r in found)) if found else (0, [0] * width, 0)


def deviations(x: np.ndarray, n: int, s: list[int], most: int) -> np.ndarray:
    """n*x - S, exact: as 64-bit integers where they fit, else as Python's."""
    if 2 * n * most < 1 << 62:
        return x * n - np.array(s, "i8")
    return x.astype(object) * n - np.array(s, object)


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a r^-1 of an upper triangular r, column by column."""
    out = np.empty_like(a)
    for j in range(a.shape[1]):
        out[:, j] = (a[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(rows: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of q' q and of q over all rows, q = of(x): a task sends ``size`` rows of sums, and size² numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, mean = np.zeros((size, size)), np.zeros(size)
        for _, x in matrices(batches, width):
            q = of(x)
            g += q.T @ q
            mean += q.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([row.tobytes() for row in g], pa.binary()), pa.array(mean)], ["i", "g", "m"])

    def add(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, mean = np.zeros(size), 0.0
        for pdf in pdfs:
            total += np.stack([np.frombuffer(b, "f8") for b in pdf["g"]]).sum(axis=0)
            mean += pdf["m"].sum()
        yield pd.DataFrame({"i": [key[0]], "g": [total.tobytes()], "m": [mean]})

    found = rows.select("x").mapInArrow(run, "i int, g binary, m double").groupBy("i").applyInPandas(add, "i int, g binary, m double").collect()
    g, m = np.zeros((size, size)), np.zeros(size)
    for r in found:
        g[r.i], m[r.i] = np.frombuffer(r.g, "f8"), r.m
    return (g + g.T) / 2, m


def factors(rows: DataFrame, width: int, n: int, s: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (as rows) of the centred rows."""
    solves: list[np.ndarray] = []
    unit = np.finfo("f8").eps / 2

    def of(x: np.ndarray) -> np.ndarray:
        q = deviations(x, n, s, most).astype("f8") / n
        for r in solves:
            q = solved(q, r)
        return q

    whole = np.eye(width)
    for step in range(PASSES):
        g, _ = gram(rows, width, of, width)
        size = np.trace(g)
        if size == 0:
            break
        if step and np.abs(g - np.eye(width)).max() <= max(NEAR, 8 * unit * np.sqrt(n)):
            break
        shift = 11 * (n * width + width * (width + 1)) * unit * size  # bounded by the share of a shift that leaves the next pass well conditioned
        shift = min(shift, 1e-8 * size)
        try:
            r = np.linalg.cholesky(g if step else g + shift * np.eye(width)).T
        except np.linalg.LinAlgError:  # rows without some direction: the shift stands in for it
            r = np.linalg.cholesky(g + max(shift, 1e-12 * size) * np.eye(width)).T
        solves.append(r)
        whole = r @ whole
    else:
        g, _ = gram(rows, width, of, width)
    # of a full rank g is the identity here; else it lacks the directions that the rows lack
    value, vector = np.linalg.eigh(g)
    _, singular, right = np.linalg.svd(np.sqrt(np.maximum(value, 0))[:, None] * (vector.T @ whole))
    return singular, right


def whitened(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row of ``vectors`` with a finite vector and each component.

    Fitted on each distinct integer vector once: n of them, S their sums by dimension. ``deviation`` is the sum of (n*x - S)^2,
    exact (the largest long where none holds it); ``whitened`` the projection on a component over the root of its
    eigenvalue; ``explained`` its eigenvalue's share of all. Directions in which the vectors don't differ are no
    components, so few or equal vectors have fewer, and one alone has none and gives no rows. Repeated rows and
    rows with a null vec_id are rows like any other; a vector shorter than the longest counts as filled with zeros; an
    empty table gives no rows; other columns are ignored. What the driver and each task hold is the square of
    the width, never a number of rows.
    """
    raw = written(integers(vectors, scale, offset), "integers")
    width = raw.agg(F.max(F.size("x"))).first()[0] or 0
    rows = raw.select("vec_id", filled(F.col("x"), width, offset).alias("x"))
    distinct = written(rows.select("x").distinct(), "distinct")
    n, s, most = sums(distinct, width) if width else (0, [], 0)
    singular, right = factors(distinct, width, n, s, most) if n else (np.zeros(0), np.zeros((0, width)))
    kept = [i for i, x in enumerate(singular[:components]) if x > RANK * singular[0]]
    variance = singular**2 / max(n, 1)
    weights = right[kept].T / np.sqrt(variance[kept]) if kept else np.zeros((width, 0))
    share, size = variance[kept] / max(variance.sum(), np.finfo("f8").tiny), len(kept)

    def project(x: np.ndarray) -> np.ndarray:
        return deviations(x, n, s, most).astype("f8") / n @ weights

    error = 0.0
    if size:
        g, m = gram(distinct, width, project, size)
        error = float(np.abs(g / n - np.outer(m, m) / n**2 - np.eye(size)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in matrices(batches, width):
            own = deviations(x, n, s, most)
            far = own.dtype == object or width * int(np.abs(own).max(initial=0)) ** 2 >= 1 << 63
            square = [min(sum(v * v for v in row), 2**63 - 1) for row in own.tolist()] if far else (own * own).sum(axis=1)
            k = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(np.repeat(np.arange(k), size))), pa.array(np.tile(np.arange(1, size + 1, dtype="i4"), k)), pa.array(np.full(k * size, n, "i8")), pa.array(np.repeat(np.array(square, "i8"), size)),
                    pa.array(project(x).ravel()), pa.array(np.tile(share, k)), pa.array(np.full(k * size, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema) if size else vectors.sparkSession.createDataFrame([], schema)
