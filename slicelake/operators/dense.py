"""Dense pieces of volumes as arrays within tasks: components of runs, distances, and the helpers that bring a piece together.

Everything here works on one slice or brick, whose size is bounded by the image and not by the archive.
"""

from __future__ import annotations

import numpy as np

BITS = 21
LIMIT = 1 << BITS


def numbers(k: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Voxel numbers, ascending in (k, r, c)."""
    return ((k.astype("i8") << BITS) + r << BITS) + c


def half_lines(conn: int) -> list[tuple[int, int, int]]:
    """(dk, dr, reach): the lines after a voxel's own that hold neighbours of it, and how far along the line they lie."""
    flat = [(0, 1, 0 if conn in (4, 6) else 1)]
    if conn in (4, 8):
        return flat
    if conn == 6:
        return [*flat, (1, 0, 0)]
    corner = 1 if conn == 26 else 0
    return [*flat, (1, -1, corner), (1, 0, 1), (1, 1, corner)]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the n nodes that each reaches over edges (a, b)."""
    top = np.arange(n)
    while len(a):
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = top[top]
            if (up == top).all():
                break
            top = up
    return top


def touching(line: np.ndarray, first: np.ndarray, last: np.ndarray, step: int, reach: int, other: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs (line, first, last; ordered) such that the second lies ``step`` lines on and they touch within ``reach`` columns."""
    to_line, to_first, to_last = other or (line, first, last)
    wide = LIMIT * 4  # no run reaches into another line's numbers
    lo = np.searchsorted(to_line * wide + to_last, (line + step) * wide + first - reach, "left")
    hi = np.searchsorted(to_line * wide + to_first, (line + step) * wide + last + reach, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(line)), n)
    return a, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def runs_of(k: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of voxels in (k, r, c) order: the number of each one's run of neighbouring columns, and where runs start."""
    new = np.ones(len(c), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1]) | (c[1:] - c[:-1] > 1)  # repeated voxels are in one run
    return np.cumsum(new) - 1, np.flatnonzero(new)


def components(k: np.ndarray, r: np.ndarray, c: np.ndarray, conn: int) -> np.ndarray:
    """The least voxel number of each voxel's component, by union of touching runs."""
    if not len(c):
        return np.zeros(0, "i8")
    order = np.lexsort((c, r, k))
    k, r, c = (x[order].astype("i8") for x in (k, r, c))
    of, start = runs_of(k, r, c)
    end = np.r_[start[1:], len(c)] - 1
    ks, rs = k[start], r[start]
    lines = (ks - ks.min()) * (rs.max() - rs.min() + 3) + rs - rs.min() + 1  # a row more on either side
    a, b = [], []
    for dk, dr, reach in half_lines(conn):
        x, y = touching(lines, c[start], c[end], dk * (rs.max() - rs.min() + 3) + dr, reach)
        a.append(x)
        b.append(y)
    top = joined(len(start), np.concatenate(a), np.concatenate(b))
    # runs are in order of their first voxels, so the least run holds the least voxel
    out = np.empty(len(order), "i8")
    out[order] = numbers(k[start], r[start], c[start])[top][of]
    return out


def squared_distance(zeros: np.ndarray, spacing: tuple[float, ...]) -> np.ndarray:
    """Squared distance of each place to the nearest place of ``zeros``, exact, axis by axis; infinite without any.

    The first axis is two scans; over each further one the lower envelope of parabolas is taken offset by offset, until
    an offset alone is further than the largest distance left.
    """
    far = np.where(zeros, 0.0, np.inf)
    for axis, s in enumerate(spacing):
        x = np.moveaxis(far, axis, 0)
        if axis == 0:
            for y in (x, x[::-1]):
                steps = np.full(x.shape[1:], np.inf)
                for i in range(len(y)):
                    steps = np.where(np.isfinite(y[i]) & (y[i] == 0), 0.0, steps + 1)
                    y[i] = np.minimum(y[i], (steps * s) ** 2)
            continue
        best = x.copy()
        for d in range(1, len(x)):
            if (d * s) ** 2 >= best.max():
                break
            np.minimum(best[d:], x[:-d] + (d * s) ** 2, out=best[d:])
            np.minimum(best[:-d], x[d:] + (d * s) ** 2, out=best[:-d])
        x[...] = best
    return far


def grid(places: list[np.ndarray], values: np.ndarray | None = None, pad: int = 0) -> tuple[np.ndarray, list[int]]:
    """The least box about places as an array of values (NaN where none), or of booleans, ``pad`` places wider on all sides; and its first places."""
    first = [int(p.min()) - pad for p in places]
    shape = [int(p.max()) + pad + 1 - f for p, f in zip(places, first, strict=True)]
    out = np.zeros(shape, bool) if values is None else np.full(shape, np.nan)
    out[tuple(p - f for p, f in zip(places, first, strict=True))] = True if values is None else values
    return out, first
