"""Document fingerprints by consistent weighted sampling.

A document is a bag of weighted terms: its pairs of neighbouring words, weighted by their counts (a text
of one word: the word). For each of ``SAMPLES`` samples every term draws r and c from Gamma(2, 1) and b
from Uniform(0, 1), the same draws wherever the term occurs; with t = floor(ln w / r + b) the sample is the
pair (term, t) of least ln c - r (t - b + 1). Two documents' samples are equal with the probability of their
generalised Jaccard similarity, sum of min over sum of max of the weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicelake.llm.common import parts, text_bytes, texts
from slicelake.scratch import written

SAMPLES = 64
#: Steps of the distributions' quantiles: a term's draws are picked by bits of a hash of the term and the sample.
STEPS = 1 << 16
#: Terms whose values a task holds at a time, 256 bytes each.
BLOCK = 8192
#: Characters of texts that are sampled together; a term that several of them have as often is drawn once, or again where others have it more or less often.
TOGETHER = 1 << 15


@cache
def _quantiles() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x), their logarithms, those of Uniform(0, 1), and a salt for each sample."""
    q = (np.arange(STEPS) + 0.5) / STEPS
    low, high = np.zeros(STEPS), np.full(STEPS, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        less = 1 - (1 + x) * np.exp(-x) < q
        low, high = np.where(less, x, low), np.where(less, high, x)
    salts = _mix(np.arange(1, SAMPLES + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
    return x.astype("f4"), np.log(x).astype("f4"), q.astype("f4"), salts


def draws(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each term (a row) for each sample (a column)."""
    gamma, log_gamma, _, salts = _quantiles()
    h = _mix(terms[:, None] ^ salts)
    bits = h.astype("<u8", copy=False).view("<u2").reshape(*h.shape, 4)
    b = bits[:, :, 2].astype("f4")
    b += np.float32(0.5)
    b *= np.float32(1 / STEPS)  # as _quantiles has it: 17 bits, so exact
    return gamma.take(bits[:, :, 0], mode="clip"), log_gamma.take(bits[:, :, 1], mode="clip"), b


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))


def _bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending terms and their counts, of the hashes of a text's words."""
    return np.unique(_mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words, return_counts=True)


def _values(term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """ln c - r (t - b + 1) of each term (a row) for each sample (a column)."""
    value = np.empty((len(term), SAMPLES), "f4")
    for i in range(0, len(term), 512):
        r, log_c, b = draws(term[i : i + 512])
        own = weight[i : i + 512]
        np.subtract(1, b, out=value[i : i + 512])  # where a term stands once, t is 0
        if own.max() > 1:
            often = np.flatnonzero(own > 1)
            value[i + often] = _steps(own[often], r[often], b[often]) - b[often] + 1
        value[i : i + 512] *= r
        np.subtract(log_c, value[i : i + 512], out=value[i : i + 512])
    return value


def _steps(weight: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """t of each term (a row) for each sample (a column)."""
    return np.floor(np.log(weight).astype("f4")[:, None] / r + b)


def _signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of 16-bit codes for each bag of terms: all 0 for an empty bag, else none 0. What bags share isn't drawn for each."""
    term, weight = (np.concatenate(x) for x in zip(*bags, strict=True))
    ends = np.cumsum([len(t) for t, _ in bags])
    out = np.zeros((len(bags), SAMPLES), "<u2")
    if not len(term):
        return out
    order = term.argsort(kind="stable")
    term, weight = term[order], weight[order]
    new = np.r_[True, (term[1:] != term[:-1]) | (weight[1:] != weight[:-1])]
    place = np.empty(len(order), "i8")
    place[order] = np.cumsum(new) - 1
    term, weight = term[new], weight[new]
    places = np.split(place, ends[:-1])  # of each bag, ascending
    best, least = np.full(out.shape, np.inf, "f4"), np.zeros(out.shape, "i8")
    sample = np.arange(SAMPLES)
    for i in range(0, len(term), BLOCK):
        value = _values(term[i : i + BLOCK], weight[i : i + BLOCK])
        for k, own in enumerate(places):
            if len(term) > BLOCK:
                own = own[slice(*own.searchsorted([i, i + BLOCK]))]
            if not len(own):
                continue
            at = own[value.take(own - i, axis=0).argmin(axis=0)]  # of equal values the least term's
            found = value[at - i, sample]
            less = found < best[k]
            best[k, less], least[k, less] = found[less], at[less]
    codes = _mix(term[least] + _chosen_steps(term, weight, least).astype("i8").view("u8") * np.uint64(0x9E3779B97F4A7C15))
    filled = np.diff(ends, prepend=0) > 0
    out[filled] = codes[filled] % np.uint64(65535) + np.uint64(1)
    return out


def _chosen_steps(term: np.ndarray, weight: np.ndarray, least: np.ndarray) -> np.ndarray:
    """t of the term at each place of ``least``, whose columns are samples."""
    t = np.zeros(least.shape, "f4")
    often = weight[least] > 1
    if often.any():
        which, at = np.unique(least[often], return_inverse=True)
        r, _, b = draws(term[which])
        t[often] = _steps(weight[which], r, b)[at, np.nonzero(often)[1]]
    return t


def signature(text: str) -> np.ndarray:
    """A 16-bit code for each sample; all 0 for a text without words, else none 0."""
    return _signatures([_bag(_hashes(text.split()))])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): 64 samples as 256 hex digits. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([signature(t).tobytes().hex() for t in b.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "own", "edited", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, own binary, edited binary, near_edited double, near_next double"


def _edit(text: str, after: str) -> tuple[str, np.ndarray, np.ndarray]:
    """A text with its last quarter replaced by as much of the next one's start, and both texts' hashes of words; those before the cut are made once."""
    q = len(text) // 4
    kept = text[: len(text) - q]
    changed = kept + after[:q]
    before = kept.split() or [""]
    words = _hashes(text.split())
    # the last word before the cut may go on beyond it
    rest = changed[len(kept.rstrip()) - len(before[-1]) :].split()
    return changed, words, np.concatenate([words[: len(before) - 1], _hashes(rest)])


def _rows(pairs: list[tuple]) -> list[tuple[tuple, np.ndarray]]:
    """All columns but near_next of each (doc_id, text, next text), and the text's signature."""
    bags, rows = [], []
    for doc_id, text, after in pairs:
        changed, *words = _edit(text, after)
        bags += map(_bag, words)
        rows.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    signs = _signatures(bags) if bags else []
    return [((*row, own.tobytes(), edited.tobytes(), likeness(own, edited)), own) for row, own, edited in zip(rows, signs[::2], signs[1::2], strict=True)]


def edited_fingerprints(docs: DataFrame, bytes_a_part: int = 16 << 20) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last floor(n_chars / 4) code points are the next document's first.

    Next is by ascending doc_id (null first, repeated ids by text), after the last the first; a lone document
    follows itself. Documents are dealt by ranges of doc_id and read in order, each beside its next; the last
    of a part meets the first of the next part in a join of as many rows as there are parts. A null text is empty;
    every row gives a row, repeated ones too; an empty table gives none.
    """
    docs = texts(docs)
    n = parts(docs.sparkSession, text_bytes(docs), bytes_a_part)
    dealt = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, waiting, size, pairs, out = TaskContext.get().partitionId(), None, None, 0, [], []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*COLUMNS, "part", "first", "last"])

        def sampled() -> list[tuple]:
            """Rows of the pairs read so far, but for the last, which waits for the next text's signature."""
            nonlocal waiting
            done = []
            for row, sign in _rows(pairs):
                if waiting:
                    done.append((*waiting[0], likeness(waiting[1], sign), part, None, None))
                waiting = row, sign
            pairs.clear()
            return done

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if held is None:
                    out.append((*[None] * len(COLUMNS), part, text, None))
                else:
                    pairs.append((*held, text))
                    size += len(text)
                held = doc_id, text
                if size >= TOGETHER:
                    out, size = out + sampled(), 0
                if len(out) >= 256:
                    yield batch(out)
                    out = []
        if held:
            out += sampled()
            if waiting:
                out.append((*waiting[0], likeness(waiting[1], signature(held[1])), part, None, None))
            yield batch([*out, (held[0], *[None] * (len(COLUMNS) - 1), part, None, held[1])])

    rows = written(dealt.mapInArrow(run, SCHEMA + ", part int, first string, last string"), "sampled")
    firsts = rows.where("first is not null").select("part", "first")
    order = Window.orderBy("part")  # a number for each part, no texts
    follows = firsts.select("part").select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next"))
    ends = rows.where("last is not null").select("doc_id", "last", "part").join(follows, "part")
    ends = ends.join(firsts.toDF("next", "after"), "next").select("doc_id", "last", "after")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text, after in zip(*(b.column(c).to_pylist() for c in ("doc_id", "last", "after")), strict=True):
                (row, sign), = _rows([(doc_id, text, after)])
                row = *row, likeness(sign, signature(after))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], COLUMNS)

    done = rows.where("own is not null").select(*COLUMNS).union(ends.mapInArrow(end, SCHEMA))
    return done.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("own")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"), "near_edited", "near_next")
