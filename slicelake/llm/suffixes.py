"""Suffix-array dedup by a depth-limited radix sort over anchored suffixes.

Suffixes are ordered only through ``length`` bytes, most significant digit first; suffixes that stay equal
through all digits are exactly the repeated windows. The first digit of a window is its anchor, the ``GRAM``
bytes of least hash in it, and its place: equal windows have equal anchors at equal offsets, so the windows
about one anchor are one record of the first pass. The digits after it are the window's bytes, eight at a time.

Pass 1 deals the anchors' hashes by their leading bits and keeps those that occur in two documents or more;
all other windows are alone after their first digit and are dropped. Pass 2 deals the anchors that are
left with the bytes around them and orders the windows about each digit by digit: a pass sorts what is not
equal yet within each group, and drops groups of one document. Each group that is left knows its smallest
document. Anchors that occur ``HOT`` times or more in all texts are too many for one task: their windows are dealt one
by one by a hash of all their bytes, and ordered there. Texts are dealt once, in chunks by doc_id; a chunk
sends each distinct record or window once, so a passage that a third of the documents hold is sent once by each
chunk. Exact copies of a whole text are found first, by a hash of it, and send no records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicelake.llm.common import parts, text_bytes, texts
from slicelake.scratch import written

GRAM = 25
#: Bytes of text in a chunk, and bytes that are hashed at a time.
CHUNK, STEP = 4 << 20, 1 << 17
#: Bytes of text for each part of the tables that chunks ask, and the occurrences of an anchor whose windows are dealt one by one.
PART, HOT = 4 << 20, 4096
#: Records whose windows are ordered at a time, and those about one anchor more.
SLAB = 4096
_RANDOM = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 256, dtype="u8") | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _rolling(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n in x, by doubling; u8."""
    out, size, done = None, 1, 0
    power = x
    while True:
        if n & size:
            # out covers ``done`` places, followed by ``size`` more
            out = power if out is None else out[: len(x) - done - size + 1] * np.uint64(pow(_BASE, size, 1 << 64)) + power[done : done + len(x) - done - size + 1]
            done += size
        if done == n:
            return out
        m = len(x) - 2 * size + 1
        power = power[:m] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size : size + m]
        size *= 2


def _rolling_rows(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n within each row of x."""
    return np.ascontiguousarray(_rolling(np.asfortranarray(x).T, n).T)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _first_least(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values, the place of the first that is least in its leading 44 bits; at most 2**20 values."""
    low, size = h >> np.uint64(20) << np.uint64(20) | np.arange(len(h), dtype="u8"), 1
    while size < w:
        s = min(size, w - size)
        low, size = np.minimum(low[:-s], low[s:]), size + s
    return (low & np.uint64((1 << 20) - 1)).astype("i4")


class Chunk:
    """The anchors of a chunk's texts: for each its hash, document, place in the chunk's bytes, and the windows about it as offsets before it."""

    def __init__(self, ids: np.ndarray, data: list[bytes], sends: np.ndarray, length: int):
        self.ids, self.data, self.sends, self.length = ids, data, sends, length
        self.hashes: np.ndarray | None = None
        sizes = np.fromiter(map(len, data), "i8", len(data))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.sizes = sizes
        self.bytes = np.frombuffer(b"".join(data), "u1")
        hashes, docs, places, lows, highs = [], [], [], [], []
        rows = np.flatnonzero(sends & (sizes >= length))
        i = 0
        while i < len(rows):
            j, total = i, 0
            while j < len(rows) and (j == i or total + sizes[rows[j]] <= STEP):
                total += sizes[rows[j]]
                j += 1
            own, i = rows[i:j], j
            for a in range(0, int(sizes[own[0]]) if len(own) == 1 else 1, STEP):  # a long text in steps that share length - 1 bytes
                spans = [(int(self.starts[own[0]]) + a, min(int(self.starts[own[0]]) + a + STEP + length - 1, int(self.ends[own[0]])))] if len(own) == 1 else [(int(self.starts[d]), int(self.ends[d])) for d in own]
                if len(own) == 1 and spans[0][1] - spans[0][0] < length:
                    continue
                block = np.concatenate([self.bytes[s:e] for s, e in spans]) if len(spans) > 1 else self.bytes[spans[0][0] : spans[0][1]]
                length_of = np.array([e - s for s, e in spans])
                ends = np.cumsum(length_of)
                h = _mix(_rolling(_RANDOM[block], GRAM))
                at = _first_least(h, length - GRAM + 1)
                ok = np.ones(len(at), bool)
                for e in ends.tolist():  # no window crosses the end of a text
                    ok[max(e - length + 1, 0) : e] = False
                window = np.flatnonzero(ok)
                at = at[window]
                cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                last = np.r_[cut[1:], len(at)] - 1
                anchor = at[cut].astype("i8")
                in_doc = np.searchsorted(ends, anchor, "right")
                shift = np.array([s for s, _ in spans]) - (ends - length_of)
                hashes.append(h[anchor])
                docs.append(own[in_doc])
                places.append(anchor + shift[in_doc])
                lows.append((anchor - window[last]).astype("u1"))
                highs.append((anchor - window[cut]).astype("u1"))
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        h = join(hashes, "u8")
        order = np.argsort(h, kind="stable")
        self.hash, self.doc, self.place, self.low, self.high = h[order], join(docs, "i8")[order], join(places, "i8")[order], join(lows, "u1")[order], join(highs, "u1")[order]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, ascending, and a byte for each: its lowest bit is whether it occurs in two documents, the others four times the binary logarithm of how often, rounded up."""
        if not len(self.hash):
            return self.hash, np.empty(0, "u1")
        cut = np.flatnonzero(np.r_[True, self.hash[1:] != self.hash[:-1]])
        ids = self.ids[self.doc]
        more = np.minimum.reduceat(ids, cut) != np.maximum.reduceat(ids, cut)
        return self.hash[cut], np.ceil(4 * np.log2(np.diff(np.r_[cut, len(ids)]))).astype("u1") << 1 | more

    def around(self, rows: np.ndarray) -> np.ndarray:
        """Bytes about the anchors ``rows``: those of its windows, others 0; a matrix."""
        reach, out = self.length - GRAM, np.zeros((len(rows), 2 * self.length - GRAM), "u1")
        offset = np.arange(-reach, self.length)
        for i in range(0, len(rows), 4096):
            own = rows[i : i + 4096]
            used = (offset >= -self.high[own][:, None].astype("i8")) & (offset < self.length - self.low[own][:, None].astype("i8"))
            at = self.place[own][:, None] + offset
            out[i : i + 4096][used] = self.bytes[at[used]]
        return out

    def records(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (hash, low, high, bytes around) among ``rows``: a representative of each, each row's number among them, and the bytes."""
        around = self.around(rows)
        key = np.concatenate([self.hash[rows].astype(">u8").view("u1").reshape(-1, 8), self.low[rows][:, None], self.high[rows][:, None], around], axis=1)
        key = np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel()
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        return first, number, around[first]


class Windows:
    """The distinct windows about some anchors of a chunk, dealt to n parts by their bytes."""

    def __init__(self, chunk: Chunk, rows: np.ndarray, n: int):
        self.chunk, self.rows, length, reach = chunk, rows, chunk.length, chunk.length - GRAM
        first, self.record, around = chunk.records(rows)
        ids = chunk.ids[chunk.doc[rows]]
        order = np.argsort(self.record, kind="stable")
        cut = np.searchsorted(self.record[order], np.arange(len(first)))
        least, most = np.minimum.reduceat(ids[order], cut), np.maximum.reduceat(ids[order], cut)
        low, high = chunk.low[rows[first]].astype("i8"), chunk.high[rows[first]].astype("i8")
        count = high - low + 1
        self.start = np.cumsum(count) - count  # of each record's windows
        rec = np.repeat(np.arange(len(first), dtype="i4"), count)
        at = (reach - low[rec] - np.arange(len(rec)) + self.start[rec]).astype("i4")  # where a window starts in its record's bytes
        every = np.lib.stride_tricks.sliding_window_view(around, length, axis=1)
        part = np.empty(len(rec), "i4")
        for i in range(0, len(rec), 65536):
            part[i : i + 65536] = _mix(_rolling_rows(_RANDOM[every[rec[i : i + 65536], at[i : i + 65536]]], length)[:, 0]) % np.uint64(n)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
        self.number, parts_, sent = np.empty(len(rec), "i4"), [], []
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(rec)], strict=True):  # a part at a time, so that few windows are bytes at once
            own = order[s:e]
            key, number = np.unique(every[rec[own], at[own]].view(f"V{length}").ravel(), return_inverse=True)
            self.number[own] = number + sum(map(len, parts_))
            ends = np.full((2, len(key)), np.iinfo("i8").max)
            np.minimum.at(ends[0], number, least[rec[own]])
            np.minimum.at(ends[1], number, -most[rec[own]])
            parts_.append(np.full(len(key), part[own[0]], "i8"))
            sent.append(np.concatenate([ends[0].astype("<i8").view("u1").reshape(-1, 8), (-ends[1]).astype("<i8").view("u1").reshape(-1, 8), key.view("u1").reshape(-1, length)], axis=1))
        self.part, self.sent = np.concatenate(parts_), np.concatenate(sent)

    def places(self, number: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Where in the chunk's bytes the windows ``number`` start, but in documents up to each one's ``least``."""
        none = np.iinfo("i8").max
        smaller = np.full(len(self.part), none)
        smaller[number] = least
        low = self.chunk.low[self.rows].astype("i8")
        count = self.chunk.high[self.rows].astype("i8") - low + 1
        row = np.repeat(np.arange(len(self.rows)), count)
        i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        found = smaller[self.number[self.start[self.record[row]] + i]] < self.chunk.ids[self.chunk.doc[self.rows[row]]]
        row, i = row[found], i[found]
        return self.chunk.place[self.rows[row]] - low[row] - i


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype("i8") * n >> 24  # leading bits, so buckets ascend with hashes


def _chunk(pdf: pd.DataFrame, length: int) -> Chunk:
    """The chunk of dealt_texts() rows; ``hashes`` are the texts' own."""
    pa.default_memory_pool().release_unused()
    own, copies = (pdf[pdf["kind"] == k].sort_values(["doc_id", "h"], kind="stable") for k in (1, 0))
    copied = set(zip(copies["doc_id"].tolist(), copies["h"].tolist(), strict=True))
    sends = np.array([x not in copied for x in zip(own["doc_id"].tolist(), own["h"].tolist(), strict=True)], bool)
    out = Chunk(own["doc_id"].to_numpy("i8"), own["data"].tolist(), sends, length)
    out.hashes = own["h"].to_numpy("i8")
    return out


def dealt_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """Texts by chunk (kind 1), and beside them the marks of exact copies of a smaller doc_id's text (kind 0); and the parts of the tables that chunks ask."""
    rows = texts(docs).where("doc_id is not null").withColumn("data", F.col("text").cast("binary")).withColumn("h", F.xxhash64("text"))
    total = text_bytes(texts(docs))
    n = parts(docs.sparkSession, total, CHUNK)
    same = written(rows.select("doc_id", "h", F.xxhash64(F.lit(1), "text").alias("g"), F.octet_length("text").alias("n")), "texts")
    groups = written(same.groupBy("h", "g", "n").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "copied")
    copies = same.join(groups, ["h", "g", "n"]).where("doc_id > least").select(F.lit(0).alias("kind"), "doc_id", "h", F.lit(None).cast("binary").alias("data"))
    every = rows.select(F.lit(1).alias("kind"), "doc_id", "h", "data").union(written(copies.distinct(), "copies"))
    return every.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n))).repartition(n, "chunk"), parts(docs.sparkSession, total, PART)


def removed_spans(docs: DataFrame, length: int = 50, then: Callable[[list[bytes], list[list[tuple[int, int]]]], dict[str, list]] | None = None, fields: str = "spans array<struct<start: long, stop: long>>") -> DataFrame:
    """(doc_id, h, spans): a text's hash and its maximal removed runs of UTF-8 bytes, as array<struct<start, stop>>.

    ``then`` turns the bytes and runs of some texts into other columns, ``fields``, within the same task.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id,
    judged on the input. A null text is empty; rows that share a doc_id don't remove one another; a row with
    a null doc_id is kept whole and removes nothing. An empty table gives no rows.
    """
    dealt, n = dealt_texts(docs)

    def hashes(pdf: pd.DataFrame) -> pd.DataFrame:
        h, much = _chunk(pdf, length).distinct()
        b = _bucket(h, n)
        cut = np.searchsorted(b, np.arange(n + 1))
        six = np.ascontiguousarray(h.astype("<u8").view("u1").reshape(-1, 8)[:, :6])  # the leading bits are the bucket's
        out = [(i, int(pdf["chunk"].iloc[0]), six[s:e].tobytes(), much[s:e].tobytes()) for i, (s, e) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if e > s]
        return pd.DataFrame(out, columns=["bucket", "chunk", "hashes", "much"])

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = []
        for x in pdf["hashes"]:
            wide = np.zeros((len(x) // 6, 8), "u1")
            wide[:, :6] = np.frombuffer(x, "u1").reshape(-1, 6)
            lists.append(wide.view("<u8").ravel())
        much = np.frombuffer(b"".join(pdf["much"]), "u1")
        _, inverse, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        kept = ((count > 1) | (np.bincount(inverse, weights=much & 1, minlength=len(count)) > 0))[inverse]
        hot = kept & (np.bincount(inverse, weights=2 ** ((much >> 1) / 4), minlength=len(count)) >= HOT)[inverse]
        cut = np.cumsum([0, *map(len, lists)]).tolist()
        packed = lambda x: [np.packbits(x[s:e]).tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "bits": packed(kept), "hot": packed(hot)})

    flags = dealt.groupBy("chunk").applyInPandas(hashes, "bucket long, chunk long, hashes binary, much binary").groupBy("bucket").applyInPandas(repeated, "chunk long, bucket long, bits binary, hot binary")

    def chosen(chunk: Chunk, bits: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the chunk's anchors that pass 1 kept, and those of hot anchors apart."""
        h, _ = chunk.distinct()
        if not len(h):
            return np.empty(0, "i8"), np.empty(0, "i8")
        b = _bucket(h, n)
        kept, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
        for bucket, x, y in zip(bits["bucket"].tolist(), bits["bits"].tolist(), bits["hot"].tolist(), strict=True):
            s, e = np.searchsorted(b, [bucket, bucket + 1])
            kept[s:e], hot[s:e] = (np.unpackbits(np.frombuffer(z, "u1"), count=e - s).astype(bool) for z in (x, y))
        at = np.searchsorted(h, chunk.hash)
        return np.flatnonzero((kept & ~hot)[at]), np.flatnonzero(hot[at])

    def cut_by(part: np.ndarray, first: int, chunk: int, records: np.ndarray) -> list[tuple]:
        """Rows (bucket, chunk, first, records) of records that ascend with their parts; buckets count from ``first``."""
        cut = np.searchsorted(part, np.arange(n + 1)).tolist()
        return [(first + i, chunk, s, records[s:e].tobytes()) for i, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if e > s]

    def around(texts_: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(texts_):
            chunk, name = _chunk(texts_, length), int(texts_["chunk"].iloc[0])
            rows, hot = chosen(chunk, bits)
            if len(rows):
                first, number, bytes_ = chunk.records(rows)
                ids = chunk.ids[chunk.doc[rows]]
                order = np.argsort(number, kind="stable")
                cut = np.searchsorted(number[order], np.arange(len(first)))
                least, most = np.minimum.reduceat(ids[order], cut), np.maximum.reduceat(ids[order], cut)
                head = rows[first]
                record = np.concatenate([chunk.hash[head].astype("<u8").view("u1").reshape(-1, 8), least.astype("<i8").view("u1").reshape(-1, 8), most.astype("<i8").view("u1").reshape(-1, 8), chunk.low[head][:, None], chunk.high[head][:, None], bytes_], axis=1)
                out += cut_by(_bucket(chunk.hash[head], n), 0, name, record)  # records ascend with their hashes
            if len(hot):
                windows = Windows(chunk, hot, n)
                out += cut_by(windows.part, n, name, windows.sent)
        return pd.DataFrame(out, columns=["bucket", "chunk", "first", "records"])

    wide = 26 + 2 * length - GRAM

    reach = length - GRAM
    start, none = np.arange(reach + 1), np.iinfo("i8").max  # bytes before the anchor at which a window starts

    def runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Orders the windows of some records, ascending by anchor, digit by digit: rows, first and last start of windows with an equal one in a smaller document, and that document."""
        h, least, most = (np.ascontiguousarray(m[:, i : i + 8]).view(t).ravel() for i, t in ((0, "<u8"), (8, "<i8"), (16, "<i8")))
        rec, a = np.nonzero((m[:, 24:25] <= start) & (start <= m[:, 25:26]))
        group = np.cumsum(np.r_[False, h[1:] != h[:-1]])[rec] * (reach + 1) + a
        order = np.argsort(group, kind="stable")
        rec, a, group = rec[order], a[order], group[order]
        digits = np.ndarray((len(m), wide - 26 - 7), "<u8", m, 26, (wide, 1))  # eight bytes from each place
        for at in (*range(0, length - 8, 8), length - 8):
            if not len(rec):
                break
            digit = digits[rec, reach - a + at]
            odd = np.flatnonzero((group[1:] == group[:-1]) & (digit[1:] != digit[:-1]))
            if len(odd):
                mixed = np.zeros(int(group[-1]) + 1, bool)
                mixed[group[odd]] = True
                i = np.flatnonzero(mixed[group])
                j = i[np.lexsort((digit[i], group[i]))]
                rec[i], a[i], digit[i] = rec[j], a[j], digit[j]
            cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
            low = np.minimum.reduceat(least[rec], cut)
            many = low < np.maximum.reduceat(most[rec], cut)
            size = np.diff(np.r_[cut, len(rec)])
            keep, low = np.repeat(many, size), low[many]
            rec, a, group = rec[keep], a[keep], np.repeat(np.arange(len(low)), size[many])
        smaller = np.full((len(m), reach + 1), none)
        if len(rec):
            smaller[rec, a] = low[group]
        smaller[smaller >= most[:, None]] = none
        hit = np.flatnonzero((smaller < none).any(axis=1))
        s = smaller[hit]
        r, a = np.nonzero(np.c_[np.ones(len(s), bool), s[:, 1:] != s[:, :-1]])
        end = np.r_[(r * (reach + 1) + a)[1:], s.size] - r * (reach + 1) if len(r) else r
        keep = s[r, a] < none
        return hit[r[keep]], a[keep], end[keep] - 1, s[r[keep], a[keep]]

    def windows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Orders whole windows: rows with an equal one in a smaller document, and that document."""
        least, most = (np.ascontiguousarray(m[:, i : i + 8]).view("<i8").ravel() for i in (0, 8))
        _, group = np.unique(np.ascontiguousarray(m[:, 16:]).view(f"V{length}").ravel(), return_inverse=True)
        low = np.full(int(group.max()) + 1, none)
        np.minimum.at(low, group, least)
        rows = np.flatnonzero(low[group] < most)
        return rows, low[group][rows]

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        """Records of a bucket, a few thousand at a time: those about equal anchors together. Windows of hot anchors have buckets of their own."""
        hot = int(pdf["bucket"].iloc[0]) >= n
        m = [np.frombuffer(x, "u1").reshape(-1, 16 + length if hot else wide) for x in pdf["records"]]
        own = np.repeat(np.arange(len(m)), [len(x) for x in m])
        number = np.concatenate([f + np.arange(len(x)) for f, x in zip(pdf["first"].tolist(), m, strict=True)])
        m = np.concatenate(m)
        if hot:
            rows, least = windows(m)
            a = b = np.zeros(len(rows), "i4")
        else:
            h = np.ascontiguousarray(m[:, :8]).view("<u8").ravel()
            order = np.argsort(h, kind="stable")
            new = np.r_[np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]), len(h)]
            cut = np.unique(np.r_[new[np.searchsorted(new, np.arange(0, len(h), SLAB))], len(h)])
            parts_ = []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                rows, a, b, least = runs(m[order[s:e]])
                parts_.append((order[s:e][rows], a, b, least))
            rows, a, b, least = (np.concatenate(x) for x in zip(*parts_, strict=True))
        frame = pd.DataFrame({"chunk": pdf["chunk"].to_numpy()[own[rows]], "number": number[rows].astype("i4"), "a": a.astype("i4"), "b": b.astype("i4"), "least": least})
        out = [(chunk, hot, *(x[c].to_numpy(t).tobytes() for c, t in (("number", "<i4"), ("a", "<i4"), ("b", "<i4"), ("least", "<i8")))) for chunk, x in frame.groupby("chunk")]
        pa.default_memory_pool().release_unused()
        return pd.DataFrame(out, columns=["chunk", "one", "number", "a", "b", "least"])

    grouped = dealt.groupBy("chunk")
    records = grouped.cogroup(flags.groupBy("chunk")).applyInPandas(around, "bucket long, chunk long, first long, records binary")
    marks = records.groupBy("bucket").applyInPandas(ordered, "chunk long, one boolean, number binary, a binary, b binary, least binary")
    # a chunk needs its flags again to number its records as before
    back = flags.unionByName(marks, allowMissingColumns=True)

    finish = then or (lambda data, spans: {"spans": [[{"start": s, "stop": e} for s, e in x] for x in spans]})
    columns = ["doc_id", "h", *(f.strip().split(" ")[0] for f in (fields.split(", ") if then else ["spans"]))]

    def spans(texts_: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if not len(texts_):
            return pd.DataFrame(columns=columns)
        chunk = _chunk(texts_, length)
        change = np.zeros(len(chunk.bytes) + 1, "i4")
        bits, found = sent[sent["bits"].notna()], sent[sent["number"].notna()]
        if len(found):
            rows, hot = chosen(chunk, bits.assign(bucket=bits["bucket"].astype("i8")))
            join = lambda x, c, t: np.frombuffer(b"".join(x[c]), t)
            one = found[found["one"].astype(bool)]
            found = found[~found["one"].astype(bool)]
            if len(found):
                first, number, _ = chunk.records(rows)
                order = np.argsort(number, kind="stable")
                cut = np.searchsorted(number[order], np.arange(len(first) + 1))
                mark, a, b, least = (join(found, c, t) for c, t in (("number", "<i4"), ("a", "<i4"), ("b", "<i4"), ("least", "<i8")))
                count = cut[mark + 1] - cut[mark]
                which = np.repeat(np.arange(len(mark)), count)
                row = rows[order[np.repeat(cut[mark] - (np.cumsum(count) - count), count) + np.arange(count.sum())]]
                later = chunk.ids[chunk.doc[row]] > least[which]
                row, which = row[later], which[later]
                np.add.at(change, chunk.place[row] - b[which], 1)
                np.add.at(change, chunk.place[row] - a[which] + length, -1)
            if len(one):
                at = Windows(chunk, hot, n).places(join(one, "number", "<i4"), join(one, "least", "<i8"))
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
        copied = np.ones(len(chunk.data), bool)
        copied[chunk.sends] = False
        whole = copied & (chunk.sizes >= length)
        np.add.at(change, chunk.starts[whole], 1)
        np.add.at(change, chunk.ends[whole], -1)
        gone = np.cumsum(change, out=change)[:-1] > 0
        found = []
        for s, e in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
            x = np.diff(np.r_[0, gone[s:e].view("i1"), 0])
            found.append(list(zip(np.flatnonzero(x == 1).tolist(), np.flatnonzero(x == -1).tolist(), strict=True)))
        return pd.DataFrame({"doc_id": chunk.ids, "h": chunk.hashes} | finish(chunk.data, found))

    def plain(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "h": pdf["h"]} | finish(pdf["data"].tolist(), [[] for _ in range(len(pdf))]))

    schema = f"doc_id long, h long, {fields}"
    kept = grouped.cogroup(back.groupBy("chunk")).applyInPandas(spans, schema)
    nameless = texts(docs).where("doc_id is null").select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("data"))
    return kept.union(nameless.mapInPandas(plain, schema))


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs drawn in to whole characters: a character goes only if all its bytes go."""
    out = []
    for s, e in spans:
        while s < e and data[s] & 0xC0 == 0x80:  # within a character that began before
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:  # within one that goes on
            e -= 1
        out.append((s, e))
    return out


def kept_text(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, h, text): what removed_spans() leaves, as text; h is the hash of the whole text."""

    def then(data: list[bytes], spans: list[list[tuple[int, int]]]) -> dict[str, list]:
        return {"text": [kept_bytes(d, whole_characters(d, s)).decode("utf-8", "replace") for d, s in zip(data, spans, strict=True)]}

    return removed_spans(docs, length, then, "text string")


def digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of removed_spans()."""

    def then(data: list[bytes], spans: list[list[tuple[int, int]]]) -> dict[str, list]:
        kept = [kept_bytes(d, s) for d, s in zip(data, spans, strict=True)]
        return {"n_bytes": [len(d) for d in data], "n_removed": [len(d) - len(k) for d, k in zip(data, kept, strict=True)], "n_spans": [len(s) for s in spans], "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}

    return removed_spans(docs, length, then, "n_bytes long, n_removed long, n_spans long, kept_sha256 string").drop("h")
