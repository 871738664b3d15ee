"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is one or more words of 64 bits, each of eight positional bytes. Two words at d differing bits
differ in at most d bytes, so they share at least 8 - d positional bytes. The index posts each distinct
fingerprint under every set of ``match`` positions of its first word with the bytes there; within a posting
list the shared positional bytes of a pair are tallied, pairs that reach the minimum are kept and verified by
the differing bits of all words. With one word and ``match = 8 - max_bits`` no pair within ``max_bits`` is missed.

That guarantee ends where near copies differ in more bits than a word has bytes, as texts do whose shingles
have a Jaccard similarity of 0.8 (about 10 of 64). For them (``least``) a fingerprint is posted under shingles
too: two sets with a similarity of t or more share, in any one order of all shingles, one of the first
n - ceil(t n) + 1 of each. The order is by how often a shingle occurs, so that common passages are hardly ever
posted. Pairs that meet there and differ in ``max_bits`` or fewer are candidates; the sets of shingles of what candidates join
are then compared themselves (``jaccard``), and only pairs at ``least`` or more are links.

A list is read in the order of ids. What is linked to its first member, the hub, is one component, so in a list
longer than ``BLOCK`` only the rows that the hub does not link are compared with others, block by block of
the list: links and copies grow with a group of near copies, not with its square. Tasks give spanning forests of
their links, which leaves the components as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicelake.graph import connected_components
from slicelake.llm import jaccard
from slicelake.llm.common import small, texts
from slicelake.scratch import tables, written

BLOCK = 1024
#: Slots of the table of counts by which shingles are ordered, and parts that it is summed in. They decide what is posted, never what is found.
SLOTS, SLOT_PARTS = 1 << 18, 64
#: Ids whose links a task remembers, to leave out links that join nothing new.
MEMORY = 200_000


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """A hash of each run of ``shingle`` words, repeated ones too; of all words where there are fewer."""
    tokens = text.lower().split()  # of bytes: lowers A-Z only, splits at \\x20 and \\x09-\\x0D only
    joined, hash_ = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= shingle:
        return np.array([hash_(joined, seed)] if tokens else [], dtype="u8")
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - shingle + 1].tolist()
    return np.array([hash_(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype="u8")


def bits(hashes: np.ndarray, words: int = 1) -> bytes:
    """Eight bytes a word, most significant first; a bit is 1 if it is 1 in over half of the hashes. Words after the first mix the same hashes anew."""
    if not len(hashes):
        return bytes(8 * words)
    out = []
    for word in range(words):
        if word:
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(word)
            hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            hashes ^= hashes >> np.uint64(29)
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(hashes), 8192):
            ones += np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(hashes)).tobytes())
    return b"".join(out)


def fingerprint(text: bytes, shingle: int, words: int = 1, seed: int = 42) -> bytes:
    """The bits of a text's shingles."""
    return bits(shingle_hashes(text, shingle, seed), words)


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, least: str | None = None) -> DataFrame:
    """(doc_id, h, f0, f1, ..., keys, own) of each row: a hash of its text, and the words as longs. A null text is empty, a text without words has fingerprint 0.

    ``keys`` are the shingles to post for a Jaccard similarity of ``least``, ``own`` a hash of all that differ; none without it.
    """
    names = [f"f{i}" for i in range(words)]
    classes = docs.sparkSession.sparkContext.broadcast(_classes(docs, shingle)) if least else None  # one byte a slot
    t = Fraction(least or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fps, keys, owns = [], [], []
            for text in b.column("text").to_pylist():
                h = shingle_hashes(text, shingle)
                fps.append(bits(h, words))
                if classes:
                    own = np.unique(h)
                    owns.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
                    most = len(own) - -(-t.numerator * len(own) // t.denominator) + 1 if len(own) else 0
                    keys.append(own[np.lexsort((own, classes.value[_slot(own)]))[:most]].view("i8"))
            m = np.frombuffer(b"".join(fps), dtype=">i8").astype("i8").reshape(-1, words)
            ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype("i4") if keys else np.zeros(b.num_rows + 1, "i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.empty(0, "i8")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *(pa.array(m[:, i]) for i in range(words)), lists, pa.array(np.array(owns or [0] * b.num_rows, "u8").view("i8"))], ["doc_id", "h", *names, "keys", "own"])

    return _raw(docs).mapInArrow(run, "doc_id long, h long, " + ", ".join(f"{n} long" for n in names) + ", keys array<long>, own long")


def _raw(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(SLOTS)).astype("i8")


def _classes(docs: DataFrame, shingle: int) -> np.ndarray:
    """How common the shingles of a slot are, all texts counted: four classes for each doubling. SLOT_PARTS rows come to the driver."""
    each = SLOTS // SLOT_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, "i8")
        for b in small(batches):
            h = [shingle_hashes(t, shingle) for t in b.column("text").to_pylist()]
            total += np.bincount(_slot(np.concatenate(h)), minlength=SLOTS) if h else 0
        if total.any():
            parts = [zlib.compress(total[i : i + each].tobytes(), 1) for i in range(0, SLOTS, each)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOT_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(each, "i8")
        for pdf in pdfs:
            for x in pdf["counts"]:
                total += np.frombuffer(zlib.decompress(x), "i8")
        yield pd.DataFrame({"part": [key[0]], "classes": [(4 * np.log2(1 + total)).astype("u1").tobytes()]})

    rows = _raw(docs).select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, classes binary").collect()
    out = np.zeros(SLOTS, "u1")
    for r in rows:
        out[r.part * each : (r.part + 1) * each] = np.frombuffer(r.classes, "u1")
    return out


def near(a: np.ndarray, b: np.ndarray, max_bits: int, match: int) -> np.ndarray:
    """Count filter, then verification, of pairs of fingerprints (last axis: words)."""
    x = np.ascontiguousarray(a ^ b)
    shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1).max(axis=-1)  # of the best word
    return (shared >= match) & (np.bitwise_count(x).sum(axis=-1, dtype=np.int32) <= max_bits)


def forest(fps: np.ndarray, max_bits: int, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``fps`` to link, so that what is linked within it is joined: fewer links than rows."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            found = np.zeros(len(left), dtype=bool)
            for i in range(0, len(edge), 64):
                rest = np.flatnonzero(~found)
                own = edge[i : i + 64]
                hit = near(fps[own][:, None], fps[left[rest]][None], max_bits, match)
                any_ = hit.any(axis=0)
                a.append(own[hit.argmax(axis=0)[any_]])
                b.append(left[rest[any_]])
                found[rest[any_]] = True
            edge, left = left[found], left[~found]
    return (np.concatenate(a), np.concatenate(b)) if a else (left, left)


class _Joined:
    """Which ids the links so far have joined; tells the links that join something new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    def new(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(self.up) > MEMORY:
            self.up = {}
        out = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out[i] = True
        return out


class _Lists:
    """Posting lists as they arrive, sorted by key and id: links (kind 0), and of long lists the members that their hub doesn't link (kind 1)."""

    def __init__(self, words: int, max_bits: int, match: int):
        self.words, self.max_bits, self.match = words, max_bits, match
        self.key, self.id, self.fps = np.empty(0, "i8"), np.empty(0, "i8"), np.empty((0, words), "u8")
        self.last, self.hub, self.joined = None, None, _Joined()  # the long list under way: its key, and its first member

    def rest(self, key: np.ndarray, id_: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(key), 1, "i4"), key, id_, id_, *(np.ascontiguousarray(fps[:, i]).view("i8") for i in range(self.words))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "a", "b", *(f"f{i}" for i in range(self.words))])

    def links(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        new = self.joined.new(a, b)
        none = [np.zeros(int(new.sum()), "i8")] * self.words
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.zeros(int(new.sum()), "i4"), np.zeros(int(new.sum()), "i8"), a[new], b[new], *none)], ["kind", "key", "a", "b", *(f"f{i}" for i in range(self.words))])

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = self.key[:n], self.id[:n], self.fps[:n]
        self.key, self.id, self.fps = self.key[n:], self.id[n:], self.fps[n:]
        return out

    def whole(self, n: int) -> Iterator[pa.RecordBatch]:
        """The first n rows, which are whole lists."""
        key, id_, fps = self.take(n)
        if not n:
            return
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[cut, n])
        two = cut[size == 2]
        two = two[near(fps[two], fps[two + 1], self.max_bits, self.match)]
        a, b = [id_[two]], [id_[two + 1]]
        some = (size > 2) & (size <= BLOCK)
        for s, k in zip(cut[some].tolist(), size[some].tolist(), strict=True):
            x, y = forest(fps[s : s + k], self.max_bits, self.match)
            a.append(id_[s + x])
            b.append(id_[s + y])
        yield self.links(np.concatenate(a), np.concatenate(b))
        for s, k in zip(cut[size > BLOCK].tolist(), size[size > BLOCK].tolist(), strict=True):
            yield from self.about(id_[s], fps[s], key[s : s + k], id_[s : s + k], fps[s : s + k])

    def about(self, hub: int, bits_: np.ndarray, key: np.ndarray, id_: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        linked = near(fps, bits_[None], self.max_bits, self.match)
        own = id_[linked & (id_ != hub)]
        yield self.links(np.full(len(own), hub, "i8"), own)
        if not linked.all():
            yield self.rest(key[~linked], id_[~linked], fps[~linked])

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, id_ = np.r_[self.key, batch.column("key").to_numpy()], np.r_[self.id, batch.column("id").to_numpy()]
        fps = np.concatenate([self.fps, np.stack([batch.column(f"f{i}").to_numpy().view("u8") for i in range(self.words)], axis=1)])
        once = np.r_[True, (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])] if len(key) else np.empty(0, bool)
        self.key, self.id, self.fps = key[once], id_[once], fps[once]
        if not len(self.key):
            return
        if self.hub is not None and self.key[0] == self.last:  # the long list goes on
            yield from self.about(*self.hub, *self.take(int(np.searchsorted(self.key, self.last, "right"))))
        if len(self.key):
            self.hub = None
            yield from self.whole(int(np.searchsorted(self.key, self.key[-1])))
            if len(self.key) > BLOCK:
                self.last, self.hub = self.key[-1], (self.id[0], self.fps[0])
                yield from self.about(*self.hub, *self.take(len(self.key)))

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.whole(len(self.key))


def byte_postings(fps: DataFrame, names: list[str], match: int) -> DataFrame:
    """(key, id, f0, ...): each fingerprint (id, f0, ...) under every set of ``match`` positions of its first word."""
    masks = [sum(0xFF << (8 * p) for p in ps) for ps in combinations(range(8), match)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col(names[0]).bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    return fps.select(F.explode(keys).alias("key"), "id", *names)


def links(postings: DataFrame, names: list[str], max_bits: int, match: int) -> DataFrame:
    """(a, b): enough of the links among fingerprints (key, id, f0, ...) that share a key to join all that they join."""
    dealt = postings.repartition("key").sortWithinPartitions("key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists(len(names), max_bits, match)
        for batch in batches:
            yield from lists.add(batch)
        yield from lists.end()

    bits_ = ", ".join(f"{n} long" for n in names)
    found = written(dealt.mapInArrow(run, f"kind int, key long, a long, b long, {bits_}"), "links")
    pairs, rest = found.where("kind = 0").select("a", "b"), found.where("kind = 1").select("key", F.col("a").alias("id"), *names)
    if rest.isEmpty():
        return pairs.distinct()
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = rest.groupBy("key").agg(F.count("*").alias("rest"))
    hot = postings.join(sizes, "key").distinct()
    hot = written(hot.join(rest.select("key", "id", F.lit(True).alias("left")), ["key", "id"], "left").withColumn("left", F.coalesce("left", F.lit(False))), "lists")
    counts = hot.groupBy("key").agg(F.count("*").alias("all"))
    hot = hot.join(counts, "key").select("key", "id", *names, "left", blocks("rest").alias("rests"), blocks("all").alias("alls"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = hot.where("left")
    # what the hub links is one component already: a link to one of it is enough
    sides = hot.where("not left").select("key", own("alls").alias("x"), every("rests").alias("y"), "left", "id", *names)
    sides = sides.union(left.select("key", every("alls").alias("x"), own("rests").alias("y"), "left", "id", *names))
    # and those left among themselves
    among = left.withColumn("own", own("rests")).withColumn("other", every("rests")).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", *names)
    of = lambda pdf: np.ascontiguousarray(pdf[names].to_numpy("i8")).view("u8")

    def to_hub(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, joined = pdf[pdf["left"]], pdf[~pdf["left"]]
        a, b, fps = [], [], of(joined)
        for i in range(0, len(asks) if len(joined) else 0, 64):
            hit = near(of(asks.iloc[i : i + 64])[:, None], fps[None], max_bits, match)
            some = hit.any(axis=1)
            a.append(asks["id"].to_numpy()[i : i + 64][some])
            b.append(joined["id"].to_numpy()[hit.argmax(axis=1)[some]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)} if a else {"a": [], "b": []}).astype("int64")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(of(pdf), max_bits, match)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    pairs = pairs.union(sides.groupBy("key", "x", "y").applyInPandas(to_hub, "a long, b long"))
    return pairs.union(among.groupBy("key", "x", "y").applyInPandas(block, "a long, b long")).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, words: int = 1, match: int | None = None, least: str | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, h): component_id is the smallest doc_id reachable over links, its own included; h is a hash of the text.

    Fingerprints are linked that are equal, or differ in ``max_bits`` or fewer and share ``match`` positional bytes
    of their first word (by default the guaranteed minimum, 8 - max_bits). With ``least``, texts are linked instead whose
    sets of shingles are equal or have a Jaccard similarity of ``least`` or more, exactly; ``max_bits`` then says which pairs
    that share a posted shingle or ``match`` positional bytes are candidates. Every row of ``docs`` gives a row,
    repeated ones too. A row whose doc_id is null has a component only if it is linked to others; with ``least`` it joins
    none. An empty table gives no rows; columns besides doc_id and text are ignored.
    """
    names = [f"f{i}" for i in range(words)]
    match = 8 - max_bits if match is None else match
    if match < 1:
        raise ValueError("no positional byte is sure to be shared at so many differing bits")
    number = F.col("own") if least else F.col("f0") if words == 1 else F.xxhash64(*names)
    prints = written(fingerprints(docs, shingle, words, least).withColumn("id", number), "prints")
    distinct = written(prints.groupBy("id", *names).agg(F.min("doc_id").alias("least_id")), "distinct")
    postings = byte_postings(distinct, names, match)
    if least:
        once = prints.select("id", *names, "keys").dropDuplicates(["id"])
        postings = postings.union(once.select(F.explode("keys").alias("key"), "id", *names))
    components = connected_components(links(postings, names, max_bits, 0 if least else match))
    if least:
        with tables(docs.sparkSession) as own:
            members = prints.where("doc_id is not null").join(components.withColumnRenamed("node", "id"), "id").groupBy("id").agg(F.first("component").alias("component"), F.min(F.struct("doc_id", "h")).alias("p"))
            sets = own.written(jaccard.shingle_sets(docs, members.select("component", "id", "p.*"), shingle), "sets")
            components = connected_components(jaccard.links_within(sets, Fraction(least), own))
    named = distinct.groupBy("id").agg(F.min("least_id").alias("least_id")).join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
    of = named.join(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "label").select("id", "component_id")
    digits = F.concat(*[F.lower(F.lpad(F.hex(n), 16, "0")) for n in names])
    return prints.join(of, "id").select("doc_id", digits.alias("fingerprint"), "component_id", "h")
