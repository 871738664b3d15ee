"""Token ids as ORC files: stripes with integer run-length encoding, row indexes and a Bloom filter on doc_id.

Documents are dealt by ranges of doc_id, so the files in the order of their names hold ascending ids and
any stripe can be read by itself. A lookup of one document reads the stripes whose row index and Bloom
filter admit its id.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicelake.llm.common import small, texts
from slicelake.scratch import scratch_path, written

#: Pieces that the tokenizer's normalizer and splitter never join: at white space, and between a Latin
#: letter and an ASCII mark other than the apostrophe, as runs of letters end there. Each piece is encoded by itself.
PIECE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[!-&(-/:-@\[-`{-~\s]|\Z)|[^ \t\n\r]+")
#: Pieces that a worker remembers.
MEMORY = 450_000


class _Coder:
    """A tokenizer with the pieces that it has met: their numbers, their ids end to end, and how many batches had them."""

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [x.content for x in added]  # found anywhere in a text, before it is split
        self.whole = any(x.normalized for x in added)  # or in what the normalizer makes of it
        self.model = self.tokenizer.model if self._keeps_letters() else None
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.number: dict[str, int] = {}
        self.ids, self.size, self.uses = [np.empty(0, "i4")], [np.empty(0, "i8")], np.empty(0, "i4")
        self._join()

    def _keeps_letters(self) -> bool:
        """Whether a word of ASCII letters reaches the model as it is, but in lower case."""
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for w in (string.ascii_lowercase, string.ascii_uppercase):
            low = normalizer.normalize_str(w) if normalizer else w
            if low != w.lower() or splitter is None or [x for x, _ in splitter.pre_tokenize_str(low)] != [low]:
                return False
        return True

    def forget(self) -> None:
        """Only pieces that two batches had since the last time are kept; none, if these are half of what may be remembered."""
        kept = self.uses > 1
        kept &= 2 * kept.sum() < MEMORY
        self.number = {p: i for i, p in enumerate(compress(self.number, kept.tolist()))}
        self.ids, self.size, self.uses = [_placed(self.ids[0], self.start, self.size[0], np.flatnonzero(kept))[0]], [self.size[0][kept]], np.ones(len(self.number), "i4")
        self._join()

    def learn(self, pieces: list[str]) -> None:
        """Words of ASCII letters go to the model itself; other words of letters many to a text, cut again where a word ends."""
        words = [p for p in pieces if p.isalpha()]
        others = [p for p in pieces if not p.isalpha()]
        if self.model:
            plain = [p for p in words if p.isascii()]
            own = [[x.id for x in self.model.tokenize(p.lower())] for p in plain]
            self._add(plain, np.array(list(chain.from_iterable(own)), "i4"), np.fromiter(map(len, own), "i8", len(own)))
            words = [p for p in words if not p.isascii()]
        for i in range(0, len(words), 1000):
            own = words[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "i4")
            size = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            if len(size) == len(own):
                self._add(own, ids, size)
            else:  # a word that the normalizer splits, or a vocabulary that doesn't mark word ends
                others += own
        for i in range(0, len(others), 4096):
            own = [e.ids for e in self.tokenizer.encode_batch_fast(others[i : i + 4096], add_special_tokens=False)]
            self._add(others[i : i + 4096], np.array(list(chain.from_iterable(own)), "i4"), np.fromiter(map(len, own), "i8", len(own)))

    def _add(self, pieces: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces)), strict=True))
        self.ids.append(ids)
        self.size.append(size)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each text has. Each distinct word between white space is cut into pieces once."""
        odd = np.full(len(column), self.whole)  # texts that the tokenizer takes as they are
        for x in self.added:
            odd |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", column) if odd.any() else column)
        words = split.flatten().dictionary_encode()
        own, n = self._encode_words(words.dictionary)
        ids, after = _placed(own, np.cumsum(n) - n, n, words.indices.to_numpy(zero_copy_only=False))
        size = np.diff(np.r_[0, after][split.offsets.to_numpy() - split.offsets[0].as_py()])
        if not odd.any():
            return ids, size
        split = np.split(ids, np.cumsum(size)[:-1])
        for i in np.flatnonzero(odd).tolist():
            split[i] = np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, "i4")
        return np.concatenate(split), np.fromiter(map(len, split), "i8", len(split))

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each word has."""
        flat = PIECE.findall(pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py())
        if not flat:
            return np.empty(0, "i4"), np.zeros(len(words), "i8")
        ids, after = _placed(*self._known(flat))
        # pieces leave no character of a word out
        cut = np.searchsorted(np.cumsum(np.fromiter(map(len, flat), "i8", len(flat))), np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype="i8"), side="right")
        return ids, np.diff(np.r_[0, after][cut], prepend=0)

    def _known(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids end to end, starts and sizes of all pieces that are remembered, and the numbers of those given. Unknown ones are learned."""
        numbers = self._numbers(flat)
        if len(self.number) > MEMORY and (numbers < 0).any():
            self.forget()
            numbers = self._numbers(flat)
        missing = np.flatnonzero(numbers < 0).tolist()
        if missing:
            self.learn(list({flat[i] for i in missing}))
            numbers[missing] = [self.number[flat[i]] for i in missing]
            self._join()
        self.uses[numbers] += 1  # once for a batch
        return self.ids[0], self.start, self.size[0], numbers

    def _numbers(self, flat: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, flat, repeat(-1)), "i8", len(flat))

    def _join(self) -> None:
        self.ids, self.size = [np.concatenate(self.ids)], [np.concatenate(self.size)]
        self.start = np.cumsum(self.size[0]) - self.size[0]
        self.uses = np.r_[self.uses, np.zeros(len(self.size[0]) - len(self.uses), "i4")]


def _placed(ids: np.ndarray, start: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces by their numbers, end to end, and how many there are up to each piece's end."""
    k = size[numbers]
    after = np.cumsum(k)
    # the i-th id of a piece stands i places after the piece's first
    at = np.repeat(start[numbers] - (after - k), k)
    at += np.arange(len(at))
    return ids[at], after


@cache
def _coder(model: bytes) -> _Coder:
    return _Coder(model)


def encode_ids(docs: DataFrame, model: bytes, end_id: int | None = 1) -> DataFrame:
    """(doc_id, ids array<int>) in the order and partitions of ``docs``; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        for b in small(batches, 1024):
            ids, size = coder.encode(b.column("text"))
            if end_id is not None:
                ids, size = np.insert(ids, np.cumsum(size), end_id), size + 1
            offsets = np.r_[0, np.cumsum(size)].astype("i4")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype("i4")))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def write_token_files(docs: DataFrame, model: bytes, path: str, end_id: int | None = 1, files: int | None = None) -> None:
    """Encodes every text and writes (doc_id, seq, ids) as ORC under ``path`` in ascending doc_id, null first, repeated ids by text; seq counts a file's rows.

    There are as many files as ``docs`` has partitions, unless ``files`` says otherwise.
    """
    docs = texts(docs)
    n = files or max(1, docs.rdd.getNumPartitions())
    dealt = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = encode_ids(dealt, model, end_id).select("doc_id", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("seq"), "ids")
    rows.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20)).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, seq, ids) of token files; a filter on doc_id reaches the row indexes and Bloom filters."""
    return spark.read.schema("doc_id long, seq long, ids array<int>").orc(path)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files: (doc_id, start, n_tokens, ids_crc32); start counts the ids of all documents before, by the number in the file's name and by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crcs = [zlib.crc32(values[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("seq"), b.column("file"), pa.array(np.diff(offsets).astype("i8")), pa.array(crcs, pa.int64())], ["doc_id", "seq", "file", "n_tokens", "ids_crc32"])

    number = F.regexp_extract(F.input_file_name(), r"part-(\d+)[^/]*$", 1).cast("long")  # names have five digits or more, so their order as text isn't that of the files
    rows = read_token_files(spark, path).select("doc_id", "seq", number.alias("file"), "ids").mapInArrow(run, "doc_id long, seq long, file long, n_tokens long, ids_crc32 long")
    rows = written(rows, "token-counts")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    own = Window.partitionBy("file").orderBy("seq")
    return rows.join(F.broadcast(before), "file").withColumn("start", F.col("before") + F.sum("n_tokens").over(own) - F.col("n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_rows(docs: DataFrame, model: bytes) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and reads their digest back; an empty table gives no rows."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, model, path)
    return token_digest(docs.sparkSession, path)
