"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into words with their positions, a chunk of documents at a time. A chunk sends each distinct
word once to the global table of distinct words, so a word that fills a third of the corpus is sent once
by each chunk. There each distinct word is encoded once; its ids go back to the chunks that asked and are
put in place by position. Words, ids and positions travel packed: what a chunk sends to one part of the
table is one row, and so is each document's list of positions; there is never a row for each token.
Decoding joins the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b64decode
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from slicelake.llm.common import parts, small, text_bytes, texts

SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words. Cuts fall only where no match of the tokenizer's pattern can go on: before white space (a space may
#: lead what follows it) and between a Latin letter and an ASCII mark other than the apostrophe.
WORD = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[!-&(-/:-@\\[-`{{-~{SPACE}]|\\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A chunk is closed at so many characters.
CHUNK = 8 << 20
#: Bytes of text for each part of the table of words. A chunk sends a row to each part that it has words of.
PART = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@cache
def _coder(ranks: tuple, pattern: str):
    import tiktoken

    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})


def pack_numbers(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed with their low bytes together and their high bytes together."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T).tobytes(), 3)


def unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_strings(strings: list[bytes]) -> bytes:
    sizes = pack_numbers(np.fromiter(map(len, strings), "u4", len(strings)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(b"".join(strings), 3)


def unpack_strings(packed: bytes) -> list[bytes]:
    n = int.from_bytes(packed[:4], "little")
    flat, ends = zstandard.decompress(packed[4 + n :]), np.cumsum(unpack_numbers(packed[4 : 4 + n]), dtype="i8").tolist()
    return [flat[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. Of a document: chunk, doc_id, body (the numbers of its words in order). Of a chunk: chunk, words (its distinct words by number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["chunk", "doc_id", "body", "words"]
        chunk, size, known = TaskContext.get().partitionId() << 32, 0, {}

        def words() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pack_strings([w.encode() for w in known])], pa.binary())], names)

        for b in small(batches, 128):
            bodies = []
            for t in b.column("text").to_pylist():
                found = WORD.findall(t)
                for w in set(found).difference(known):
                    known[w] = len(known)
                bodies.append(pack_numbers(np.fromiter(map(known.__getitem__, found), "u4", len(found))))
                size += len(t)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), b.column("doc_id"), pa.array(bodies, pa.binary()), pa.nulls(n, pa.binary())], names)
            if size >= CHUNK:
                yield words()
                chunk, size, known = chunk + 1, 0, {}
        if size or known:
            yield words()

    return texts(docs).mapInArrow(run, "chunk long, doc_id long, body binary, words binary")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, then: Callable[[list[bytes]], dict[str, list]] | None = None, fields: str = "ids binary") -> DataFrame:
    """(doc_id, ids binary): each document's ids as little-endian unsigned 32-bit integers; a row for each row of ``docs``.

    A null or empty text has no ids. Columns besides doc_id and text are ignored; an empty table gives no rows.
    ``then`` turns the ids of some documents into other columns, ``fields``, within the same task.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(tuple(ranks.items()))
    total = text_bytes(texts(docs))
    n = parts(spark, total, PART)
    dealt = chunks(docs).repartition(parts(spark, total, CHUNK), "chunk")

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = pdf["words"].dropna()
        words = unpack_strings(packed.iloc[0]) if len(packed) else []
        part = np.fromiter((xxhash.xxh32_intdigest(w) % n for w in words), "i8", len(words))
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(n + 1)).tolist()
        rows = [(i, int(pdf["chunk"].iloc[0]), pack_numbers(order[s:e]), pack_strings([words[k] for k in order[s:e].tolist()])) for i, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if e > s]
        return pd.DataFrame(rows, columns=["part", "asks", "numbers", "words"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        coder, known, ids = _coder(vocabulary.value, pattern), {}, []
        for packed in pdf["words"]:
            words = unpack_strings(packed)
            for w in words:
                if w not in known:
                    known[w] = np.array(coder.encode_ordinary(w.decode()), "<u4")
            sizes = np.fromiter((len(known[w]) for w in words), "u4", len(words))
            found = pack_numbers(np.concatenate([known[w] for w in words]))
            sizes = pack_numbers(sizes)
            ids.append(len(sizes).to_bytes(4, "little") + sizes + found)
        return pd.DataFrame({"asks": pdf["asks"].to_numpy(), "numbers": pdf["numbers"], "ids": ids})

    def place(body: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        body = body[body["body"].notna()]
        numbers, sizes, ids = [np.empty(0, "u4")], [np.empty(0, "u4")], [np.empty(0, "u4")]
        for number, packed in zip(answers["numbers"], answers["ids"], strict=True):
            k = int.from_bytes(packed[:4], "little")
            numbers.append(unpack_numbers(number))
            sizes.append(unpack_numbers(packed[4 : 4 + k]))
            ids.append(unpack_numbers(packed[4 + k :]))
        numbers, flat, given = np.concatenate(numbers), np.concatenate(ids), np.concatenate(sizes).astype("i8")
        size, start = np.zeros(len(numbers), "i8"), np.zeros(len(numbers), "i8")
        size[numbers], start[numbers] = given, np.cumsum(given) - given
        out = []
        for i in range(0, len(body), 64):
            ids = []
            for packed in body["body"].iloc[i : i + 64]:
                words = unpack_numbers(packed)
                k = size[words]
                # the i-th id of a word stands i places after the word's first
                at = np.repeat(start[words] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                ids.append(flat[at].tobytes())
            out.append(pd.DataFrame({"doc_id": body["doc_id"].iloc[i : i + 64].astype("Int64").to_numpy()} | (then(ids) if then else {"ids": ids})))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", *(f.split()[0] for f in fields.split(","))])

    asked = dealt.groupBy("chunk").applyInPandas(ask, "part long, asks long, numbers binary, words binary")
    answers = asked.groupBy("part").applyInPandas(answer, "asks long, numbers binary, ids binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("asks")).applyInPandas(place, f"doc_id long, {fields}")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``decoded`` (binary), the bytes of each row's ids, by a join with the token-byte table in each task."""
    table = encoded.sparkSession.sparkContext.broadcast(tuple(ranks.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token = _table(table.value).bytes
            out = [b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields), "decoded binary"]))


class _Table:
    """Bytes and decimal text of each id."""

    def __init__(self, ranks: tuple):
        top = max((i for _, i in ranks), default=-1) + 1
        self.bytes, self.decimal = [b""] * top, [str(i) for i in range(top)]
        for t, i in ranks:
            self.bytes[i] = t


@cache
def _table(ranks: tuple) -> _Table:
    return _Table(ranks)


def digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): texts encoded, and the ids decoded again, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(ranks.items()))

    def then(ids: list[bytes]) -> dict[str, list]:
        table = _table(sent.value)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for x in ids:
            own = np.frombuffer(x, "<u4").tolist()
            out["n_tokens"].append(len(own))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(table.decimal.__getitem__, own)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join(map(table.bytes.__getitem__, own))).hexdigest())
        return out

    return encode(docs, ranks, pattern, then, "n_tokens long, ids_sha256 string, decoded_sha256 string")
