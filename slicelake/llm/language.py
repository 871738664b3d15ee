"""Language ID by word-first backoff.

A word known from training scores its log frequency in each language. An unseen word is covered by
character n-grams, the longest known one first at each place, then shorter ones down to one letter; a word
without any known n-gram scores nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicelake.llm.common import small, texts
from slicelake.scratch import tables

#: About so many training documents of each language are fitted on, chosen by a hash of doc_id, or all where it has fewer.
FIT_DOCS = 20_000
#: The size of the model: words, and n-grams of each length up to LONGEST, of each language, the most frequent ones.
WORDS, GRAMS, LONGEST = 20_000, 5_000, 4
#: What a worker remembers of words: so many at most, in so many bytes of scores at most.
MEMORY, MEMORY_BYTES = 300_000, 64 << 20
#: Counts that a task holds before it sends them.
HELD = 200_000
#: So many languages' shares are sent to all tasks; more are joined.
SENT = 100_000


#: Runs of what is alphanumeric, but no decimal: letters, and here and there another number, as ½, ², Ⅷ.
RUN = re.compile(r"[^\W\d_]+")


def letters(run: str) -> list[str]:
    """The runs of letters within a run."""
    return [run] if run.isalpha() else "".join(x if x.isalpha() else " " for x in run).split()


def _batch(counts: dict[tuple[str, int], Counter]) -> pa.RecordBatch:
    """(lang, size, key, n): size 0 for words, else the letters of an n-gram."""
    rows = [(lang, size, x, n) for (lang, size), c in counts.items() for key, n in c.items() for x in (letters(key) if size == 0 else (key,))]
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "size", "key", "n"])


COUNTS = "lang string, size int, key string, n long"


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


def _words(train: DataFrame) -> DataFrame:
    """Counts of lower-cased words, summed a task at a time and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], Counter] = {}
        for b in small(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                counts.setdefault((lang, 0), Counter()).update(RUN.findall(text.lower()))
            if sum(map(len, counts.values())) > HELD:
                yield _batch(counts)
                counts = {}
        yield _batch(counts)

    return _summed(train.select("lang", "text").mapInArrow(run, COUNTS))


def _grams(words: DataFrame) -> DataFrame:
    """Counts of the n-grams of counted words, a space before and after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], Counter] = {}
        for b in small(batches, 4096):
            for lang, word, n in zip(*(b.column(x).to_pylist() for x in ("lang", "key", "n")), strict=True):
                padded = f" {word} "
                for size in range(1, LONGEST + 1):
                    own = counts.setdefault((lang, size), Counter())
                    for i in range(len(padded) - size + 1):
                        own[padded[i : i + size]] += n
            if sum(map(len, counts.values())) > HELD:
                yield _batch(counts)
                counts = {}
        yield _batch(counts)

    return _summed(words.mapInArrow(run, COUNTS))


class Scores:
    """Log scores of keys in each language: entries for the languages where a key occurs, and in the others what a key scores that doesn't occur there."""

    def __init__(self, keys: pa.Array, at: np.ndarray, n: np.ndarray, totals: np.ndarray):
        """Of counts n, all above zero, of ``keys`` in the languages ``at``, of which each counts ``totals``."""
        coded = pc.dictionary_encode(keys)
        code, order = coded.indices.to_numpy(zero_copy_only=False), np.argsort(coded.indices.to_numpy(zero_copy_only=False), kind="stable")
        self.row = {x: i for i, x in enumerate(coded.dictionary.to_pylist())}
        over = totals + 0.5 * (len(self.row) + 1)
        self.none, self.at = np.log(0.5 / over), at[order]
        self.scores, self.starts = np.log((n[order] + 0.5) / over[self.at]), np.searchsorted(code[order], np.arange(len(self.row) + 1))
        self.seen, self.most = {}, MEMORY_BYTES // (32 * (LONGEST + 1) * max(len(totals), 1))

    def get(self, key: str) -> list[float] | None:
        """A key's score in each language; of the first keys asked for, as many as memory is set aside for, the lists are kept."""
        known = self.seen.get(key)
        if known is not None or (i := self.row.get(key)) is None:
            return known
        own, out = slice(self.starts[i], self.starts[i + 1]), self.none.copy()
        out[self.at[own]] = self.scores[own]
        known = out.tolist()
        if len(self.seen) < self.most:
            self.seen[key] = known
        return known


class Model:
    def __init__(self, langs: list[str], words: Scores, grams: list[Scores]):
        self.langs, self.words, self.grams = langs, words, grams
        self.place: dict[str, int] = {}
        self.rows = np.zeros((max(min(MEMORY, MEMORY_BYTES // 8 // max(len(langs), 1)), 1), max(len(langs), 1)))

    def of(self, run: str) -> list[float]:
        """Log scores of a run in each language: those of its words."""
        if run.isalpha():
            return self.of_word(run)
        return [sum(x) for x in zip([0.0] * len(self.langs), *map(self.of_word, letters(run)), strict=True)]

    def of_word(self, word: str) -> list[float]:
        known = self.words.get(word)
        if known is not None:
            return known
        found, i, padded = [], 0, f" {word} "
        while i < len(padded):
            for n in range(min(LONGEST, len(padded) - i), 0, -1):
                if (g := self.grams[n].get(padded[i : i + n])) is not None:
                    found.append(g)
                    i += n
                    break
            else:
                i += 1
        return list(map(sum, zip(*found, strict=True))) if found else [0.0] * len(self.langs)

    def predict(self, text: str) -> tuple[str, float]:
        words = RUN.findall(text.lower())
        if not self.langs or not any(map(letters, words)):
            return "und", 0.0
        total, step = np.zeros(len(self.langs)), min(10_000, len(self.rows))
        for i in range(0, len(words), step):
            part = words[i : i + step]
            if len(self.place) > len(self.rows) - len(part):
                self.place.clear()
            for w in set(part).difference(self.place):
                self.rows[len(self.place)] = self.of(w)
                self.place[w] = len(self.place)
            total += self.rows[np.fromiter(map(self.place.__getitem__, part), "i8", len(part))].sum(axis=0)
        p = np.exp(total - total.max())
        return self.langs[int(total.argmax())], float(p.max() / p.sum())


def fit(train: DataFrame, words: int = WORDS, grams: int = GRAMS) -> Model:
    """The model for rows (lang, text). It holds at most ``words`` words and ``grams`` n-grams of each length for each language, ties to the smaller; they come to the driver with their counts, one for each language that has them."""
    with tables(train.sparkSession) as own:
        of_words = own.written(_words(train), "words")
        counts = own.written(of_words.unionByName(_grams(of_words)), "counts")
        totals = counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()  # five rows for each language
        most = F.when(F.col("size") == 0, words).otherwise(grams)
        nth = lambda *by: F.row_number().over(Window.partitionBy("lang", "size", *by).orderBy(F.col("n").desc(), "key")) <= most
        # the first of each of 64 parts, then the first of those
        shares = counts.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64))).withColumn("best", nth("part")).where("best")
        chosen = shares.withColumn("best", nth()).where("best").select("size", "key").distinct()
        found = counts.join(chosen, ["size", "key"]).select("size", "key", "lang", "n").toArrow().combine_chunks()
    langs = sorted({r.lang for r in totals if r["size"] == 0})
    place, every = {x: i for i, x in enumerate(langs)}, np.zeros((LONGEST + 1, len(langs)))
    for r in totals:
        every[r["size"], place[r.lang]] = r.n
    scores = []
    for size in range(LONGEST + 1):
        own = found.filter(pc.equal(found["size"], size)).combine_chunks()
        at = pc.index_in(own["lang"], value_set=pa.array(langs, pa.string())).combine_chunks().to_numpy(zero_copy_only=False)
        scores.append(Scores(own["key"].combine_chunks(), at, own["n"].to_numpy(), every[size]))
    return Model(langs, scores[0], [{}, *scores[1:]])


def languages(docs: DataFrame, fit_docs: int = FIT_DOCS, words: int = WORDS, grams: int = GRAMS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row: the language of highest score and its share of the likelihood.

    Learned from rows with a text and a lang whose crc32(doc_id) mod 3 is not 1. A text that is null or has no
    letter, or one met by a model without languages, is ``und`` with score 0. A row with a null doc_id is not held
    out and teaches nothing; repeated rows are learned as often as they stand, and each has a row; an empty table
    gives no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and text is not null and lang is not null").where(~held)
    with tables(docs.sparkSession) as own:
        shares = own.written(train.groupBy("lang").agg((F.lit(fit_docs) / F.count("*")).alias("share")), "shares")  # a row for each language
        shares = F.broadcast(shares) if shares.count() <= SENT else shares
        model = fit(train.join(shares, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003).select("lang", "text"), words, grams)
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams))  # WORDS and GRAMS of each language, and an entry for each language that has them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in small(batches):
            own = own or Model(*sent.value)
            lang, score = zip(*map(own.predict, b.column("text").to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held.alias("held_out"), "lang_pred", "score")
