"""Substring dedup by sliding sentence spans, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicelake.llm.common import texts
from slicelake.scratch import written

#: Sentences tile a text: each runs to the end of a run of . ! ? or line breaks.
SENTENCE = "[^.!?\\n]*[.!?\\n]+|[^.!?\\n]+"


WORD = "[^\\x20\\x09-\\x0D]+"


def sentence_spans(docs: DataFrame, run: int = 3, least_chars: int = 40, least_words: int = 25) -> DataFrame:
    """(doc_id, kept, n_sentences, n_removed) for each row of ``docs``.

    A span is ``run`` consecutive sentences, trimmed and joined by a space, of ``least_chars`` characters or more;
    or fewer of ``least_words`` words or more; or all of a text that has fewer, of ``least_chars`` characters. So a
    passage of whole sentences and twice ``least_words`` words is covered by spans of its own, however its sentences
    run. A span that occurs before, in a smaller doc_id or earlier in its own document, is repeated; each sentence
    that a repeated span covers is removed, and ``kept`` is what is left, in order. Rows with a null doc_id are
    kept whole and repeat nothing; rows that share a doc_id and differ in text are told apart by a hash of it, equal
    rows count once. A null text is empty; an empty table gives no rows.
    """
    rows = texts(docs).withColumn("h", F.xxhash64("text")).withColumn("sentences", F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)))
    parts = rows.where(F.col("doc_id").isNotNull() & (F.size("sentences") > 0)).select("doc_id", "h", F.transform("sentences", lambda s: F.btrim(s, F.lit(" \n"))).alias("s"))
    parts = parts.withColumn("w", F.transform("s", lambda s: F.regexp_count(s, F.lit(WORD))))
    size, words = F.size("s"), lambda i, n: F.aggregate(F.slice("w", i + 1, n), F.lit(0), lambda a, b: a + b)
    joined = lambda i, n: F.struct(i.alias("i"), F.lit(n).alias("n"), F.array_join(F.slice("s", i + 1, n), " ").alias("span"))
    every = lambda n: F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))
    some = lambda n: F.filter(every(n), lambda i: (words(i, n) >= least_words) | (size == n))
    of = lambda n: F.transform(every(n) if n == run else some(n), lambda i: joined(i, n))
    cut = F.concat(*map(of, range(1, run + 1)))
    spans = parts.select("doc_id", "h", F.explode(cut).alias("s")).where(F.length("s.span") >= least_chars)
    spans = written(spans.select("doc_id", "h", "s.i", "s.n", F.xxhash64("s.span").alias("a"), F.xxhash64(F.lit(1), "s.span").alias("b")), "spans")
    first = written(spans.groupBy("a", "b").agg(F.min(F.struct("doc_id", "h", "i")).alias("first"), F.count("*").alias("times")).where("times > 1").select("a", "b", "first"), "firsts")
    repeated = spans.join(first, ["a", "b"]).where(F.struct("doc_id", "h", "i") > F.col("first"))
    marks = repeated.groupBy("doc_id", "h").agg(F.collect_set(F.struct("i", "n")).alias("starts"))
    joined = texts(docs).withColumn("h", F.xxhash64("text")).join(marks, ["doc_id", "h"], "left").withColumn("sentences", F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)))
    covered = F.sort_array(F.array_distinct(F.flatten(F.transform(F.coalesce("starts", F.array().cast("array<struct<i: int, n: int>>")), lambda x: F.sequence(x["i"], x["i"] + x["n"] - 1)))))
    # what stands between two removed sentences next to each other is a slice: each sentence is copied once
    joined = joined.withColumn("gone", covered).withColumn("edges", F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("sentences")))).withColumn("n_removed", F.size("gone"))
    between = F.transform(F.slice("edges", 2, F.size("edges")), lambda end, k: F.slice("sentences", F.col("edges")[k] + 2, end - F.col("edges")[k] - 1))
    kept = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.array_join(F.flatten(between), ""))
    return joined.select("doc_id", kept.alias("kept"), F.size("sentences").alias("n_sentences"), "n_removed")


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^.!?\\n]*[.!?\\n]+|[^.!?\\n]+') AS s FROM documents),
p AS (SELECT doc_id, s, n, unnest(range(0, greatest(len(s) - n + 1, 0))) AS i FROM d, (VALUES (1), (2), (3)) AS t(n)),
w AS (SELECT doc_id, i, n, len(s) AS size, array_to_string(list_transform(s[i + 1 : i + n], lambda x : trim(x, chr(32) || chr(10))), ' ') AS span FROM p),
r AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) AS nth FROM w
    WHERE length(span) >= 40 AND (n = 3 OR size = n OR len(regexp_extract_all(span, '[^\\x20\\x09-\\x0D]+')) >= 25)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM r WHERE nth > 1),
q AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(s) AS INT) AS n_sentences, CAST(coalesce(len(gone), 0) AS INT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(s)), lambda k : NOT list_contains(gone, k)), lambda k : s[k + 1]), ''), '') END) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""
