import random

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("an", "er", "th", "on", "re", "ti", "st", "ou") for b in ("", "a", "ing", "ed", "nd", "le")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, a shared passage, empty, null, one very long text, marks, other scripts."""
    rng = random.Random(3)
    plain = [" ".join(sentence(rng, rng.randint(4, 14)) for _ in range(rng.randint(2, 12))) for _ in range(30)]
    passage = " ".join(sentence(rng, 12) for _ in range(6))
    out = [*plain, plain[0], plain[0], plain[1], plain[2].replace("er", "or", 1), plain[3][:-5] + "xyz.", plain[4] + " " + passage, passage + " " + plain[5], "Ä " + passage, "", None, "   \n\t ", "one", "two words", "A" * 300, "don't stop, it's 12:30 – naïve ÜBER straße 東京 🙂  done\n\nyes", " ".join(plain) * 6]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "fr", f"src{i % 5}", None if t is None else len(t)) for i, t in texts]
    # columns that clash with names the operators use
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({x: F.lit("clash") for x in ("fp", "component_id", "chunk", "h", "kind", "score", "copies", "id", "word", "id_", "h_", "of_", "copies_", "row", "own")}).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def hard(spark, docs):
    """docs, and beside them: rows without an id, rows that stand twice, one id with two texts, nulls in every column, a text of a megabyte."""
    one = docs.where("doc_id = 1")
    rows = [(1, "Another text of the same id stands here, in words that no other has.", None, None, None), (None, None, None, None, None), (500, "the river ran " * 80_000, "en", "src1", 1_120_000)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.unionByName(one).unionByName(one).unionByName(one.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(more, allowMissingColumns=True)
