"""Mixing sources to target weights, with DataFrame functions only.

Weights stand on a tree of domains, languages and sources. Capacities (tokens times the most epochs) are
summed upwards; the budget is dealt downwards, at each node in proportion to its children's weights, where
a child that can't take its share is filled and the rest goes to its siblings. As a node's own capacity is
what its subtree can take, a shortage reaches the siblings of an ancestor only when all nearer ones are full.
A leaf reads whole epochs and then a prefix, by tokens, of one more epoch in seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicelake.scratch import written

LEVELS = ("domain", "lang", "source")
#: Parts of a leaf's seeded order: as many as three hexadecimal digits tell.
DIGITS = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def _fill(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Adds ``share`` to rows (parent..., key, cap, weight, budget): budget dealt by weight, none above its cap."""
    ranked = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    order = Window.partitionBy(*parent or [F.lit(0)]).orderBy(F.col("ratio").asc_nulls_last(), F.col(key).asc_nulls_first())
    before = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(F.col("weight") > 0, (F.col("budget") - before) / rest)
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy(*parent or [F.lit(0)])))
    return ranked.withColumn("share", F.when(F.col("weight") > 0, F.least(F.col("cap").cast("double"), F.col("weight") * F.greatest("level", F.lit(0.0)))).otherwise(0.0)).drop("ratio", "level")


def leaf_budgets(leaves: DataFrame, weights: dict[str, Column], budget: int, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaves (domain, lang, source, tokens) and a weight for each level, a column over its node's names."""
    nodes = leaves.withColumn("cap", F.col("tokens") * epochs)
    for level in LEVELS:
        nodes = nodes.withColumn(f"w_{level}", F.greatest(F.coalesce(weights[level].cast("double"), F.lit(0.0)), F.lit(0.0)))
    nodes = nodes.withColumn("cap", F.when((F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0), F.col("cap")).otherwise(0))
    dealt = None
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        own = nodes.groupBy(*parent, level).agg(F.sum("cap").alias("cap"), F.max(f"w_{level}").alias("weight"))
        if dealt is None:
            own = own.withColumn("budget", F.lit(float(budget)))
        else:
            same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in parent]
            own = own.alias("x").join(dealt.alias("y"), same).select("x.*", "y.budget")
        dealt = _fill(own, parent, level).select(*parent, level, F.col("share").alias("budget"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in LEVELS]
    return leaves.alias("x").join(dealt.alias("y"), same).select("x.*", F.floor(F.col("y.budget") + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, Column], share: float = 0.5, epochs: int = 2, seed: int = 17) -> DataFrame:
    """(doc_id, h, domain, lang, source, n_tokens, copies) of the documents chosen; copies counts the epochs that hold it.

    The budget is ``share`` of all tokens (words between ASCII white space). The last epoch of a leaf holds the
    documents, in seeded order, whose running sum of tokens stays within what is left. Null names are nodes of
    their own; a null text has no tokens. Rows that share a doc_id are told apart by h, a hash of the text,
    and equal rows are chosen together. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), domain.alias("domain"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), *LEVELS, F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_tokens"))
    rows = written(rows.groupBy("doc_id", "h", *LEVELS).agg(F.sum("n_tokens").alias("n_tokens")), "tokens")
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = written(leaf_budgets(leaves, weights, int(total * share), epochs), "budgets")
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in LEVELS] + [F.pmod(F.xxhash64("x.doc_id", "x.h"), F.lit(64)) == F.col("y.salt")]
    placed = rows.alias("x").join(plan.alias("y"), same).select("x.*", "y.whole", "y.rest")
    placed = placed.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    placed = written(placed.withColumn("part", F.substring("place", 1, DIGITS)), "placed")
    sums = placed.groupBy(*LEVELS, "part").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("part")) - F.col("n"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*LEVELS, "part")]
    known = placed.alias("x").join(sums.alias("y"), same).select("x.*", "y.before", "y.n")
    # a part that lies within the prefix or beyond it needs no order of its own
    within, edge = F.col("before") + F.col("n") <= F.col("rest"), (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))
    running = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "part").orderBy("place", "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0))
    sure = known.where(~edge).withColumn("more", F.when(within, 1).otherwise(0))
    cut = known.where(edge).withColumn("more", F.when(running <= F.col("rest"), 1).otherwise(0))
    return sure.unionByName(cut).withColumn("copies", (F.col("whole") + F.col("more")).cast("long")).where("copies > 0").select("doc_id", "h", *LEVELS, "n_tokens", "copies")


def mixed_documents(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` (from mix) holds, each as often as it has copies."""
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_h"))
    of = chosen.select("doc_id", "h", "copies").groupBy("doc_id", "h").agg(F.max("copies").alias("copies"))
    joined = own.join(of, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_h") == F.col("h")))
    return joined.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def domain_of_source() -> Column:
    """The tree of the registered query: four domains by the number in a source's name."""
    return F.concat(F.lit("d"), (F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)", 1).try_cast("int"), F.lit(0)) % 4).cast("string"))


def target_weights() -> dict[str, Column]:
    return {
        "domain": F.when(F.col("domain") == "d0", 1.0).when(F.col("domain") == "d1", 3.0).otherwise(2.0),
        "lang": F.when(F.col("lang") == "en", 3.0).when(F.col("lang") == "fr", 4.0).otherwise(2.0),
        "source": F.when(F.col("source") == "src0", 2.0).otherwise(1.0),
    }


SQL = """
WITH t AS (SELECT doc_id, lang, source, 'd' || CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)', 1) AS INT), 0) % 4 AS VARCHAR) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM t GROUP BY ALL),
total AS (SELECT CAST(floor(sum(tokens) * CAST(0.5 AS DOUBLE)) AS DOUBLE) AS b FROM leaf),
w AS (SELECT *, tokens * 2 AS cap, CASE domain WHEN 'd0' THEN 1.0::DOUBLE WHEN 'd1' THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS w1,
    CASE lang WHEN 'en' THEN 3.0::DOUBLE WHEN 'fr' THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END AS w2, CASE source WHEN 'src0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w3 FROM leaf),
n1 AS (SELECT domain, CAST(sum(cap) AS DOUBLE) AS cap, max(w1) AS w FROM w GROUP BY ALL),
l1 AS (SELECT *, ((SELECT b FROM total) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM n1 WINDOW o AS (ORDER BY cap / w, domain)),
a1 AS (SELECT domain, least(cap, w * greatest(max(lv) OVER (), 0)) AS b FROM l1),
n2 AS (SELECT domain, lang, CAST(sum(cap) AS DOUBLE) AS cap, max(w2) AS w FROM w GROUP BY ALL),
l2 AS (SELECT n2.*, (b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM n2 JOIN a1 USING (domain) WINDOW o AS (PARTITION BY domain ORDER BY cap / w, lang)),
a2 AS (SELECT domain, lang, least(cap, w * greatest(max(lv) OVER (PARTITION BY domain), 0)) AS b FROM l2),
n3 AS (SELECT domain, lang, source, CAST(sum(cap) AS DOUBLE) AS cap, max(w3) AS w FROM w GROUP BY ALL),
l3 AS (SELECT n3.*, (b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM n3 JOIN a2 USING (domain, lang) WINDOW o AS (PARTITION BY domain, lang ORDER BY cap / w, source)),
a3 AS (SELECT domain, lang, source, CAST(floor(least(cap, w * greatest(max(lv) OVER (PARTITION BY domain, lang), 0)) + 1e-6) AS BIGINT) AS b FROM l3),
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS whole, b - CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END * tokens AS rest FROM a3 JOIN leaf USING (domain, lang, source)),
r AS (SELECT t.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM t JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN run <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r WHERE whole + CASE WHEN run <= rest THEN 1 ELSE 0 END > 0
"""
