"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicelake.scratch import tables, written

LOW = 0xFFFFFFFF
#: Random orders that rounds take in turn.
ORDERS = 4


def _keyed(half: Column, key: int) -> Column:
    return F.xxhash64(F.lit(key), half).bitwiseAND(F.lit(LOW))


def shuffled(x: Column, key: int, back: bool = False) -> Column:
    """A permutation of the 64-bit numbers that ``key`` picks, or its inverse: two rounds of a Feistel network over halves."""
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(LOW))
    if back:
        low = low.bitwiseXOR(_keyed(high, 2 * key + 1))
        high = high.bitwiseXOR(_keyed(low, 2 * key))
    else:
        high = high.bitwiseXOR(_keyed(low, 2 * key))
        low = low.bitwiseXOR(_keyed(high, 2 * key + 1))
    return F.shiftleft(high, 32).bitwiseOR(low)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, node, component) for every node of an edge, of type long; the component is its smallest node.

    Nodes are apart where they differ in the columns ``by``, which an edge has once. Each round puts the nodes in a
    random order, sends each to the first of all within two edges of it, and joins what met. On average at most
    half of the nodes of any graph are first among their neighbours, whatever its shape, so tables shrink by half or
    more a round, rounds are logarithmic in the nodes of a component and the work is linear in the edges; there
    is no limit of rounds. Rounds are written to the shared folder and dropped at the end; what comes to the driver is
    whether edges are left. Edges with a null end and loops are ignored; an empty table has no components.
    """
    spark = edges.sparkSession
    pair = (*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    with tables(spark) as own:
        left = edges.select(*by, F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
        left = own.written(left.select(*pair).distinct(), "edges")
        steps: list[DataFrame] = []
        while not left.isEmpty():
            key = len(steps) % ORDERS
            both = left.union(left.select(*by, "b", "a"))
            near = both.groupBy(*by, "a").agg(F.least(shuffled(F.col("a"), key), F.min(shuffled(F.col("b"), key))).alias("first"))
            first = both.join(near.withColumnRenamed("a", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("first").alias("first"))
            step = own.written(first.select(*by, "node", shuffled(F.col("first"), key, back=True).alias("top")), "step")
            steps.append(step)
            met = left.join(step.toDF(*by, "a", "x"), [*by, "a"]).join(step.toDF(*by, "b", "y"), [*by, "b"]).select(*by, F.col("x").alias("a"), F.col("y").alias("b"))
            left = own.written(met.where("a <> b").select(*pair).distinct(), "edges")
        if not steps:
            return written(left.select(*by, F.col("a").alias("node"), F.col("b").alias("component")), "named")
        named = steps.pop()
        while steps:
            # the top of a step is a node of the next one, or its component is complete
            named = steps.pop().join(named.toDF(*by, "top", "root"), [*by, "top"], "left").select(*by, "node", F.coalesce("root", "top").alias("top"))
        named = written(named, "named")
    least = named.groupBy(*by, "top").agg(F.min("node").alias("component"))
    return named.join(least, [*by, "top"]).select(*by, "node", "component")
