"""Exact quantiles of any number of values, group by group, by radix selection.

A double's bits, in an order that follows its value, are read 16 at a time: counts of the leading bits say which values
a rank can have, the next pass counts only those. After four passes the value is known. Counts are combined before they
are shuffled, and no buffer holds a group's values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicelake.scratch import written

c = F.col
STEP, BITS = 16, 64


def _flip(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as longs in the order of their values; its own inverse."""
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _mapped(df: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    """Replaces a double by its ordered bits, or back."""
    to_bits = kind == "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(source).to_numpy(zero_copy_only=False)
            out = _flip((x + 0.0).view("i8")) if to_bits else _flip(x).view("f8")
            i = b.schema.get_field_index(source)
            yield b.set_column(i, target, pa.array(out))

    fields = ", ".join(f"`{target}` {kind}" if f.name == source else f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, fields)


def exact_quantiles(rows: DataFrame, by: tuple[str, ...], value: str, shares: dict[str, float]) -> DataFrame:
    """(*by, *shares): for each group the quantile of each share, between neighbours linearly: the value at rank share * (n - 1) from 0.

    Null and NaN values take no part; a group of nothing else has no row; -0 counts as 0. Equal values, hot groups and
    groups of any size are read as they are, four times.
    """
    v = c(value).cast("double")
    values = written(_mapped(rows.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("x")), "x", "o", "long"), "ordered")
    sizes = written(values.groupBy(*by).agg(F.count("*").alias("n")), "sizes")
    places = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(s)) * (c("n") - 1)).alias("at")) for name, s in shares.items()])
    asked = sizes.withColumn("p", F.explode(places)).select(*by, "p.name", c("p.at").alias("at"), F.explode(F.array(F.floor("p.at"), F.ceil("p.at"))).alias("rank")).distinct()
    asked = asked.withColumns({"left": c("rank"), "prefix": F.lit(0).cast("long")})
    for shift in range(BITS - STEP, -1, -STEP):
        known = shift < BITS - STEP
        parent = F.shiftright("o", shift + STEP) if known else F.lit(0).cast("long")
        pool = values.select(*by, parent.alias("prefix"), F.shiftright("o", shift).alias("next"))
        if known:
            pool = pool.join(asked.select(*by, "prefix").distinct(), [*by, "prefix"], "left_semi")
        counts = pool.groupBy(*by, "prefix", "next").agg(F.count("*").alias("m"))
        before = F.sum("m").over(Window.partitionBy(*by, "prefix").orderBy("next")) - c("m")
        found = asked.join(counts.withColumn("before", before), [*by, "prefix"]).where((c("left") >= c("before")) & (c("left") < c("before") + c("m")))
        asked = written(found.select(*by, "name", "at", "rank", (c("left") - c("before")).alias("left"), c("next").alias("prefix")), "ranks")
    at = _mapped(asked.select(*by, "name", "at", "rank", "prefix"), "prefix", "x", "double")
    ends = at.groupBy(*by, "name", "at").agg(F.min_by("x", "rank").alias("low"), F.max_by("x", "rank").alias("high"))
    own = ends.select(*by, "name", F.when(c("low") == c("high"), c("low")).otherwise(c("low") + (c("high") - c("low")) * (c("at") - F.floor("at"))).alias("x"))
    return own.groupBy(*by).agg(*[F.max(F.when(c("name") == s, c("x"))).alias(s) for s in shares])
