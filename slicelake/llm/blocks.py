"""Row blocks that stay where they are while blocks of queries come to them.

Each row goes to one block of bounded size, by its number and not by a key, so that no key's rows meet in one.
Queries are copied to every block, and are the few of the two; a task reads a block's rows, then its queries
batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame) -> DataFrame:
    """Adds nth, a row's number: to be written before it is read twice."""
    return df.withColumn("nth", F.monotonically_increasing_id())


def block_of(n: int) -> Column:
    return F.pmod(F.xxhash64("nth"), F.lit(n)).cast("int")


def met(rows: DataFrame, queries: DataFrame, run: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over each block's rows (block, ...) and all queries that come to it (block, ...). Columns of both are aligned by name; what one lacks is null."""
    both = rows.withColumn("asks", F.lit(0)).unionByName(queries.withColumn("asks", F.lit(1)), allowMissingColumns=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(batches)
        key, asks, piece = next(pieces, (None, 0, None))
        while piece is not None:
            held: list[pa.RecordBatch] = []
            own = key
            while piece is not None and key == own and asks == 0:
                held.append(piece)
                key, asks, piece = next(pieces, (None, 0, None))
            table = pa.Table.from_batches(held) if held else None

            def queries_of_block() -> Iterator[pa.RecordBatch]:
                nonlocal key, asks, piece
                while piece is not None and key == own and asks == 1:  # noqa: B023
                    yield piece
                    key, asks, piece = next(pieces, (None, 0, None))

            left = queries_of_block()
            if table is not None:
                yield from run(table, left)
            for _ in left:
                pass

    return both.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(task, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Slices of one block and kind each."""
    for b in batches:
        code = b.column("block").to_numpy(zero_copy_only=False).astype("i8") * 2 + b.column("asks").to_numpy(zero_copy_only=False)
        at = 0
        while at < b.num_rows:
            n = int((code[at:] == code[at]).argmin()) or b.num_rows - at
            yield int(code[at] // 2), int(code[at] % 2), b.slice(at, n)
            at += n
