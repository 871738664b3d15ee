"""Shared scratch tables, by which long jobs cut their lineage.

The folder is the one named in ``spark.checkpoint.dir``. Where that setting is absent and the session runs on
one machine (tests), a folder of our own is made; on a cluster its absence is an error, as other machines
would not see a local folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str = "part") -> str:
    """A new path under the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("slicelake.scratch.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-slicelake-")
        spark.conf.set("slicelake.scratch.dir", root)
    return f"{root.rstrip('/')}/slicelake-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, read again: lost executors cost no more than this step."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Scratch tables of one job, which go when no later step reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str = "part") -> DataFrame:
        self.paths.append(path := scratch_path(self.spark, name))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        for p in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        self.paths = []


@contextmanager
def tables(spark: SparkSession) -> Iterator[Tables]:
    """Tables that are dropped at the end of the block; what leaves it must be written elsewhere."""
    own = Tables(spark)
    try:
        yield own
    finally:
        own.drop()
