"""Lineage cuts that survive lost executors: Parquet in the folder all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on a cluster without one this raises, as a machine's own folder is no shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/factloom-shared"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


class Levels:
    """The levels of a traversal, each written on its own and all read by one scan: a plan as small at any level as at the first."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.base = scratch(spark, name)

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/level-{self.n}"
        df.write.parquet(path)
        self.n, self.schema = self.n + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.base)


def cut(df: DataFrame, name: str = "step", compression: str | None = None) -> DataFrame:
    """``df`` written and read again: an iteration's plan starts from a scan, not from all iterations before it."""
    path = scratch(df.sparkSession, name) + "/rows"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
