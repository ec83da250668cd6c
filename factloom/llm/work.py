"""Tables that outlive a lost executor: Parquet in the folder all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; on a cluster without one this raises, as a machine's own folder is no shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/factloom-shared"


#: Settings of a write of an operator's own: 4 MB of an Arrow batch instead of 64 and 256 rows of a batch of Parquet's
#: reader instead of 4096, as rows hold whole texts, each only where the session leaves Spark's own value; and the
#: shuffle files go with the write that needed them.
_SETTINGS = [
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"),
    ("spark.sql.parquet.columnarReaderBatchSize", "4096", "256"),
    ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false", "true"),
]


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """``_SETTINGS`` for the time of a write; the session is then as before."""
    had = {key: spark.conf.get(key, None) for key, _, _ in _SETTINGS}
    try:
        for key, own, ours in _SETTINGS:
            if had[key] in (None, own):
                spark.conf.set(key, ours)
        yield
    finally:
        for key, value in had.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster's ``--py-files`` does the same)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


#: Rows of a file of a narrow table whose size is known: neither a file a task nor a task for all.
ROWS_A_FILE = 250_000


class Workspace:
    """Written tables of one operator call.

    A table is a cut of the lineage: later jobs read it again instead of
    recomputing it, on whatever executors are left.  ``drop`` removes a table
    that no later step reads; what a result still reads goes when the driver
    ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._fresh = True

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def table(self, df: DataFrame, name: str, rows: int | None = None, by: str | None = None) -> DataFrame:
        """Write ``df`` and read it again; where ``rows`` bounds its rows, in files of about ``ROWS_A_FILE``."""
        path = self.path(name)
        if rows is not None:
            df = df.coalesce(-(-max(1, rows) // ROWS_A_FILE))
        out = df.write.mode("overwrite")
        with settings(self.spark):
            (out.partitionBy(by).option("compression", "zstd") if by else out).parquet(path)
        if self._fresh:
            fs, p = self._fs(self.base)
            fs.deleteOnExit(p)
            self._fresh = False
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = self._fs(self.path(name))
            fs.delete(p, True)


def spare_name(wanted: str, taken) -> str:
    """``wanted``, underscored until it clashes with no column of ``taken`` (case-insensitively, as Spark resolves)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


#: Bytes of one task's share where an operator deals rows itself.
TASK_BYTES = 128 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of ``df``, from its files' sizes; nothing is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Tasks of an exchange of ``df``: the session's number, or more where its estimated size asks for them."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return own if df is None else max(own, min(estimated_bytes(df) // TASK_BYTES, 100 * own, 200_000))
