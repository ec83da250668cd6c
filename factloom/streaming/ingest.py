"""Facts from streams: validated, deduplicated within a watermark, appended to a store's layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import values as V


def read(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """A stream of fact files."""
    return spark.readStream.schema(V.FACT).format(form).load(path)


def valid(facts: DataFrame) -> DataFrame:
    """Row-wise invariants only: a stream cannot wait for all ids."""
    ok = F.col("fact_id").isNotNull() & (F.trim("fact_id") != "") & F.col("subject").isNotNull() & F.col("relation").isNotNull()
    ok &= F.col("confidence").between(0, 1) & (F.col("valid_end").isNull() | (F.col("valid_start").isNotNull() & (F.col("valid_end") >= F.col("valid_start"))))
    return facts.where(ok)


def once(facts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row an id within the watermark on the time of recording."""
    timed = facts.withColumn("recorded", F.col("provenance.recorded_at").cast("timestamp"))
    return timed.withWatermark("recorded", delay).dropDuplicatesWithinWatermark(["fact_id"]).drop("recorded")


def windowed_counts(facts: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Facts per context root and tumbling window of their start; late ones beyond the watermark are left out."""
    timed = facts.withColumn("at", F.col("valid_start").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", width), F.substring_index("context", ".", 2).alias("context")).agg(F.count("*").alias("n"))


def append(facts: DataFrame, path: str, checkpoint: str):
    """Start appending to Parquet; exactly once, by the sink's own log."""
    return facts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
