"""Streaming counterparts of the framed operators, for event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding(events: DataFrame, ts: str, key: str, value: str, size: str = "30 minutes", hop: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Root mean square of a value in sliding windows; rows later than the watermark are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    w = F.window("_ts", size, hop)
    return timed.groupBy(w.alias("w"), key).agg(F.sqrt(F.avg(F.col(value) * F.col(value)) + 1e-12).alias("rms"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rms", "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of a key without a pause of ``gap``."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_state(batch: DataFrame, store: str, keys: list[str]) -> None:
    """``foreachBatch`` sink for stage states: a batch is a table of its own, so that delivering it again overwrites it with itself."""
    batch.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    batch.dropDuplicates(keys).write.mode("overwrite").partitionBy("batch").parquet(store)
