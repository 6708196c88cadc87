"""Event streams: watermarked windows, sessions, tail replacement in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_checkpoint


def read_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per window and type; events later than `late` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str, step: str) -> DataFrame:
    out = events.groupBy(F.window("ts", length, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """A user's events with at most `gap` between them."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def counter_delta(events: DataFrame, counter: str, cutoff: str) -> DataFrame:
    """Per user the counter's last value less its last value at or before the cutoff (0 without one)."""
    at = F.to_timestamp(F.lit(cutoff))
    before = F.max_by(F.when(F.col("ts") <= at, F.col(counter)), F.when(F.col("ts") <= at, F.col("ts")))
    return events.groupBy("user_id").agg((F.max_by(counter, "ts") - F.coalesce(before, F.lit(0))).alias("delta"))


def upsert_days(path: str, key: list[str], order: str):
    """A foreachBatch function: the batch's days are rewritten with the last row per key of what was there and the batch, of equal
    `order` values the one with the greatest values. What was there is kept aside in the shared folder while it is overwritten."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("day", F.to_date("ts"))
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        first = not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        there = batch.limit(0) if first else spark.read.parquet(path)
        both = there.join(batch.select("day").distinct(), "day", "left_semi").unionByName(batch)
        values = [c for c in both.columns if c not in (*key, "day")]
        latest = both.groupBy("day", *key).agg(F.max(F.struct(order, *[c for c in values if c != order])).alias("v")).select("day", *key, "v.*")
        shared_checkpoint(latest).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return write
