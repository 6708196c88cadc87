"""Consolidation with receipts: a partition is rebuilt only where its input has changed.

A receipt says for each partition how many rows its input had, their key range and an order-free hash of their contents, and the same of
what was written. Receipts lie beside the table, a file for each run; a partition's last one counts. The data is written before the
receipt: a run that dies in between leaves partitions without one, and the next run builds them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import shared_checkpoint
from .tables import overwrite_partitions

ABSENT = "absent"


def content(df: DataFrame) -> Column:
    """Order-free hash of rows: the sum of 60 bits of each row's MD5 over its columns as a structure, so that nulls and shifted values differ."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return F.sum(F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)"))


def prints(df: DataFrame, by: str, key: str, side: str) -> DataFrame:
    """by (as text), and rows, least and greatest key, and content of each partition."""
    return df.groupBy(F.col(by).cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias(f"{side}_rows"), F.min(key).cast("string").alias(f"{side}_least"), F.max(key).cast("string").alias(f"{side}_most"), content(df).cast("string").alias(f"{side}_content")
    )


def receipts(spark: SparkSession, path: str) -> DataFrame | None:
    """The last receipt of each partition; None before the first run."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}_receipts")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    w = Window.partitionBy("part").orderBy(F.col("run").desc())
    return spark.read.parquet(f"{path}_receipts").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def consolidate(df: DataFrame, path: str, by: str, key: str, build: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Writes build(df) to the table at path, partitioned by `by` (not null), and returns a row a partition: part, action.

    action: built (no receipt yet), rebuilt (input or output differs from the receipt), kept, removed (no input any more). Only built and
    rebuilt partitions are read beyond their fingerprints and written; build must leave rows in their partition."""
    spark, before = df.sparkSession, receipts(df.sparkSession, path)
    now = shared_checkpoint(prints(df, by, key, "in"))
    names = [c for c in now.columns if c != "part"]
    if before is None:
        changed, gone = now.select("part", F.lit("built").alias("action")), None
        run = 0
    else:
        before = shared_checkpoint(before)
        run = (before.agg(F.max("run")).first()[0] or 0) + 1
        known = before.where(F.col("in_rows") > 0).select("part", F.struct(*names).alias("was"), F.struct("out_rows", "out_least", "out_most", "out_content").alias("made"))
        there = prints(spark.read.parquet(path), by, key, "out").select("part", F.struct("out_rows", "out_least", "out_most", "out_content").alias("is"))
        seen = now.select("part", F.struct(*names).alias("now")).join(known, "part", "full_outer").join(there, "part", "left")
        action = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "built").when(F.col("now").eqNullSafe(F.col("was")) & F.col("made").eqNullSafe(F.col("is")), "kept").otherwise("rebuilt")
        changed = seen.select("part", action.alias("action"))
        gone = [r.part for r in changed.where("action = 'removed'").collect()]  # names of partitions
    actions = shared_checkpoint(changed)
    todo = actions.where(F.col("action").isin("built", "rebuilt")).select(F.col("part").alias("todo"))
    if not todo.isEmpty():
        made = build(df.join(todo, F.col(by).cast("string") == F.col("todo"), "left_semi"))
        overwrite_partitions(made, path, [by])
        out = prints(spark.read.parquet(path).join(todo, F.col(by).cast("string") == F.col("todo"), "left_semi"), by, key, "out")
        told = now.join(todo, F.col("part") == F.col("todo"), "left_semi").join(out, "part", "left").withColumn("run", F.lit(run).cast("long"))
        told.write.mode("append").parquet(f"{path}_receipts")
    for part in gone or ():
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={part}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if gone:
        ended = actions.where("action = 'removed'").select("part", *[F.lit(None).cast(now.schema[c].dataType).alias(c) if c != "in_rows" else F.lit(0).cast("long").alias(c) for c in names])
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("out_rows", "long"), ("out_least", "string"), ("out_most", "string"), ("out_content", "string"))]
        ended.select("*", *empty, F.lit(run).cast("long").alias("run")).write.mode("append").parquet(f"{path}_receipts")
    return actions


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder."""
    from ..operators.graph import shared_folder

    return f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"
