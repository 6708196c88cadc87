"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A derived table with at most so many rows and, written as JSON, bytes may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


#: Tables that `written` made in this session and `remove` has not removed.
WRITTEN: list[str] = []


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept. Pure ASCII text takes the faster built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, as in tests, one of our own is set, but on a local master
    only: executors elsewhere would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sedgewren-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a table of short rows: reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a table that carries texts: compressed Parquet in the shared folder, column-pruned when read."""
    path = f"{shared_folder(df.sparkSession)}/sedgewren/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables in the shared folder that no result needs any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint if a materialised table is within both bounds; otherwise the join shuffles (and AQE splits hot keys)."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose rows' sizes sum to about `most`, at least a row each: bounds what is alive at once in Python."""
    start, upto = 0, np.cumsum(sizes)
    while start < batch.num_rows:
        done = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, done + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of df has it (column names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
