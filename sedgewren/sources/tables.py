"""Readers and writers: column-tolerant scans, staged writes, tail replacement, keyed overwrite, calendar export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import shared_checkpoint


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Parquet with the wanted columns that exist, NaN read as null; predicate and projection reach the scan."""
    df = spark.read.parquet(path)
    if predicate is not None:
        df = df.where(predicate)
    df = df.select(*[c for c in (columns or df.columns) if c in df.columns])
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order: missing ones null, others cast leniently, unknown ones dropped."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def validated_targets(df: DataFrame) -> DataFrame:
    """Faults of a target list as rows: repeated codes, negative weights, a sum above 1."""
    repeated = df.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated").alias("fault"), F.col("code").cast("string").alias("detail"))
    negative = df.where("weight < 0").select(F.lit("negative").alias("fault"), F.col("code").cast("string").alias("detail"))
    total = df.agg(F.sum("weight").alias("s")).where("s > 1 + 1e-9").select(F.lit("sum").alias("fault"), F.round("s", 6).cast("string").alias("detail"))
    return repeated.unionByName(negative).unionByName(total)


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_file: int = 100_000) -> None:
    """One shuffle by partition key, bounded files."""
    df.repartition(*by).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that df has: late and corrected rows rewrite their own months."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, key range and an order-free content hash (the sum of 60 bits of each row's MD5), to skip work whose input is unchanged."""
    text = lambda c: F.col(c).cast("string")  # noqa: E731  each with its length, so that no value looks like another or like a null
    row = F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in df.columns])
    content = F.sum(F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.min(k).alias(f"min_{k}") for k in keys], *[F.max(k).alias(f"max_{k}") for k in keys], content.alias("content"))


def partitions_of(spark: SparkSession, path: str, column: str, values: list) -> DataFrame:
    """A partitioned table's rows of these partitions; others are not listed as files to read."""
    return spark.read.parquet(path).where(F.col(column).isin(values))


def truncated(path: str, by: str, date: str, boundary: Column, spark: SparkSession) -> None:
    """Drops rows at or after the boundary: only partitions that have any are rewritten, and those left empty are removed."""
    df = spark.read.parquet(path)
    touched = df.where(F.col(date) >= boundary).select(by).distinct()
    kept = df.join(F.broadcast(touched), by, "left_semi").withColumn("late", F.col(date) >= boundary)
    emptied = [r[0] for r in kept.groupBy(by).agg(F.min("late").alias("all_late")).where("all_late").select(by).collect()]  # names of partitions
    rest = shared_checkpoint(kept.where("NOT late").drop("late"))  # kept aside while the table is overwritten
    overwrite_partitions(rest, path, [by])
    for value in emptied:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stale_keys(source: DataFrame, target: DataFrame, key: str, date: str) -> DataFrame:
    """Keys whose target is missing or older than the source, with both dates: what an incremental build has to convert."""
    s = source.groupBy(key).agg(F.max(date).alias("source_date"))
    t = target.groupBy(key).agg(F.max(date).alias("target_date"))
    return s.join(t, key, "left").where(F.col("target_date").isNull() | (F.col("target_date") < F.col("source_date")))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, so that `read_csv` of the same schema gives the rows back."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def first_available(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """Each output column from the first of its candidates that the table has, null if it has none."""
    return df.select(*[next((F.col(c) for c in cs if c in df.columns), F.lit(None)).alias(out) for out, cs in candidates.items()])


def lenient_date(c: Column) -> Column:
    """Days as 2024-01-31, 20240131 or 2024/1/31; null for anything else."""
    plain = F.regexp_replace(F.trim(c.cast("string")), "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    return F.to_date(F.try_to_timestamp(F.regexp_replace(plain, "/", "-"), F.lit("yyyy-M-d")))


def warm_up(start: Column, days: int = 400) -> Column:
    """The first day to read so that long windows are full at `start`."""
    return F.date_sub(start, days)
