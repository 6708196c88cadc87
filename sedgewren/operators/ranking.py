"""Ranks, positions and running sums over whole tables and hot keys, without a window that holds one key's rows.

A window function gives each key to one task. Here rows are range-partitioned by key and order instead: a task sorts its own range, and
what lies before a range is the sum of a small table with one row for each range (or each key and range).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import shared_checkpoint

PIECE = "range_piece"


def ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with PIECE, the number of its range by `order`. Rows that are equal in the order lie in one range. Cut, so that ranges stay."""
    return shared_checkpoint(df.repartitionByRange(*order).withColumn(PIECE, F.spark_partition_id()))


def before(pieces: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums of a key's earlier ranges. pieces: keys, PIECE and sums, one row a key and range; only keys that reach over a range's edge are
    in the result, at most two of them a range, so that it may be broadcast."""
    spread = pieces.groupBy(*keys).agg(F.collect_list(F.struct(PIECE, *sums)).alias("all")).where(F.size("all") > 1)  # a number of ranges at most
    wide = spread.select(*keys, F.explode("all").alias("x")).select(*keys, "x.*")
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    return wide.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col(PIECE).alias("of_piece"), *[F.sum(s).over(w).alias(f"before_{s}") for s in sums]).where(F.col(f"before_{sums[0]}").isNotNull())


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums by key along `order`, the row itself included; nulls count as zero. Null keys are a key like any other.

    Rows of one key that are equal in the order are summed one after the other, in any order."""
    work = ranges(df.withColumns({n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}), *keys, *order)
    pieces = work.groupBy(*keys, PIECE).agg(*[F.sum(n).alias(n) for n in sums])
    carry = before(pieces, keys, list(sums))
    w = Window.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col(PIECE) == F.col("of_piece")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    local = work.withColumns({n: F.sum(n).over(w) for n in sums})
    out = local.join(F.broadcast(carry), same, "left")
    return out.select(*[F.col(c) for c in df.columns if c not in sums], *[(F.col(n) + F.coalesce(f"before_{n}", F.lit(0))).alias(n) for n in sums])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with each row's number from 1 in its key's order."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """value, n (its rows), below (rows with a smaller value) for each distinct value that is set. NaN is the largest value.

    Equal values are counted before they are shuffled; the distinct ones are summed range by range."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    summed = running(counts.withColumn("upto", F.col("n")), [], [F.col("value")], {"upto": F.col("n")})
    return summed.select("value", "n", (F.col("upto") - F.col("n")).alias("below"))


def global_rank(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """df with rank_<value> for each of `values`: the place among all rows where it is set, from 1, equal values at their mean place; null
    stays null. Values meet their ranks by an equi-join, whose hot keys Spark splits."""
    for v in values:
        ranks = shared_checkpoint(value_ranks(df, v))
        named = ranks.select(F.col("value").alias("rank_value"), (F.col("below") + (F.col("n") + 1) / 2).alias(f"rank_{v}"))
        df = df.join(named, F.col(v) == F.col("rank_value"), "left").drop("rank_value")
    return df


def dense_names(keys: DataFrame, rows: int) -> DataFrame:
    """keys (distinct rows, none null) with a name each: 0, 1, 2, ... without gaps.

    Keys are numbered within hash buckets of about 100,000, and a bucket begins where the ones before it end: the numbers depend on the
    keys alone, so that a task that runs again gives the same."""
    names = keys.columns
    cut = keys.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(1 + rows // 100_000)))
    offsets = cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("offset"))  # a row a bucket
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*names)) - 1
    return cut.withColumn("place", place).join(F.broadcast(offsets), "bucket").select(*names, (F.col("place") + F.col("offset")).alias("name"))
