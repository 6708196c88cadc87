"""Stand-in views over the star-schema tables, for Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


FEE = 1.0037
#: Lines of a task's part of the panel, about: what its sorts and windows hold does not grow with the table.
ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, lines: int, *keys: str) -> DataFrame:
    """df in as many parts by the keys as its lines need; as it is if one is enough. Adaptive execution leaves that number alone."""
    return df.repartition(part_count(df.sparkSession, lines), *keys) if lines > ROWS else df


def part_count(spark: SparkSession, lines: int) -> int:
    return max(-(-lines // ROWS), spark.sparkContext.defaultParallelism)


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """Lines of the panel, from the footers of its files."""
    return table(spark, sf_dir, "lineitem").count()


def panel(spark: SparkSession, sf_dir: str, day: Column | None = None) -> DataFrame:
    """Daily panel: a supplier is a security, its lines of one day are a bar. Prices are net of FEE, which also keeps them off the
    short decimals whose rounding engines disagree about.

    Lines go to their supplier's part once; bars and all windows along a code are found there."""
    day = (F.to_date("l_shipdate") if day is None else day).alias("trade_date")
    lines = spread(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), day, "l_extendedprice", "l_quantity", "l_discount"), line_count(spark, sf_dir), "code")
    unit = F.col("l_extendedprice") / (F.col("l_quantity") * FEE)
    bars = lines.groupBy("code", "trade_date").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
        F.sum("l_quantity").alias("volume"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        F.max("l_discount").alias("discount"),
    )
    return bars.withColumn("close", F.col("amount") / (F.col("volume") * FEE))


def week() -> Column:
    return F.to_date(F.date_trunc("week", "l_shipdate"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with a bar a week: most securities have one, so that labels and cross-sections are dense."""
    return panel(spark, sf_dir, week())


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security to region."""
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("code"), F.col("n_regionkey").alias("region")
    )


def grouped_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).join(groups(spark, sf_dir), "code")


PANEL = f"""panel AS (
    SELECT *, amount / (volume * {FEE}::DOUBLE) AS close FROM (
        SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS amount, sum(l_quantity) AS volume,
               max(l_extendedprice / (l_quantity * {FEE}::DOUBLE)) AS high, min(l_extendedprice / (l_quantity * {FEE}::DOUBLE)) AS low, max(l_discount) AS discount
        FROM lineitem GROUP BY 1, 2))"""
WEEKLY = PANEL.replace("CAST(l_shipdate AS DATE)", "CAST(date_trunc('week', l_shipdate) AS DATE)")
GROUPED = PANEL + """, grouped AS (
    SELECT p.*, n_regionkey AS region FROM panel p JOIN supplier ON code = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def cs(*more: str) -> str:
    return "OVER (PARTITION BY " + ", ".join(["trade_date", *more]) + ")"


def ts(n: int | None = None, rows: str = "") -> str:
    frame = f"ROWS BETWEEN {'UNBOUNDED' if n is None else n - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY code ORDER BY trade_date {rows or frame})"


def full(n: int, value: str) -> str:
    return f"CASE WHEN count(*) {ts(n)} = {n} THEN {value} END"


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY code ORDER BY trade_date)"


def rank(x: str, *more: str) -> str:
    by = ", ".join(["trade_date", *more])
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE)"
        f" / count({x}) OVER (PARTITION BY {by}) END"
    )


def zscore(x: str, *more: str) -> str:
    return f"CASE WHEN stddev_samp({x}) {cs(*more)} > 1e-12 THEN ({x} - avg({x}) {cs(*more)}) / stddev_samp({x}) {cs(*more)} END"
