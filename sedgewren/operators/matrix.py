"""Feature matrices: many facts by key, long factor values to columns, labels, missing-value policies, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import CODE, DATE
from .sections import percentiles


def with_facts(base: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """base with the columns of each fact table, left-joined by code and date and named fact_column. One row of a repeated key is
    taken (the greatest), so that base's rows stay one to one; tables that share the partitioning of the keys are not shuffled again."""
    out = base
    for name, fact in facts.items():
        values = [c for c in fact.columns if c not in (CODE, DATE)]
        one = fact.groupBy(CODE, DATE).agg(F.max(F.struct(*values)).alias("v")).select(CODE, DATE, *[F.col(f"v.{c}").alias(f"{name}_{c}") for c in values])
        out = out.join(one, [CODE, DATE], "left")
    return out


def feature_matrix(values: DataFrame, names: list[str], labels: DataFrame) -> DataFrame:
    """A row per code and date that any chosen factor has, a column per factor, and the label where there is one. values: factor, code,
    trade_date, value. One grouping instead of an outer join per factor."""
    wide = values.where(F.col("factor").isin(names)).groupBy(CODE, DATE).pivot("factor", names).agg(F.max("value"))
    return wide.join(labels, [CODE, DATE], "left")


def upsert_column(values: DataFrame, factor: str, new: DataFrame) -> DataFrame:
    """The long store with one factor's values replaced."""
    return values.where(F.col("factor") != factor).unionByName(new.select(F.lit(factor).alias("factor"), CODE, DATE, "value"))


#: Policies for missing values of a feature: left to the model's own processing, zero where absence means none, below the day's least.
NEUTRAL, ZERO, FLOOR = "neutral", "structural_zero", "floor"


def fill_missing(df: DataFrame, policies: dict[str, str]) -> DataFrame:
    """df with each column's missing values by its policy. Floors of all columns come from one aggregate by date and one over all dates."""
    for policy in policies.values():
        if policy not in (ZERO, FLOOR, NEUTRAL):
            raise ValueError(f"no policy {policy}")
    floored = [c for c, policy in policies.items() if policy == FLOOR]
    filled = {c: F.coalesce(c, F.lit(0.0)) for c, policy in policies.items() if policy == ZERO}
    if floored:
        floor = lambda c: F.min(c) - 0.001 * (F.max(c) - F.min(c))
        names = {c: f"floor_{i}" for i, c in enumerate(floored)}
        daily = df.groupBy(F.col(DATE).alias("floor_date")).agg(*[floor(c).alias(n) for c, n in names.items()])
        whole = df.agg(*[floor(c).alias(f"all_{n}") for c, n in names.items()])  # one row
        joined = df.join(daily, F.col(DATE).eqNullSafe(F.col("floor_date"))).join(F.broadcast(whole))
        filled |= {c: F.coalesce(c, n, f"all_{n}") for c, n in names.items()}
        return joined.withColumns(filled).select(*df.columns)
    return df.withColumns(filled)


def missing_report(df: DataFrame, columns: list[str], segment: Column) -> DataFrame:
    """Rows, nulls and share of nulls of each column in each segment."""
    stacked = df.select(segment.alias("segment"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).isNull().cast("long").alias("gone")) for c in columns])).alias("x"))
    return stacked.groupBy("segment", "x.field").agg(F.count(F.lit(1)).alias("n"), F.sum("x.gone").alias("gone"), F.avg("x.gone").alias("share"))


def flat_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that say nothing: all null, or one value only (told by minimum and maximum, without a distinct count)."""
    one = df.agg(*[F.count(c).alias(f"n_{c}") for c in columns], *[F.min(c).cast("double").alias(f"lo_{c}") for c in columns], *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (F.col(f"n_{c}") == 0).alias("all_null"), F.coalesce(F.col(f"lo_{c}") == F.col(f"hi_{c}"), F.lit(False)).alias("constant")) for c in columns]))
    return one.select(rows.alias("x")).select("x.*").where("all_null OR constant")


def label_zscore(df: DataFrame, label: str) -> DataFrame:
    """A date's labels standardised; zero where they are all alike."""
    w = Window.partitionBy(DATE)
    sd = F.stddev_pop(label).over(w)
    return df.withColumn("label_z", F.when(F.col(label).isNotNull(), F.when(sd > 0, (F.col(label) - F.avg(label).over(w)) / sd).otherwise(0.0)))


def focus_weights(grade: Column) -> Column:
    """Sample weights of relevance grades: the best count double, the next one and a half."""
    return F.when(grade == 4, 2.0).when(grade == 3, 1.5).otherwise(1.0)


def style_flags(df: DataFrame) -> DataFrame:
    """Cross-sectional styles of total_mv, float_mv, roe, eps_growth, profit_growth: small cap (lowest fifth by either size), high growth
    (best fifth by the greatest of three ranks), blue chip (highest fifth by size and 0.6 by return on equity)."""
    df = percentiles(df, {f"{c}_pct": c for c in ("total_mv", "float_mv", "roe", "eps_growth", "profit_growth")})
    yes = lambda c: F.coalesce(c, F.lit(False))
    small = yes(F.col("total_mv_pct") <= 0.2) | yes(F.col("float_mv_pct") <= 0.2)
    growth = F.greatest("eps_growth_pct", "profit_growth_pct", "roe_pct")
    blue = (yes(F.col("total_mv_pct") >= 0.8) | yes(F.col("float_mv_pct") >= 0.8)) & yes(F.col("roe_pct") >= 0.6)
    return df.withColumns({"small_cap": small, "high_growth": yes(growth >= 0.8), "blue_chip": blue})


def style_exposure(picks: DataFrame, styles: DataFrame, flags: list[str]) -> DataFrame:
    """Per date the picks, those with a known style, and the share of each flag among these."""
    both = picks.join(styles.select(CODE, DATE, *flags, F.lit(True).alias("known")), [CODE, DATE], "left")
    return both.groupBy(DATE).agg(F.count(F.lit(1)).alias("picks"), F.count("known").alias("known"), *[F.avg(F.col(f).cast("double")).alias(f) for f in flags])
