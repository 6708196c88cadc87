"""Evaluation: rank correlations, coverage, missing values, redundancy, exposure, return statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import shared_checkpoint
from .panel import CODE, DATE
from .ranking import running
from .sections import percentiles, places

FLAT = 1e-10


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of rows where both are set. Unlike the built-in it is null, not an error, where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def daily_correlation(df: DataFrame, x: str, y: str, least: int = 10, ranked: bool = False) -> DataFrame:
    """Cross-sectional Pearson (or rank) correlation per date; null with fewer pairs than `least` or a constant side."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = both.select(DATE, F.col(x).alias("a"), F.col(y).alias("b"))
    if ranked:
        both = percentiles(both, {"rank_a": "a", "rank_b": "b"}).select(DATE, F.col("rank_a").alias("a"), F.col("rank_b").alias("b"))
    varied = (F.stddev_pop("a") > FLAT) & (F.stddev_pop("b") > FLAT) & (F.count(F.lit(1)) >= least)
    return both.groupBy(DATE).agg(F.when(varied, correlation(F.col("a"), F.col("b"))).alias("corr"), F.count(F.lit(1)).alias("n"))


def correlation_summary(daily: DataFrame) -> DataFrame:
    size = F.abs("corr")
    return daily.agg(F.avg(size).alias("mean"), F.percentile(size, F.lit(0.9)).alias("p90"), F.max(size).alias("max"), F.count("corr").alias("days"))


def information(daily: DataFrame) -> DataFrame:
    """Mean correlation, its ratio to the sample deviation, and the number of dates."""
    sd = F.stddev_samp("corr")
    return daily.agg(F.avg("corr").alias("ic"), F.when(sd > FLAT, F.avg("corr") / sd).alias("ir"), F.count("corr").alias("days"))


def pairwise(df: DataFrame, factors: list[str], least: int = 10, ranked: bool = False) -> DataFrame:
    """Mean, 90th percentile and maximum of the absolute daily correlation of each pair of factors, or of their percentiles within the date.

    A task takes a date's cross-section at a time, codes by factors, and finds all its correlations by four products of matrices, so
    hundreds of factors are no more columns of a plan than five. Rows where one of a pair is missing are left out of that pair."""
    names = np.array(factors)
    first, second = np.triu_indices(len(names), 1)

    def daily(rows: pa.Table) -> pa.Table:
        x = np.column_stack([rows.column(c).to_numpy().astype(float) for c in factors])
        known = ~np.isnan(x)
        if ranked:
            known = ~np.column_stack([rows.column(c).is_null().to_numpy() for c in factors])  # NaN is the largest value
            for i in range(len(names)):
                x[known[:, i], i] = places(x[known[:, i], i]) / max(known[:, i].sum(), 1)
        m = known.astype(float)
        x = np.where(known, x - np.nan_to_num(np.nanmean(np.where(known.any(axis=0), x, 0.0), axis=0)), 0.0)
        n = np.maximum(m.T @ m, 1)
        sums, squares = x.T @ m, (x * x).T @ m  # of the row's factor, over rows that have the column's
        var = np.maximum(squares / n - (sums / n) ** 2, 0)
        cov = (x.T @ x) / n - (sums / n) * (sums / n).T
        sd = np.sqrt(var)
        ok = (n >= least) & (sd > FLAT) & (sd.T > FLAT)
        c = np.where(ok, cov / np.where(ok, sd * sd.T, 1), np.nan)[first, second]
        return pa.table({"a": names[first], "b": names[second], "c": pa.array(c, mask=np.isnan(c))})

    long = df.select(DATE, *[F.col(c).cast("double").alias(c) for c in factors]).groupBy(DATE).applyInArrow(daily, "a string, b string, c double")
    size = F.abs("c")
    return long.groupBy("a", "b").agg(F.avg("c").alias("mean"), F.avg(size).alias("mean_abs"), F.percentile(size, F.lit(0.9)).alias("p90_abs"), F.max(size).alias("max_abs"), F.count("c").alias("days"))


def coverage(df: DataFrame, dates: DataFrame, value: str, least: int) -> DataFrame:
    """Valid values per calendar date (0 for dates without any) and whether they fall short."""
    valid = df.where(F.col(value).isNotNull()).groupBy(DATE).agg(F.count(F.lit(1)).alias("valid"))
    return dates.select(DATE).join(valid, DATE, "left").select(DATE, F.coalesce("valid", F.lit(0)).alias("valid")).withColumn("short", F.col("valid") < least)


def missing_ratio(df: DataFrame, values: list[str], group: Column) -> DataFrame:
    """Share of nulls per group and column, and each group's worst column."""
    stacked = df.select(group.alias("grp"), F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).isNull().cast("double").alias("gone")) for v in values])).alias("x"))
    per = stacked.groupBy("grp", "x.field").agg(F.avg("x.gone").alias("missing"))
    return per.groupBy("grp").agg(F.max(F.struct("missing", "field")).alias("w")).select("grp", F.col("w.field").alias("worst_field"), F.col("w.missing").alias("worst_missing"))


def activity(df: DataFrame) -> DataFrame:
    """Last date per code, days behind the panel's last, and a bucket of that gap."""
    last = df.groupBy(CODE).agg(F.max(DATE).alias("last_date"))
    newest = last.agg(F.max("last_date").alias("newest"))
    gap = F.datediff("newest", "last_date")
    return last.join(F.broadcast(newest)).select(CODE, "last_date", gap.alias("gap_days"), F.when(gap == 0, "current").when(gap <= 5, "recent").when(gap <= 30, "stale").otherwise("inactive").alias("bucket"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def absent_everywhere(present: DataFrame, expected: DataFrame) -> DataFrame:
    """Codes that have no row on any of their expected (code, date) pairs."""
    seen = expected.join(present.select(CODE, DATE).distinct(), [CODE, DATE], "left_semi").select(CODE).distinct()
    return expected.select(CODE).distinct().join(seen, CODE, "left_anti")


def price_checks(df: DataFrame) -> DataFrame:
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return df.agg(
        count(F.col("high") < F.col("low"), "high_below_low"),
        count((F.col("close") > F.col("high") + 1e-9) | (F.col("close") < F.col("low") - 1e-9), "close_outside"),
        count(F.col("close") < 0, "negative"),
        count(F.col("volume").isNull(), "no_volume"),
        F.count(F.lit(1)).alias("n"),
    )


def checks(df: DataFrame, limits: dict[str, tuple[Column, float]]) -> DataFrame:
    """A gate as rows: name, value, limit, passed (value at most the limit)."""
    one = df.agg(*[c.cast("double").alias(n) for n, (c, _) in limits.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(float(m)).alias("most")) for n, (_, m) in limits.items()]))
    return one.select(rows.alias("x")).select("x.*", (F.col("x.value") <= F.col("x.most")).alias("passed"))


def top_mean(df: DataFrame, score: str, label: str, k: int) -> DataFrame:
    """Mean label of each date's k best scores, and their mean over dates as the total."""
    r = F.row_number().over(Window.partitionBy(DATE).orderBy(F.col(score).desc_nulls_last(), CODE))
    return df.withColumn("r", r).where(F.col("r") <= k).groupBy(DATE).agg(F.avg(label).alias("top_mean"))


def exposure(df: DataFrame, score: str, flag: Column, k: int) -> DataFrame:
    """Share of flagged among each date's k best; mean, 95th percentile, latest, and whether the guard blocks."""
    r = F.row_number().over(Window.partitionBy(DATE).orderBy(F.col(score).desc_nulls_last(), CODE))
    daily = df.withColumn("r", r).where(F.col("r") <= k).groupBy(DATE).agg(F.avg(flag.cast("double")).alias("share"))
    out = daily.agg(F.avg("share").alias("mean"), F.percentile("share", F.lit(0.95)).alias("p95"), F.max_by("share", DATE).alias("latest"))
    return out.withColumn("blocked", (F.col("mean") >= 0.05) | (F.col("p95") >= 0.15))


def middle(counts: DataFrame, value: str, name: str) -> DataFrame:
    """name: the median of `value`, each of which counts n times. One row, null without values. counts: value, n."""
    upto = running(counts.select(F.col(value).alias("value"), "n", F.col("n").alias("upto")), [], [F.col("value")], {"upto": F.col("n")})
    total = counts.agg(F.sum("n").alias("total"))  # one row
    holds = lambda at: (F.col("upto") - F.col("n") < at) & (F.col("upto") >= at)
    low, high = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    return upto.join(F.broadcast(total)).agg(((F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2).alias(name))


def robust_scale(df: DataFrame, value: str, fit: Column) -> DataFrame:
    """Median and scaled median deviation of the fit rows, applied to all, clipped at 3, nulls filled with the date's mean.

    Equal values are counted once for both; the medians are found by ranges of values, so that no task holds all of them."""
    counts = shared_checkpoint(df.where(fit & F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    centre = shared_checkpoint(middle(counts, "value", "med"))  # one row
    apart = counts.join(F.broadcast(centre)).select(F.abs(F.col("value") - F.col("med")).alias("value"), "n")
    spread = shared_checkpoint(middle(apart, "value", "mad").select((F.col("mad") * 1.4826).alias("mad")))  # one row
    z = F.try_divide(F.col(value) - F.col("med"), "mad")
    out = df.join(F.broadcast(centre)).join(F.broadcast(spread)).withColumn("z", F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-3.0)), F.lit(3.0))))
    return out.withColumn("z", F.coalesce("z", F.avg("z").over(Window.partitionBy(DATE)))).drop("med", "mad")


def nav(daily: DataFrame, ret: str) -> DataFrame:
    """Cumulative value, running maximum and drawdown of one return series (one row per day)."""
    w = Window.partitionBy(F.lit(0)).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("nav", F.product(1 + F.col(ret)).over(w))
    return out.withColumn("peak", F.max("nav").over(w)).withColumn("drawdown", F.col("nav") / F.col("peak") - 1)


def return_statistics(daily: DataFrame, ret: str, days: int = 238) -> DataFrame:
    """Annual return and information ratio, deepest drawdown, share of positive days."""
    sd = F.stddev_samp(ret)
    return nav(daily, ret).agg(
        (F.avg(ret) * days).alias("annual"),
        F.when(sd > FLAT, F.avg(ret) / sd * F.sqrt(F.lit(float(days)))).alias("ir"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col(ret) > 0).cast("double")).alias("positive_share"),
        F.count(ret).alias("days"),
    )


def degenerate(df: DataFrame, score: str, k: int) -> DataFrame:
    """Per date rows, distinct scores, and whether they are too few: fewer than min(max(3k, 20), max(n // 20, 1))."""
    daily = df.groupBy(DATE).agg(F.count(score).alias("n"), F.countDistinct(score).alias("distinct_scores"))
    return daily.withColumn("degenerate", F.col("distinct_scores") < F.least(F.lit(max(3 * k, 20)), F.greatest(F.floor(F.col("n") / 20), F.lit(1))))


def evenly_spaced(df: DataFrame, n: int, *order: str) -> DataFrame:
    """n rows at even steps of the order, first and last included. For tables of a day or code each."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    out = df.withColumn("r", F.row_number().over(w) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    step = F.when(F.col("m") > n, (F.col("m") - 1) / F.lit(n - 1.0)).otherwise(F.lit(1.0))
    return out.withColumn("k", F.round(F.col("r") / step)).where(F.floor(F.col("k") * step + 0.5) == F.col("r")).drop("r", "m", "k")


def field_coverage(df: DataFrame, fields: list[str], after_first: list[str], low: float = 0.98) -> DataFrame:
    """field, trade_date, expected, ratio, zero, low: the share of a date's rows that have the field. For fields of `after_first` (they need an
    earlier row, like a previous close) a code's first row is not expected to; a date on which nothing is expected has no ratio."""
    first = F.row_number().over(Window.partitionBy(CODE).orderBy(DATE)) == 1
    stacked = df.withColumn("first", first).select(DATE, "first", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(f in after_first).alias("exempt"), F.col(f).isNotNull().alias("there")) for f in fields])).alias("x"))
    expected = ~(F.col("first") & F.col("x.exempt"))
    of = stacked.groupBy("x.field", DATE).agg(F.count_if(expected).alias("expected"), F.count_if(expected & F.col("x.there")).alias("there"))
    ratio = F.try_divide("there", "expected")
    return of.select("field", DATE, "expected", ratio.alias("ratio"), (ratio == 0).alias("zero"), (ratio < low).alias("low"))


def replay_quality(expected: DataFrame, scores: DataFrame, score: str) -> DataFrame:
    """trade_date, expected, missing, identical: of each date's expected codes the share without a score, and of those with one the share
    that has the score of the code's previous expected date (a stale prediction). expected: code, trade_date."""
    both = expected.join(scores.select(CODE, DATE, F.col(score).alias("s")), [CODE, DATE], "left")
    before = F.lag("s").over(Window.partitionBy(CODE).orderBy(DATE))
    same = F.coalesce(F.col("s") == F.col("before"), F.lit(False))
    of = both.withColumn("before", before).groupBy(DATE).agg(F.count(F.lit(1)).alias("expected"), F.count("s").alias("n"), F.count_if(same).alias("same"))
    return of.select(DATE, "expected", (1 - F.col("n") / F.col("expected")).alias("missing"), F.try_divide("same", "n").alias("identical"))
