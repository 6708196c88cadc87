"""Forward labels, sample weights and walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import CODE, DATE, calendar


def forward_label(df: DataFrame, price: str, horizon: int, shift: int = 1, days: DataFrame | None = None, keep: Sequence[str] = (), single: bool = False) -> DataFrame:
    """price at calendar position T+shift+horizon over that at T+shift, less 1; null where the code did not trade on either day. days: the calendar
    (cal_idx, trade_date), if it is known; keep: more columns of df, or cal_idx; single: df has no two rows of a code and day.

    Ranges of one calendar position find both prices within one sort by code, instead of joins of the panel with itself or a dense grid."""
    at = df.join(F.broadcast(calendar(df) if days is None else days), DATE)  # a row a day
    if single:  # the row of a position n later is one of the next n rows, in the order that other windows along codes have too
        w = Window.partitionBy(CODE).orderBy(DATE)
        later = lambda n: F.coalesce(*[F.when(F.lead("cal_idx", k).over(w) == F.col("cal_idx") + n, F.lead(price, k).over(w)) for k in range(1, n + 1)])
        return at.select(CODE, DATE, *keep, (F.try_divide(later(shift + horizon), later(shift)) - 1).alias("label"))
    then = lambda days: F.max(price).over(Window.partitionBy(CODE).orderBy("cal_idx").rangeBetween(days, days))
    return at.select(CODE, DATE, *keep, (F.try_divide(then(shift + horizon), then(shift)) - 1).alias("label"))


def executable(label: Column, entry: Column, up_limit: Column) -> Column:
    """The label, or zero where the entry price is at the upper limit."""
    return F.when(F.coalesce(entry >= up_limit - 1e-6, F.lit(False)), 0.0).otherwise(label)


def rank_weights(df: DataFrame, score: str, ends: int, most: float = 3.0) -> DataFrame:
    """Linear ramps from `most` to 1 over the top and the bottom `ends` ranks of each date, the greater of both, with mean 1."""
    top = F.row_number().over(Window.partitionBy(DATE).orderBy(F.col(score).desc_nulls_last(), CODE))
    low = F.row_number().over(Window.partitionBy(DATE).orderBy(F.col(score).asc_nulls_last(), CODE))
    ramp = lambda r: F.when(r <= ends, most - (most - 1) * (r - 1) / ends).otherwise(1.0)
    df = df.withColumn("raw", F.greatest(ramp(top), ramp(low)))
    return df.withColumn("weight", F.col("raw") / F.avg("raw").over(Window.partitionBy(DATE))).drop("raw")


def grades(df: DataFrame, score: str) -> DataFrame:
    """4, 3, 2 for the first 5, 10, 20 of a date, 1 for the rest of its best fifth, else 0."""
    r = F.row_number().over(Window.partitionBy(DATE).orderBy(F.col(score).desc_nulls_last(), CODE))
    n = F.count(F.lit(1)).over(Window.partitionBy(DATE))
    return df.withColumn("grade", F.when(r <= 5, 4).when(r <= 10, 3).when(r <= 20, 2).when(r <= n * 0.2, 1).otherwise(0))


def floor_fill(df: DataFrame, value: str) -> DataFrame:
    """Nulls become the date's minimum less 0.1 % of its spread, or the same over all dates where a date has none."""
    w, every = Window.partitionBy(DATE), df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    floor = lambda lo, hi: lo - 0.001 * (hi - lo)
    df = df.join(F.broadcast(every.select(floor(F.col("lo"), F.col("hi")).alias("global_floor"))))
    return df.withColumn("filled", F.coalesce(value, floor(F.min(value).over(w), F.max(value).over(w)), "global_floor")).drop("global_floor")


def folds(dates: DataFrame, n: int, test_days: int, purge: int) -> DataFrame:
    """Expanding walk-forward: fold k tests the k-th of the last n blocks of test_days; training ends `purge` days before it."""
    last = dates.agg(F.max("cal_idx").alias("m"))
    base = last.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("fold"), "m")
    begin = F.col("m") + 1 - (n - F.col("fold")) * test_days
    plan = base.select("fold", begin.alias("test_from"), (begin + test_days - 1).alias("test_to"), (begin - purge - 1).alias("train_to"))
    return dates.join(F.broadcast(plan), F.col("cal_idx") <= F.col("test_to")).select(
        "fold", DATE, F.when(F.col("cal_idx") <= F.col("train_to"), "train").when(F.col("cal_idx") >= F.col("test_from"), "test").otherwise("purged").alias("part")
    )
