"""Scores, gates, ranking, risk and one-day portfolio plans, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import CODE, DATE


def ramp(x: Column, zero: float, full: float) -> Column:
    """0 at `zero`, 100 at `full`, linear between and clipped; null counts as 0."""
    return F.when(x.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (x - zero) / (full - zero) * 100)))


# Fixed values of the quick score: each component's weight, and where it is worth 0 and 100.
QUICK = {"ic": (0.20, 0.0, 0.04), "ir": (0.20, 0.0, 0.50), "rank_ic": (0.10, 0.0, 0.08), "rank_ir": (0.10, 0.0, 0.75), "annual": (0.15, 0.0, 0.18), "sharpe": (0.10, 0.0, 0.65), "drawdown": (0.10, 0.40, 0.10), "turnover": (0.05, 0.60, 0.28)}
LOW_TURNOVER, LOSS_CAP = 0.10, 59.9


def quick_score(df: DataFrame) -> DataFrame:
    """score and grade of ic, ir, rank_ic, rank_ir (by size), annual, sharpe, drawdown (by size) and turnover, which is best from 10 to 28 %.

    A negative return or Sharpe ratio caps the score at 59.9 and the grade at C; a component that is null scores nothing."""
    size = {c: F.abs(c) if c in ("ic", "ir", "rank_ic", "rank_ir", "drawdown") else F.col(c) for c in QUICK}
    parts = {c: ramp(size[c], zero, full) for c, (_, zero, full) in QUICK.items()}
    parts["turnover"] = F.when(F.col("turnover") < LOW_TURNOVER, ramp(F.col("turnover"), 0.0, LOW_TURNOVER)).otherwise(parts["turnover"])
    total = sum((parts[c] * w for c, (w, _, _) in QUICK.items()), F.lit(0.0))
    loss = F.coalesce((F.col("annual") < 0) | (F.col("sharpe") < 0), F.lit(False))
    capped = F.when(loss, F.least(total, F.lit(LOSS_CAP))).otherwise(total)
    return df.withColumn("score", capped).withColumn("grade", F.when(loss & (total >= 55), "C").otherwise(grade(capped)))


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").otherwise("D")


def vetoes(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Names of the rules that hold (null counts as holding), joined by commas, and whether none does."""
    named = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("reasons", F.concat_ws(",", named)).withColumn("passed", F.size(named) == 0)


def weighted_period_score(df: DataFrame, weights: list[float], penalty: float, unit: float) -> DataFrame:
    """Rolling score: weights renormalised over the periods at hand (newest first), weighted mean less penalty times weighted deviation."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("period") + 1)
    df = df.where((F.col("period") < len(weights)) & F.col("ic").isNotNull()).withColumn("w", w)
    total, mean = F.sum("w"), F.sum(F.col("w") * F.col("ic")) / F.sum("w")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("w") * F.col("ic") * F.col("ic")) / total - mean * mean))
    return df.groupBy(CODE).agg(mean.alias("mean_ic"), ((mean - penalty * spread) / unit * 100).alias("score"), F.count(F.lit(1)).alias("periods"))


def ranked(df: DataFrame, score: str, name: str = "place") -> DataFrame:
    """Place by score, best first, ties by code, nulls last."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(DATE).orderBy(F.col(score).desc_nulls_last(), CODE)))


def top_k(df: DataFrame, score: str, k: int, ties: str = "code") -> DataFrame:
    """Each date's k best. ties: code (exactly k, by code), strict (only above the boundary), all (the whole boundary), dense."""
    best = Window.partitionBy(DATE).orderBy(F.col(score).desc_nulls_last())
    if ties == "code":
        return ranked(df.where(F.col(score).isNotNull()), score).where(F.col("place") <= k)
    if ties == "dense":
        return df.where(F.col(score).isNotNull()).withColumn("place", F.dense_rank().over(best)).where(F.col("place") <= k)
    held = df.where(F.col(score).isNotNull()).withColumn("place", F.rank().over(best))
    if ties == "all":
        return held.where(F.col("place") <= k)
    peers = held.withColumn("last", F.col("place") + F.count(F.lit(1)).over(Window.partitionBy(DATE, score)) - 1)
    return peers.where(F.col("last") <= k).drop("last")


def equal_targets(df: DataFrame, score: str, k: int, invested: float) -> DataFrame:
    return ranked(df.where(F.col(score).isNotNull()), score).where(F.col("place") <= k).withColumn("target_weight", F.lit(invested / k))


def risk_cap(df: DataFrame, weight: str, layers: dict[str, Column]) -> DataFrame:
    """Weights scaled so that a date's sum is at most the smallest layer; the binding layer is named (the first of equal ones)."""
    cap = F.least(*layers.values())
    binding = F.coalesce(*[F.when(c == cap, F.lit(n)) for n, c in layers.items()])
    total = F.sum(weight).over(Window.partitionBy(DATE))
    share = F.least(F.lit(1.0), F.try_divide(cap, total))
    return df.withColumn("capped", F.col(weight) * F.coalesce(share, F.lit(1.0))).withColumn("binding", binding)


def dropout_plan(scores: DataFrame, holdings: DataFrame, k: int, drop: int) -> DataFrame:
    """One day's plan: of the holdings and the best newcomers ranked together, the worst `drop` holdings outside the top are sold and
    as many newcomers bought as make k. Missing scores rank last. scores: code, score; holdings: code."""
    n_held = holdings.select(CODE).distinct().count()  # one number
    both = scores.join(holdings.select(CODE).distinct().withColumn("held", F.lit(True)), CODE, "full_outer").select(CODE, F.coalesce("score", F.lit(-1e30)).alias("score"), F.coalesce("held", F.lit(False)).alias("held"))
    # The newcomers that could be bought are few; with the holdings they are the pool, which one window ranks.
    fresh = both.where("NOT held").orderBy(F.col("score").desc(), CODE).limit(drop + max(0, k - n_held))
    pool = both.where("held").unionByName(fresh).withColumn("in_kind", F.row_number().over(Window.partitionBy("held").orderBy(F.col("score").desc(), CODE)))
    pool = pool.withColumn("from_end", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("score", F.col(CODE).desc())))
    sold = F.col("held") & (F.col("from_end") <= drop)
    n_sold = F.count_if(sold).over(Window.partitionBy(F.lit(0)))
    bought = ~F.col("held") & (F.col("in_kind") <= n_sold + k - n_held)
    return pool.select(CODE, "score", F.when(sold, "sell").when(bought, "buy").when(F.col("held"), "hold").alias("action")).where("action is not null")


def order_preview(targets: DataFrame, holdings: DataFrame, capital: float, lot: int = 100) -> DataFrame:
    """Whole lots per target weight against what is held. targets: code, weight, price; holdings: code, amount."""
    both = targets.join(holdings, CODE, "full_outer")
    want = F.coalesce(F.floor(F.try_divide(F.col("weight") * capital, F.col("price")) / lot) * lot, F.lit(0)).cast("long")
    have = F.coalesce("amount", F.lit(0)).cast("long")
    return both.select(CODE, want.alias("want"), have.alias("have"), F.when(want > have, "buy").when(want < have, "sell").when(want > 0, "hold").otherwise("ignore").alias("action"), (F.abs(want - have) * F.col("price")).alias("notional"))


def hysteresis(daily: DataFrame, hot: Column, enter: int = 2, leave: int = 3) -> DataFrame:
    """A state that begins after `enter` hot days in a row and ends after `leave` others: the last begin or end event is carried on.

    Streaks are found as gaps and islands. For one market series, a row per day."""
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)
    df = daily.withColumn("hot", F.coalesce(hot, F.lit(False)))
    df = df.withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy("hot").orderBy(DATE)))
    df = df.withColumn("streak", F.row_number().over(Window.partitionBy("hot", "island").orderBy(DATE)))
    event = F.when(F.col("hot") & (F.col("streak") >= enter), True).when(~F.col("hot") & (F.col("streak") >= leave), False)
    on = F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("on", F.coalesce(on, F.lit(False))).drop("island")


def breadth(daily: DataFrame, series: list[str], days: int = 238) -> DataFrame:
    """Log returns over 20 and 60 rows averaged over the series, and the greater of their 20- and 60-row volatilities."""
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)
    move = lambda s, n: F.log(F.col(s) / F.lag(s, n).over(w))
    mean = lambda cs: sum(cs[1:], cs[0]) / len(cs)
    df = daily.withColumn("m1", mean([move(s, 1) for s in series])).withColumn("m20", mean([move(s, 20) for s in series])).withColumn("m60", mean([move(s, 60) for s in series]))
    sd = lambda n: F.stddev_samp("m1").over(w.rowsBetween(-(n - 1), 0)) * F.sqrt(F.lit(float(days)))
    return df.withColumn("composite", (F.col("m20") + F.col("m60")) / 2).withColumn("volatility", F.greatest(sd(20), sd(60)))


def cost_shares(df: DataFrame, cost: str, value: str) -> DataFrame:
    """A date's cost dealt to its trades by traded value."""
    return df.withColumn("cost_share", F.col(cost) * F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(DATE))))


def contributions(df: DataFrame) -> DataFrame:
    """Amount times price change per holding and day, by code with its share of the total."""
    w = Window.partitionBy(CODE).orderBy(DATE)
    moved = df.withColumn("gain", F.lag("volume").over(w) * (F.col("close") - F.lag("close").over(w)))
    per = moved.groupBy(CODE).agg(F.sum("gain").alias("gain"))
    total = per.agg(F.sum("gain").alias("total"))
    return per.join(F.broadcast(total)).select(CODE, "gain", F.try_divide("gain", "total").alias("share"))


def neutral_residual(df: DataFrame, y: str, x: str) -> DataFrame:
    """Residual of a per-date regression of y on x."""
    w = Window.partitionBy(DATE)
    slope = F.covar_pop(F.col(y), F.col(x)).over(w) / F.nullif(F.var_pop(F.col(x)).over(w), F.lit(0.0))
    return df.withColumn("residual", F.col(y) - F.avg(y).over(w) - slope * (F.col(x) - F.avg(x).over(w)))
