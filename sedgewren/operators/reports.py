"""Reports and audits over panels, series and plans: agreement, dispersion, concentration, ties, continuity, calendar positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factor import rank
from .evaluate import correlation
from .panel import CODE, DATE
from .sections import percentiles


def seed_agreement(scores: DataFrame, least: int = 10) -> DataFrame:
    """Mean daily rank correlation of each pair of seeds. scores: seed, code, trade_date, score."""
    ranks = scores.where(F.col("score").isNotNull()).withColumn("r", rank(F.col("score"), "seed")).select("seed", CODE, DATE, "r")
    pairs = ranks.withColumnsRenamed({"seed": "a", "r": "x"}).join(ranks.withColumnsRenamed({"seed": "b", "r": "y"}), [CODE, DATE]).where("a < b")
    daily = pairs.groupBy("a", "b", DATE).agg(F.when(F.count(F.lit(1)) >= least, correlation(F.col("x"), F.col("y"))).alias("corr"))
    return daily.groupBy("a", "b").agg(F.avg("corr").alias("agreement"), F.count("corr").alias("days"))


def rank_baseline(df: DataFrame, features: list[str]) -> DataFrame:
    """Equal-weight mean of a row's cross-sectional percentile ranks; missing ones are left out."""
    names = [f"rank_{c}" for c in features]
    ranks, kept = [F.col(n) for n in names], df.columns
    known = sum((r.isNotNull().cast("int") for r in ranks[1:]), ranks[0].isNotNull().cast("int"))
    mean = F.try_divide(sum((F.coalesce(r, F.lit(0.0)) for r in ranks[1:]), F.coalesce(ranks[0], F.lit(0.0))), known)
    return percentiles(df, dict(zip(names, features))).select(*kept, mean.alias("baseline"))


def dispersion(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population deviation, median and range within each key."""
    return df.groupBy(*keys).agg(F.stddev_pop(value).alias("deviation"), F.median(value).alias("median"), (F.max(value) - F.min(value)).alias("spread"))


def concentration(daily: DataFrame, ret: str, top: int = 5, outlier: float = 12.0) -> DataFrame:
    """Share of the positive sum that the `top` best days make, positive days, and days beyond `outlier` medians of the absolute."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(ret).desc_nulls_last(), DATE)
    placed = daily.withColumn("place", F.row_number().over(w)).withColumn("median_abs", F.median(F.abs(ret)).over(Window.partitionBy(F.lit(0))))
    gain = F.greatest(F.col(ret), F.lit(0.0))
    return placed.agg(
        F.try_divide(F.sum(F.when(F.col("place") <= top, gain)), F.sum(gain)).alias("top_share"),
        F.avg((F.col(ret) > 0).cast("double")).alias("positive_share"),
        F.count_if(F.abs(ret) > outlier * F.col("median_abs")).alias("outliers"),
    )


def score_shape(df: DataFrame, score: str, most: float = 50.0) -> DataFrame:
    """Deviation, 99th percentile and median of the absolute scores per date, and whether the tail is out of proportion."""
    size = F.abs(score)
    out = df.groupBy(DATE).agg(F.stddev_samp(score).alias("deviation"), F.percentile(size, F.lit(0.99)).alias("p99"), F.median(size).alias("median"))
    return out.withColumn("heavy", F.col("p99") > F.col("median") * most)


def tie_evidence(df: DataFrame, score: str, k: int) -> DataFrame:
    """Per date the k-th best score, how many are above it, how many share it, and how many of those fit."""
    best = Window.partitionBy(DATE).orderBy(F.col(score).desc())
    placed = df.where(F.col(score).isNotNull()).withColumn("row", F.row_number().over(best))
    boundary = F.max(F.when(F.col("row") == k, F.col(score))).over(Window.partitionBy(DATE))
    held = placed.withColumn("boundary", boundary).groupBy(DATE).agg(
        F.first("boundary").alias("boundary"), F.count_if(F.col(score) > F.col("boundary")).alias("above"), F.count_if(F.col(score) == F.col("boundary")).alias("tied")
    )
    return held.where(F.col("boundary").isNotNull()).withColumn("slots", F.lit(k) - F.col("above"))


def missing_dates(dates: DataFrame, df: DataFrame, value: str) -> DataFrame:
    """Dates on which no row has the value."""
    return dates.select(DATE).join(df.where(F.col(value).isNotNull()).select(DATE).distinct(), DATE, "left_anti")


def continuity(daily: DataFrame, account: str, ret: str, tolerance: float = 1e-10) -> DataFrame:
    """Days whose account change is not the reported return. One series, a row per day."""
    before = F.lag(account).over(Window.partitionBy(F.lit(0)).orderBy(DATE))
    residual = F.try_divide(F.col(account), before) - 1 - F.col(ret)
    return daily.withColumn("residual", residual).where(F.abs("residual") > tolerance)


def integrity(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, repeated keys, nulls and non-finite values of a report."""
    x = F.col(value)
    return df.agg(
        F.count(F.lit(1)).alias("n"), (F.count(key) - F.countDistinct(key)).alias("repeated"), F.count_if(x.isNull()).alias("nulls"), F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("not_finite")
    )


def frequent_members(df: DataFrame, group: str, members: Column, least: float) -> DataFrame:
    """Members that at least this share of a group's rows have."""
    rows = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    found = df.select(group, F.explode(F.array_distinct(members)).alias("member")).groupBy(group, "member").agg(F.count(F.lit(1)).alias("having"))
    return found.join(rows, group).withColumn("share", F.col("having") / F.col("n")).where(F.col("share") >= least).select(group, "member", "having", "share")


def growth(df: DataFrame, value: str, rows: int = 252) -> DataFrame:
    """Change against the value so many rows earlier, where that is positive."""
    base = F.lag(value, rows).over(Window.partitionBy(CODE).orderBy(DATE))
    return df.withColumn("growth", F.when(base > 0, F.col(value) / base - 1))


def rolling_drawdown(df: DataFrame, value: str, rows: int = 60) -> DataFrame:
    high = F.max(value).over(Window.partitionBy(CODE).orderBy(DATE).rowsBetween(-(rows - 1), 0))
    return df.withColumn("drawdown", F.col(value) / high - 1)


def thinned(daily: DataFrame, most: int) -> DataFrame:
    """Every n-th row of a series counted from its last, at most `most` rows."""
    w = Window.partitionBy(F.lit(0))
    out = daily.withColumn("back", F.row_number().over(w.orderBy(F.col(DATE).desc())) - 1).withColumn("step", F.ceil(F.count(F.lit(1)).over(w) / most))
    return out.where(F.col("back") % F.col("step") == 0).drop("back", "step")


def next_session(df: DataFrame, day: Column, dates: DataFrame) -> DataFrame:
    """on_after and following: the first calendar date at or after `day`, and the one after that. The calendar has a row per date."""
    after = F.lead(DATE).over(Window.partitionBy(F.lit(0)).orderBy(DATE))
    spans = dates.select(DATE).distinct().withColumn("following", after).withColumn("from", F.lag(DATE).over(Window.partitionBy(F.lit(0)).orderBy(DATE)))
    keyed = df.select(day.alias("day")).distinct()
    # Each date answers for the days since the one before it.
    owned = spans.select(DATE, "following", F.explode(F.sequence(F.coalesce(F.date_add("from", 1), F.col(DATE)), F.col(DATE))).alias("owned_day"))
    found = keyed.join(owned, F.col("day") == F.col("owned_day")).select("day", F.col(DATE).alias("on_after"), "following")
    return df.withColumn("day", day).join(found, "day", "left")


def seeded_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n codes by the order of MD5(seed:code): the same whatever the partitioning."""
    codes = df.select(CODE).distinct().withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(CODE).cast("string")).cast("binary")))
    return df.join(codes.orderBy("key").limit(n).select(CODE), CODE, "left_semi")


def pooled_correlation(df: DataFrame, x: str, y: str, least: int = 300) -> DataFrame:
    """Pearson correlation over all dates at once."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.when(F.count(F.lit(1)) >= least, correlation(F.col(x), F.col(y))).alias("pooled"), F.count(F.lit(1)).alias("n"))


def normalised_weights(df: DataFrame, weight: str) -> DataFrame:
    return df.withColumn("share", F.try_divide(F.col(weight), F.sum(weight).over(Window.partitionBy(DATE))))


def improvement(df: DataFrame, before: str, after: str, higher_is_better: Column) -> DataFrame:
    """Change of a measure with its sign such that better is positive, and against the old size."""
    delta = (F.col(after) - F.col(before)) * F.when(higher_is_better, 1.0).otherwise(-1.0)
    return df.withColumn("delta", delta).withColumn("relative", F.try_divide(delta, F.abs(before)))


def group_returns(df: DataFrame, score: str, label: str, groups: int = 5) -> DataFrame:
    """Mean label of each of `groups` equal score groups per date; group 1 has the lowest scores."""
    ok = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    cut = F.ntile(groups).over(Window.partitionBy(DATE).orderBy(score, CODE))
    return ok.withColumn("bucket", cut).groupBy(DATE, "bucket").agg(F.avg(label).alias("mean_label"), F.count(F.lit(1)).alias("n"))


def monotonicity(grouped: DataFrame) -> DataFrame:
    """Rank correlation of the groups' order and their mean over all dates."""
    per = grouped.groupBy("bucket").agg(F.avg("mean_label").alias("mean"))
    placed = per.withColumn("place", F.rank().over(Window.partitionBy(F.lit(0)).orderBy("mean")))
    return placed.agg(correlation(F.col("bucket").cast("double"), F.col("place").cast("double")).alias("monotone"))


def replay(scores: DataFrame, k: int, drop: int, cost: float) -> DataFrame:
    """Day-by-day top-k-dropout portfolios, one per account: each day's holdings depend on the day before, so an account's days run in
    order in one task while accounts run side by side. scores: account, trade_date, code, score, ret (the return of the next day).

    Per account and day: held codes, buys, sells, the equal-weight return less `cost` per traded slot, and the value. Of a day's
    holdings the worst `drop` that newcomers beat are replaced; codes without a score that day rank last. A day's rows are one
    cross-section, so what a task holds is a day's scores and k holdings."""

    def days(account: object, parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """One row per day; only the day at hand is held."""
        held, value, out = [], 1.0, []
        for day, codes, score, ret in _by_day(parts):
            known = np.flatnonzero(~np.isnan(score))
            known = known[np.lexsort((codes[known], -score[known]))]
            place = {c: i for i, c in enumerate(codes[known].tolist())}
            order = lambda c: (place.get(c, len(place)), c)  # noqa: B023, E731
            mine = set(held)
            fresh = [c for c in place if c not in mine]
            pool = sorted([*held, *fresh[: drop + max(0, k - len(held))]], key=order)
            sold = mine & set(pool[max(0, len(pool) - drop) :])
            bought = fresh[: max(0, len(sold) + k - len(held))]
            held = [c for c in held if c not in sold] + bought
            gains = dict(zip(codes.tolist(), np.nan_to_num(ret).tolist(), strict=True))
            net = (sum(gains.get(c, 0.0) for c in held) / len(held) if held else 0.0) - cost * (len(sold) + len(bought)) / k
            value *= 1 + net
            out.append((account, day, ",".join(map(str, sorted(held))), len(bought), len(sold), net, value))
        return pd.DataFrame(out, columns=["account", DATE, "holdings", "buys", "sells", "net", "value"])

    kind = scores.schema["account"].dataType.simpleString()
    # A code that is never among a day's best 2 k + drop is never bought, so its rows need not reach the account's task.
    best = Window.partitionBy("account", DATE).orderBy(F.col("score").desc_nulls_last(), CODE)
    ever = scores.where(F.col("score").isNotNull()).select("account", DATE, CODE, F.row_number().over(best).alias("place")).where(F.col("place") <= 2 * k + drop)
    wanted = scores.join(ever.select("account", CODE).distinct(), ["account", CODE], "left_semi")
    # Every day of an account stays, by its best row, so that the days on which nothing is bought are told too.
    days_kept = scores.groupBy("account", DATE).agg(F.min(F.struct(CODE, "score", "ret")).alias("r")).join(wanted.select("account", DATE).distinct(), ["account", DATE], "left_anti")
    scores = wanted.select("account", DATE, CODE, "score", "ret").unionByName(days_kept.select("account", DATE, f"r.{CODE}", "r.score", "r.ret"))
    ordered = scores.select("account", DATE, CODE, "score", "ret").repartition("account").sortWithinPartitions("account", DATE, CODE)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for account, parts in _runs(frames):
            yield days(account, parts)

    return ordered.mapInPandas(work, f"account {kind}, {DATE} date, holdings string, buys int, sells int, net double, value double")


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[pd.DataFrame]]]:
    """Consecutive rows of one account, without holding them all."""
    waiting: list[pd.DataFrame] = []
    source = iter(frames)

    def pull() -> bool:
        for f in source:
            if len(f):
                waiting.append(f)
                return True
        return False

    while waiting or pull():
        account = waiting[0]["account"].iloc[0]

        def parts(account=account) -> Iterator[pd.DataFrame]:
            while waiting or pull():
                f = waiting.pop(0)
                same = (f["account"] == account).to_numpy()
                if not same.all():
                    waiting.insert(0, f[~same])
                    if same.any():
                        yield f[same]
                    return
                yield f

        yield account, parts()


def _by_day(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray]]:
    """Day, codes, scores and returns; a day may reach over frames."""
    day, held = None, []
    for f in frames:
        dates = f[DATE].to_numpy()
        columns = [f[CODE].to_numpy(), f["score"].to_numpy(dtype=float), f["ret"].to_numpy(dtype=float)]
        starts = np.append(0, np.flatnonzero(dates[1:] != dates[:-1]) + 1)
        for i, j in zip(starts, np.append(starts[1:], len(f))):
            if held and dates[i] != day:
                yield day, *[np.concatenate(x) for x in zip(*held)]
                held = []
            day = dates[i]
            held.append([c[i:j] for c in columns])
    if held:
        yield day, *[np.concatenate(x) for x in zip(*held)]
