"""One-day portfolio steps over many accounts at once: targets, tradability, rebalancing in lots, fills, ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import CODE, DATE


def matched_targets(scores: DataFrame, status: DataFrame, score: str, k: int, invested: float, least: float = 0.95) -> DataFrame:
    """Equal slots for the k best rows that have a status and are normal, on dates whose rows match a status as often as `least`.
    status: code, trade_date, normal."""
    both = scores.join(status, [CODE, DATE], "left")
    share = F.avg(F.col("normal").isNotNull().cast("double")).over(Window.partitionBy(DATE))
    fit = both.withColumn("matched", share).where((F.col("matched") >= least) & F.coalesce("normal", F.lit(False)) & F.col(score).isNotNull())
    place = F.row_number().over(Window.partitionBy(DATE).orderBy(F.col(score).desc(), CODE))
    return fit.withColumn("place", place).where(F.col("place") <= k).withColumn("target_weight", F.lit(invested / k))


def allowed_orders(orders: DataFrame, blocked: DataFrame) -> DataFrame:
    """Orders that may be executed: none for codes without a price, no buy at the upper and no sale at the lower limit. blocked: code,
    at_up, at_down, no_price."""
    no = lambda c: F.coalesce(c, F.lit(False))
    both = orders.join(blocked, CODE, "left")
    stop = no(F.col("no_price")) | (no(F.col("at_up")) & (F.col("action") == "buy")) | (no(F.col("at_down")) & (F.col("action") == "sell"))
    return both.where(~stop).select(*orders.columns)


def rebalance(positions: DataFrame, lot: int = 100, hold: float = 0.005, ramp: float = 1.0, cost: float = 0.001) -> DataFrame:
    """Orders of each account that lead to its target weights. positions: account, code, price, weight (target, null: none), held, equity,
    cash (of the account, on every row).

    Wanted amounts are whole lots; changes below `hold` of the equity are not made, and a code is bought for at most `ramp` of the equity.
    Sales come first and add to the cash; then the heaviest targets are bought, each with what all before it leave, the first that does
    not fit in part. This is one running sum per account."""
    price, equity = F.col("price"), F.col("equity")
    want = F.coalesce(F.floor(F.col("weight") * equity / price / lot) * lot, F.lit(0)).cast("long")
    have = F.coalesce("held", F.lit(0)).cast("long")
    df = positions.withColumn("change", want - have).withColumn("change", F.when(F.abs(F.col("change") * price) >= hold * equity, F.col("change")).otherwise(0))
    sold = F.when(F.col("change") < 0, -F.col("change")).otherwise(0)
    most = F.floor(ramp * equity / price / lot) * lot
    asked = F.when(F.col("change") > 0, F.least("change", most)).otherwise(0).cast("long")
    df = df.withColumn("sell", sold.cast("long")).withColumn("asked", asked)
    account = Window.partitionBy("account")
    funds = F.col("cash") + F.sum(F.col("sell") * price * (1 - cost)).over(account)
    before = account.orderBy(F.col("weight").desc_nulls_last(), CODE).rowsBetween(Window.unboundedPreceding, -1)
    need = F.col("asked") * price * (1 + cost)
    left = F.greatest(F.lit(0.0), funds - F.coalesce(F.sum(need).over(before), F.lit(0.0)))
    buy = F.least(F.col("asked"), F.floor(left / (price * (1 + cost)) / lot) * lot).cast("long")
    df = df.withColumn("buy", buy).where("buy > 0 OR sell > 0")
    return df.select("account", CODE, "price", "buy", "sell", ((F.col("buy") + F.col("sell")) * price * cost).alias("fee"))


def marked(positions: DataFrame, fills: DataFrame) -> DataFrame:
    """Accounts after their fills at the day's prices: holdings' value, cash and equity."""
    done = fills.select("account", CODE, "buy", "sell", "fee")
    both = positions.join(done, ["account", CODE], "left")
    now = F.coalesce("held", F.lit(0)) + F.coalesce("buy", F.lit(0)) - F.coalesce("sell", F.lit(0))
    spent = (F.coalesce("buy", F.lit(0)) - F.coalesce("sell", F.lit(0))) * F.col("price") + F.coalesce("fee", F.lit(0.0))
    of = both.groupBy("account").agg(F.sum(now * F.col("price")).alias("value"), (F.max("cash") - F.sum(spent)).alias("cash"), F.count_if(now > 0).alias("holdings"))
    return of.withColumn("equity", F.col("value") + F.col("cash"))


def ledger(fills: DataFrame) -> DataFrame:
    """Bought and sold value, fees and numbers of trades of each account."""
    bought, sold = F.col("buy") * F.col("price"), F.col("sell") * F.col("price")
    return fills.groupBy("account").agg(F.sum(bought).alias("bought"), F.sum(sold).alias("sold"), F.sum("fee").alias("fees"), F.count_if(F.col("buy") > 0).alias("buys"), F.count_if(F.col("sell") > 0).alias("sells"))


def turnover(weights: DataFrame, weight: str) -> DataFrame:
    """Half the absolute change of all weights from date to date. weights: code, trade_date; a code without a row has none."""
    days = weights.select(DATE).distinct().withColumn("next_date", F.lead(DATE).over(Window.partitionBy(F.lit(0)).orderBy(DATE)))
    now = weights.join(F.broadcast(days), DATE)
    change = now.select(CODE, DATE, F.col(weight).alias("w")).unionByName(now.where("next_date IS NOT NULL").select(CODE, F.col("next_date").alias(DATE), (-F.col(weight)).alias("w")))
    per = change.groupBy(CODE, DATE).agg(F.sum("w").alias("d")).groupBy(DATE).agg((F.sum(F.abs("d")) / 2).alias("turnover"))
    return per


def held_counts(picks: DataFrame) -> DataFrame:
    return picks.groupBy(DATE).agg(F.count_distinct(CODE).alias("holdings"))


def identified(df: DataFrame, *parts: Column) -> Column:
    """A name for a recommendation that depends on its content only."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16)
