"""Listing status, distress, tradable universe and price limits of instruments, and research windows on a trading calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import CODE, DATE, interval_lookup

# What names and statuses mark, limit tolerances, the turnover (as a ratio) below which a limit day is sealed.
SPECIAL_NAME, DELIST_NAME, DELIST_REASON = r"(?i)^\s*(?:\*?ST|SST)", "退市", "终止上市"
TRADABLE = ("L", "P")
PRICE_TOLERANCE, RATE_TOLERANCE, SEALED_TURNOVER = 1e-4, 1e-4, 0.0005


def special_name(name: Column) -> Column:
    return F.coalesce(F.rlike(name, F.lit(SPECIAL_NAME)), F.lit(False))


def delist_name(name: Column) -> Column:
    return F.coalesce(F.contains(name, F.lit(DELIST_NAME)), F.lit(False))


def distressed(name: Column) -> Column:
    """The exposure guard's rule: the trimmed name begins with ST or *ST, or tells of delisting."""
    n = F.upper(F.trim(name))
    return F.coalesce(n.startswith("ST") | n.startswith("*ST") | F.contains(n, F.lit(DELIST_NAME)), F.lit(False))


def tradable(book: DataFrame, day: Column) -> DataFrame:
    """Instruments that can be traded as of a day: listed or paused ones, and those listed by then that were delisted later. book:
    list_status, list_date, delist_date."""
    later = (F.col("list_status") == "D") & (F.col("list_date") <= day) & (F.col("delist_date") > day)
    return book.where(F.col("list_status").isin(*TRADABLE) | F.coalesce(later, F.lit(False)))


def name_candidates(book: DataFrame) -> DataFrame:
    """Instruments whose name history is worth fetching: delisted, with a delisting date, or with a telling name."""
    return book.where((F.col("list_status") == "D") | F.col("delist_date").isNotNull() | special_name(F.col("name")) | delist_name(F.col("name")))


def with_status(days: DataFrame, book: DataFrame, special: DataFrame, names: DataFrame) -> DataFrame:
    """days (code, trade_date) with name, list_status by date and st_status (normal, st, delist).

    book: code, name, list_status (I is an index), delist_date. special: code, trade_date of special treatment. names: code, start, end,
    name, reason; the latest of overlapping ones names the day, and any that tells of special treatment or delisting counts."""
    hit = names.withColumn("st", special_name(F.col("name")) | F.coalesce(F.contains(F.upper("reason"), F.lit("ST")), F.lit(False)))
    hit = hit.withColumn("out", delist_name(F.col("name")) | F.coalesce(F.contains("reason", F.lit(DELIST_REASON)), F.lit(False)))
    found = interval_lookup(days.select(CODE, DATE).distinct(), hit.withColumnsRenamed({"name": "new_name", "st": "by_st", "out": "by_out"}), CODE, DATE, "start", "end", ["new_name"], ["by_st", "by_out"])
    found = found.join(special.select(CODE, DATE).distinct().withColumn("listed_st", F.lit(True)), [CODE, DATE], "left")
    df = days.join(found, [CODE, DATE], "left").join(book.select(CODE, "name", "list_status", "delist_date"), CODE, "left")
    over = F.coalesce(F.col(DATE) > F.col("delist_date"), F.lit(False))
    status = F.when(F.col("list_status") == "I", "I").when(over, "D").otherwise("L")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    st = F.when((status == "D") | yes("by_out"), "delist").when(yes("listed_st") | yes("by_st"), "st").otherwise("normal")
    return df.select(*days.columns, F.coalesce("new_name", "name").alias("name"), status.alias("list_status"), st.alias("st_status"))


def limit_source(df: DataFrame) -> Column:
    """Where a row's limits come from: official, structural_no_limit on the day of listing, index or missing."""
    return (
        F.when(F.col("up_limit").isNotNull() & F.col("down_limit").isNotNull(), "official")
        .when(F.col("list_date") == F.col(DATE), "structural_no_limit").when(F.col("list_status") == "I", "index").otherwise("missing")
    )


def execution_flags(df: DataFrame) -> DataFrame:
    """Limit flags in raw prices: at close, at open, half-way between, by the day's change (in percent) where the rate alone is known,
    and sealed: the whole day pinned to the limit with hardly any turnover (in percent). A missing value is never a hit."""
    up, down, known = F.col("up_limit"), F.col("down_limit"), F.col("up_limit").isNotNull() & F.col("down_limit").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    mid = (F.col("open") + F.col("close")) / 2
    pinned = lambda at: yes(sum_and([F.abs(F.col(c) - at) <= PRICE_TOLERANCE for c in ("open", "high", "low", "close")])) & known
    thin = yes((F.col("turnover") >= 0) & (F.col("turnover") / 100 <= SEALED_TURNOVER))
    flags = {}
    for name, price in {"": F.col("close"), "_open": F.col("open"), "_mid": mid}.items():
        flags[f"limit_buy{name}"] = known & yes(price >= up - PRICE_TOLERANCE)
        flags[f"limit_sell{name}"] = known & yes(price <= down + PRICE_TOLERANCE)
    flags["fallback_buy"] = yes(F.col("pct_chg") / 100 >= F.col("rate") - RATE_TOLERANCE)
    flags["fallback_sell"] = yes(F.col("pct_chg") / 100 <= -(F.col("rate") - RATE_TOLERANCE))
    return df.withColumns(flags | {"sealed_up": pinned(up) & thin, "sealed_down": pinned(down) & thin})


def sum_and(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def provider_prices(df: DataFrame) -> DataFrame:
    """Raw copies kept, prices multiplied and volume divided by the factor, the change recomputed from adjusted closes."""
    prices = ("open", "high", "low", "close")
    out = df.withColumns({f"raw_{c}": F.col(c) for c in prices}).withColumns({c: F.col(c) * F.col("factor") for c in prices})
    out = out.withColumn("volume", F.try_divide("volume", "factor"))
    before = F.lag("close").over(Window.partitionBy(CODE).orderBy(DATE))
    return out.withColumn("change", F.try_divide(F.col("close"), before) - 1)


def no_official_close(df: DataFrame) -> DataFrame:
    """Dates on which any row lacks an official previous close, though its code traded before."""
    before = F.lag(DATE).over(Window.partitionBy(CODE).orderBy(DATE))
    return df.withColumn("before", before).where(F.col("official").isNull() & F.col("before").isNotNull()).select(DATE).distinct()


def aliases_expanded(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows under their canonical code: an alias's rows within its dates are renamed, and the canonical code's own row wins on a day
    that has both. aliases: alias, canonical, since, until (null: open)."""
    hit = (F.col(CODE) == F.col("alias")) & (F.col(DATE) >= F.col("since")) & (F.col("until").isNull() | (F.col(DATE) <= F.col("until")))
    renamed = df.join(aliases, hit, "left").withColumn("own", F.col("alias").isNull()).withColumn(CODE, F.coalesce("canonical", CODE))
    order = Window.partitionBy(CODE, DATE).orderBy(F.col("own").desc(), F.col("alias"))
    return renamed.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(*df.columns)


def windows(last: Column, first: str, valid_months: int, test_months: int) -> dict[str, Column]:
    """Bounds of training, validation and test, the test's last day being `last`."""
    test = F.add_months(F.trunc(last, "month"), 1 - test_months)
    valid = F.add_months(test, -valid_months)
    return {"train_start": F.lit(first).cast("date"), "train_end": F.date_sub(valid, 1), "valid_start": valid, "valid_end": F.date_sub(test, 1), "test_start": test, "test_end": last}


def sessions_around(days: DataFrame, calendar: DataFrame, day: str, shift: int, purge: int) -> DataFrame:
    """For each day: the session on or before it, the execution session `shift` later, and the last session whose label ends before it
    (purged_end: `purge` sessions and one more earlier). One pass over the calendar, then an as-of lookup by year and day."""
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)
    c = calendar.select(F.col(DATE).alias("session"), F.lead(DATE, shift).over(w).alias("execution"), F.lag(DATE, purge + 1).over(w).alias("purged_end"), F.lead(DATE).over(w).alias("until"))
    owned = c.select("session", "execution", "purged_end", F.explode(F.sequence("session", F.coalesce(F.date_sub("until", 1), F.date_add("session", 365)))).alias("owned"))
    return days.join(owned, F.col(day) == F.col("owned"), "left").drop("owned")
