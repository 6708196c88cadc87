"""Quality reports as rows of (check, detail, n), consistency across surfaces, event projections and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import CODE, DATE


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _count(df: DataFrame, check: str, detail: Column | None = None) -> DataFrame:
    """Rows of df, as one row, or one per detail where there are any."""
    if detail is None:
        return df.agg(F.lit(check).alias("check"), F.lit("").alias("detail"), F.count(F.lit(1)).alias("n"))
    return df.groupBy(detail.cast("string").alias("detail")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(check).alias("check"), "detail", "n")


def raw_report(df: DataFrame, calendar: DataFrame, book: DataFrame, first: str, last: str) -> DataFrame:
    """Faults of raw daily rows against the calendar and the book (code, list_date, delist_date): calendar dates without rows, dates off the
    calendar, repeated keys, codes not in the book, rows before listing or after delisting, listed codes without a row in the window."""
    inside = F.col(DATE).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    rows, days = df.where(inside), calendar.where(inside).select(DATE).distinct()
    have = rows.select(DATE).distinct()
    with_book = rows.join(book.select(CODE, "list_date", "delist_date"), CODE)
    listed = book.where((F.col("list_date") <= F.lit(last).cast("date")) & (F.col("delist_date").isNull() | (F.col("delist_date") >= F.lit(first).cast("date"))))
    return stacked([
        _count(days.join(have, DATE, "left_anti"), "missing_date"),
        _count(have.join(days, DATE, "left_anti"), "unexpected_date"),
        _count(rows.groupBy(CODE, DATE).agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "repeated_key"),
        _count(rows.select(CODE).distinct().join(book.select(CODE), CODE, "left_anti"), "unknown_code"),
        _count(with_book.where(F.col(DATE) < F.col("list_date")), "before_listing"),
        _count(with_book.where(F.col(DATE) > F.col("delist_date")), "after_delisting"),
        _count(listed.select(CODE).join(rows.select(CODE).distinct(), CODE, "left_anti"), "silent_code"),
    ])


def silver_report(df: DataFrame, required: list[str], positive: list[str], target: str) -> DataFrame:
    """Faults of an assembled table: absent columns, nulls and non-positive values by column, crossed prices, rows behind the target date."""
    there = [c for c in required if c in df.columns]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in there], *[F.count_if(F.col(c) <= 0).alias(f"low_{c}") for c in positive], F.count_if(F.col("high") < F.col("low")).alias("crossed"), (F.max(DATE) < F.lit(target).cast("date")).cast("long").alias("behind"))
    one = lambda check, detail, n: F.struct(F.lit(check).alias("check"), F.lit(detail).alias("detail"), n.cast("long").alias("n"))
    rows = [one("absent", c, F.lit(1)) for c in required if c not in df.columns]
    rows += [one("null", c, F.col(c)) for c in there] + [one("not_positive", c, F.col(f"low_{c}")) for c in positive]
    rows += [one("crossed", "", F.col("crossed")), one("behind", "", F.col("behind"))]
    return nulls.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def gate(report: DataFrame, most: dict[str, int]) -> DataFrame:
    """The checks of a gate, their faults in all, the number allowed, and whether they pass; other checks are left out."""
    allowed = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    per = report.where(F.col("check").isin(list(most))).groupBy("check").agg(F.sum("n").alias("n"))
    return per.withColumn("most", allowed[F.col("check")].cast("long")).withColumn("passed", F.col("n") <= F.col("most"))


def series_presence(df: DataFrame, codes: DataFrame, target: str) -> DataFrame:
    """For each wanted code whether it is there, its latest date and whether that reaches the target."""
    last = df.groupBy(CODE).agg(F.max(DATE).alias("latest"))
    return codes.join(last, CODE, "left").withColumn("present", F.col("latest").isNotNull()).withColumn("current", F.coalesce(F.col("latest") >= F.lit(target).cast("date"), F.lit(False)))


def adjusted_consistency(df: DataFrame, factor: str, adjusted: str, rtol: float = 1e-5, atol: float = 0.02) -> DataFrame:
    """Per code, rows whose adjusted price is not the close times the factor over the code's last factor."""
    w = Window.partitionBy(CODE).orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = F.col("close") * F.col(factor) / F.last(factor, ignorenulls=True).over(w)
    off = F.abs(F.col(adjusted) - want) > atol + rtol * F.abs(want)
    return df.withColumn("off", off).groupBy(CODE).agg(F.count(F.lit(1)).alias("n"), F.count_if("off").alias("mismatches"))


def reconcile(surfaces: dict[str, DataFrame], base: str, keys: list[str], tolerance: dict[str, float]) -> DataFrame:
    """Values of each surface against the base by key and field: same, differs or absent, as counts. One grouping of the stacked rows, so
    each surface is shuffled once however many there are."""
    fields = list(tolerance)
    long = stacked([df.select(*keys, F.lit(s).alias("surface"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])).alias("x")) for s, df in surfaces.items()])
    per = long.groupBy(*keys, "x.field").pivot("surface", list(surfaces)).agg(F.max("x.v"))
    allowed = F.create_map(*[F.lit(x) for pair in tolerance.items() for x in pair])[F.col("field")]
    others = [s for s in surfaces if s != base]
    said = lambda s: F.when(F.col(s).isNull() | F.col(base).isNull(), F.when(F.col(s).eqNullSafe(F.col(base)), "same").otherwise("absent")).when(F.abs(F.col(s) - F.col(base)) <= allowed, "same").otherwise("differs")
    rows = per.select("field", F.explode(F.array(*[F.struct(F.lit(s).alias("surface"), said(s).alias("outcome")) for s in others])).alias("y"))
    return rows.groupBy("y.surface", "field", "y.outcome").agg(F.count(F.lit(1)).alias("n"))


def readiness(surfaces: dict[str, DataFrame]) -> DataFrame:
    """Latest date of each surface and its days behind the newest one."""
    last = stacked([df.agg(F.lit(s).alias("surface"), F.max(DATE).alias("latest")) for s, df in surfaces.items()])
    return last.withColumn("behind", F.datediff(F.max("latest").over(Window.partitionBy(F.lit(0))), "latest"))


def schema_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of two tables whose kinds differ or that one lacks."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    rows = [(c, x.get(c), y.get(c)) for c in sorted({*x, *y}) if x.get(c) != y.get(c)]
    return a.sparkSession.createDataFrame(rows, "field string, left_kind string, right_kind string")


def prediction_audit(df: DataFrame, score: str, first: str, last: str) -> DataFrame:
    """Rows, repeated keys, rows outside the window, null scores, and whether every code's dates rise."""
    w = Window.partitionBy(CODE).orderBy("place")
    outside = ~F.col(DATE).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    df = df.withColumn("falls", F.coalesce(F.col(DATE) < F.lag(DATE).over(w), F.lit(False))).withColumn("alike", F.count(F.lit(1)).over(Window.partitionBy(CODE, DATE)))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("alike") > 1).alias("repeated"), F.count_if(outside).alias("outside"), F.count_if(F.col(score).isNull()).alias("nulls"), (F.count_if("falls") == 0).alias("monotonic"))


def fallback_lookup(codes: DataFrame, dimension: DataFrame, dialects: list[Column], value: str) -> DataFrame:
    """The dimension's value by the first spelling of a code that it has. dimension: key, value; dialects: spellings, best first."""
    tried = codes.select(CODE, F.posexplode(F.array_distinct(F.array(*dialects))).alias("try", "key"))
    best = tried.join(dimension, "key").groupBy(CODE).agg(F.min_by(F.struct("key", value), "try").alias("v"))
    return codes.join(best, CODE, "left").select(*codes.columns, F.col("v.key").alias("found_as"), F.col(f"v.{value}").alias(value))


def projected_events(events: DataFrame, stages: list[str] | None, per_group: int) -> DataFrame:
    """Events of the stages (None: all), each once by the hash of what it says, and the last so many of each group. events: stage, grp, at, body."""
    kept = (events if stages is None else events.where(F.col("stage").isin(stages))).withColumn("event", F.md5(F.concat_ws("|", "stage", "grp", "body").cast("binary")))
    once = kept.groupBy("event").agg(F.min(F.struct("at", "stage", "grp", "body")).alias("e")).select("event", "e.*")
    last = Window.partitionBy("grp").orderBy(F.col("at").desc(), "event")
    return once.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= per_group)


def merged_trials(*sources: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Trials of several sources, earlier ones first by `order`, each composite key once (the first)."""
    both = stacked(list(sources))
    return both.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("nth = 1").drop("nth")


def latest_snapshot(df: DataFrame, day: Column, score: str, k: int) -> DataFrame:
    """The k best of one day; the result has a row that says so where the day is missing."""
    at = df.where(F.col(DATE) == day)
    found = at.agg(F.count(F.lit(1)).alias("rows"))
    best = at.orderBy(F.col(score).desc_nulls_last(), CODE).limit(k).select(CODE, F.col(score).alias("score"), F.lit(None).cast("string").alias("error"))
    none = found.where("rows = 0").select(F.lit(None).cast(df.schema[CODE].dataType).alias(CODE), F.lit(None).cast(df.schema[score].dataType).alias("score"), F.lit("date missing").alias("error"))
    return best.unionByName(none)
