"""Queries of as-of joins under skew, spans against spans, and consolidation with receipts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel
from ..sources import receipts
from .panels import query
from .views import table

# Nine tenths of the lines and orders have key 0.
HOT = "CASE WHEN {0} % 10 > 0 THEN 0 ELSE {0} END"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, {HOT.format('l_suppkey')} AS k, CAST(l_shipdate AS DATE) AS day FROM lineitem), o AS (SELECT {HOT.format('o_custkey')} AS k, CAST(o_orderdate AS DATE) AS known, max(o_totalprice) AS price FROM orders GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l.k, day, known, price FROM l ASOF LEFT JOIN o ON l.k = o.k AND l.day >= o.known""")
def j_asof_hot(spark, sf):
    """The last price known on each line's day where one key has nine tenths of all rows: its history is split by ranges of time."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(HOT.format("l_suppkey")).alias("k"), F.to_date("l_shipdate").alias("day"))
    prices = table(spark, sf, "orders").groupBy(F.expr(HOT.format("o_custkey")).alias("k"), F.to_date("o_orderdate").alias("known")).agg(F.max("o_totalprice").alias("price"))
    return panel.asof_join(lines, prices, "k", "day", "known", ["price"], key_rows=1000)


# An order is open from its day to its last shipment, of which every seventh has not come; a window is a supplier's fortnight around each new year.
OPEN = """open_ AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS since, CASE WHEN o_orderkey % 7 > 0 THEN CAST(max(l_shipdate) AS DATE) END AS until FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate)"""


def opened(spark, sf):
    shipped = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    o = table(spark, sf, "orders").join(shipped, "o_orderkey")
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("since"), F.when(F.col("o_orderkey") % 7 > 0, F.to_date("last")).alias("until"))


@query(f"""WITH {OPEN}, spans AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS opens, CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(20 + month(o_orderdate) AS INTEGER) AS closes FROM orders GROUP BY 1, 2),
pairs AS (SELECT opens, closes, o_orderkey, since, until FROM spans JOIN open_ ON since <= closes AND (until IS NULL OR (until >= opens AND until >= since)))
SELECT opens, closes, count(*) AS orders, count(*) FILTER (until IS NULL) AS still_open, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM pairs GROUP BY 1, 2""")
def j_overlaps(spark, sf):
    """Orders alive in each window of days, spans against spans."""
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    spans = table(spark, sf, "orders").select(month.alias("opens"), F.date_add(month, 20 + F.month("o_orderdate")).alias("closes")).distinct()
    pairs = panel.overlaps(opened(spark, sf), spans, ("since", "until"), ("opens", "closes"), cell=60)
    return pairs.groupBy("opens", "closes").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("until").isNull()).alias("still_open"), F.sum("o_orderkey").alias("keys"))


@query(f"""WITH {OPEN}, ok AS (SELECT * FROM open_ WHERE until IS NULL OR until >= since), e AS (SELECT since AS day, 1 AS up, 0 AS down FROM ok UNION ALL SELECT CAST(until + 1 AS DATE), 0, 1 FROM ok WHERE until IS NOT NULL UNION ALL SELECT DISTINCT CAST(l_shipdate AS DATE), 0, 0 FROM lineitem),
d AS (SELECT day, CAST(sum(up) AS BIGINT) AS begun, CAST(sum(down) AS BIGINT) AS ended FROM e GROUP BY 1), s AS (SELECT *, CAST(sum(begun - ended) OVER (ORDER BY day) AS BIGINT) AS alive FROM d) SELECT day AS trade_date, begun, ended, alive FROM s WHERE day IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)""")
def w_concurrency(spark, sf):
    """Open orders on each shipping day, by a sweep over their first and last days."""
    days = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct()
    return panel.concurrency(opened(spark, sf), "since", "until", days)


@query("""WITH o AS (SELECT year(o_orderdate) AS year, o_orderkey, o_totalprice FROM orders), m AS (SELECT max(o_orderkey) AS last FROM o), t AS (SELECT year AS touched FROM o, m WHERE o_orderkey = last)
SELECT CAST(year AS VARCHAR) AS part, 'built' AS first, 'kept' AS second, CASE WHEN year = touched THEN 'rebuilt' ELSE 'kept' END AS third, count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2)) + CASE WHEN o_orderkey = last THEN 1 ELSE 0 END) AS DOUBLE) AS total FROM o, m, t GROUP BY year, touched""")
def k_receipts(spark, sf):
    """Orders consolidated by year three times: new, unchanged, and with one changed row."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    last = o.agg(F.max("o_orderkey").alias("last"))
    changed = o.join(F.broadcast(last)).withColumn("o_totalprice", F.col("o_totalprice") + (F.col("o_orderkey") == F.col("last")).cast("int")).drop("last")
    path = receipts.new_path(spark, "consolidated")
    runs = [receipts.consolidate(df, path, "year", "o_orderkey").withColumnRenamed("action", name) for df, name in ((o, "first"), (o, "second"), (changed, "third"))]
    table_ = spark.read.parquet(path).groupBy(F.col("year").cast("string").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return runs[0].join(runs[1], "part").join(runs[2], "part").join(table_, "part")
