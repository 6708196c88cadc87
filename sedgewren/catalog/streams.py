"""Queries that run streams to their end: keyed state that goes on from its checkpoint, and a sink to which a replay does nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.receipts import new_path
from ..streaming import events as streams
from ..streaming import keyed
from .panels import query
from .views import table

CUT = "2024-01-20"


@query(f"""WITH e AS (SELECT user_id, ts, max(CAST(round(value * 100) AS BIGINT)) AS c FROM events GROUP BY 1, 2), l AS (SELECT user_id, max(ts) AS last FROM e GROUP BY 1),
d AS (SELECT user_id, last, arg_max(c, ts) AS counter, coalesce(arg_max(c, ts) FILTER (ts <= last - INTERVAL 1 DAY), 0) AS day0, coalesce(arg_max(c, ts) FILTER (ts <= last - INTERVAL 7 DAY), 0) AS week0 FROM e JOIN l USING (user_id) GROUP BY 1, 2),
w AS (SELECT user_id, ts, c > lag(c) OVER (PARTITION BY user_id ORDER BY ts) AS up FROM e JOIN l USING (user_id) WHERE ts > last - INTERVAL 7 DAY), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - row_number() OVER (PARTITION BY user_id, up ORDER BY ts) AS island FROM w WHERE up IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id, up, island ORDER BY ts) AS streak FROM i), h AS (SELECT user_id, arg_max(up, ts) FILTER ((up AND streak >= 2) OR (NOT up AND streak >= 3)) AS hot FROM s GROUP BY 1), q AS (SELECT d.*, coalesce(hot, false) AS hot, last + INTERVAL 7 DAY <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE AS idle FROM d LEFT JOIN h USING (user_id))
SELECT user_id, last, counter, CASE WHEN idle THEN 0 ELSE counter - day0 END AS day_delta, CASE WHEN idle THEN 0 ELSE counter - week0 END AS week_delta, hot AND NOT idle AS hot, idle FROM q""")
def st_counter_growth(spark, sf):
    """Each user's counter over the last day and week and whether it rises, by a stream that is stopped and goes on from its checkpoint."""
    folder = new_path(spark, "stream")
    rows = table(spark, sf, "events").select("user_id", "ts", "value")
    early = F.col("ts") <= F.lit(CUT).cast("timestamp")
    for part in (rows.where(early), rows.where(~early).unionByName(rows.where(early & (F.col("ts") > F.lit("2024-01-19").cast("timestamp"))))):  # the last day is said again
        part.write.mode("append").parquet(f"{folder}/in")
        stream = keyed.counter_growth(streams.read_stream(spark, f"{folder}/in", files=1_000_000), F.round(F.col("value") * 100))
        keyed.run_available(stream, keyed.batches(f"{folder}/out"), f"{folder}/state", "update")
    out = keyed.latest(spark, f"{folder}/out", "user_id")
    return out.withColumn("last", F.timestamp_micros("last").cast("timestamp_ntz"))


@query("""SELECT o_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS ordered, CAST(l_shipdate AS DATE) AS shipped FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 400 DAY""")
def st_joined_once(spark, sf):
    """Orders and their shipments within 400 days, joined as streams; the whole is replayed into the same sink, which stays as it is."""
    folder = new_path(spark, "stream")
    table(spark, sf, "orders").select("o_orderkey", "o_orderdate").write.parquet(f"{folder}/orders")  # a stream reads folders
    table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").write.parquet(f"{folder}/lineitem")
    read = lambda name: streams.read_stream(spark, f"{folder}/{name}", files=1_000_000)
    for run in range(2):
        pairs = keyed.joined_within(read("orders"), read("lineitem"), ("o_orderkey", "l_orderkey"), ("o_orderdate", "l_shipdate"), "400 DAYS")
        keyed.run_available(pairs, keyed.batches(f"{folder}/out"), f"{folder}/state{run}", "append", keyed.PLAIN)
    out = spark.read.parquet(f"{folder}/out")
    return out.select("o_orderkey", "l_linenumber", F.to_date("o_orderdate").alias("ordered"), F.to_date("l_shipdate").alias("shipped"))
