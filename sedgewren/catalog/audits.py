"""Queries of audits, portfolio steps, clusters, sinks and expression texts, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audits, evaluate, graph, labels, panel, portfolio, ranking, reports, scoring
from ..plans import dsl
from ..sources import tables
from .panels import LABEL, PAIRS, pair_edges, query, rounded
from .status import BOOK, book
from .views import PANEL, rank, table
from .views import panel as bars


# Reports.

FIRST, LAST = "1996-01-01", "1998-12-31"


@query(f"""WITH {PANEL}, {BOOK}, r AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date FROM lineitem WHERE l_shipdate BETWEEN '{FIRST}' AND '{LAST}'), c AS (SELECT CAST(d AS DATE) AS trade_date FROM generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
w AS (SELECT r.*, list_date, delist_date FROM r JOIN book USING (code)) SELECT 'missing_date' AS "check", '' AS detail, count(*) AS n FROM c WHERE trade_date NOT IN (SELECT trade_date FROM r) UNION ALL SELECT 'unexpected_date', '', count(DISTINCT trade_date) FROM r WHERE trade_date NOT IN (SELECT trade_date FROM c)
UNION ALL SELECT 'repeated_key', '', count(*) FROM (SELECT 1 FROM r GROUP BY code, trade_date HAVING count(*) > 1) UNION ALL SELECT 'unknown_code', '', count(DISTINCT code) FROM r WHERE code NOT IN (SELECT code FROM book)
UNION ALL SELECT 'before_listing', '', count(*) FROM w WHERE trade_date < list_date UNION ALL SELECT 'after_delisting', '', count(*) FROM w WHERE trade_date > delist_date
UNION ALL SELECT 'silent_code', '', count(*) FROM book WHERE list_date <= DATE '{LAST}' AND (delist_date IS NULL OR delist_date >= DATE '{FIRST}') AND code NOT IN (SELECT code FROM r)""")
def a_raw_report(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date"))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))).alias("trade_date")).where(F.weekday("trade_date") < 5)
    return audits.raw_report(rows, days, book(spark, sf), FIRST, LAST)


SILVER = f"""v AS (SELECT *, CASE WHEN volume > 2 THEN close - 100 END AS net, CASE WHEN discount > 0.09 THEN low - 1 ELSE high END AS top FROM panel),
rep AS (SELECT 'absent' AS "check", 'turnover' AS detail, 1::BIGINT AS n UNION ALL SELECT 'null', 'net', count(*) FILTER (net IS NULL) FROM v UNION ALL SELECT 'null', 'volume', count(*) FILTER (volume IS NULL) FROM v UNION ALL SELECT 'not_positive', 'net', count(*) FILTER (net <= 0) FROM v
UNION ALL SELECT 'crossed', '', count(*) FILTER (top < low) FROM v UNION ALL SELECT 'behind', '', CAST(max(trade_date) < DATE '2030-01-01' AS BIGINT) FROM v)"""


def silver(spark, sf):
    p = bars(spark, sf).withColumn("net", F.when(F.col("volume") > 2, F.col("close") - 100)).withColumn("high", F.when(F.col("discount") > 0.09, F.col("low") - 1).otherwise(F.col("high")))
    return audits.silver_report(p, ["net", "volume", "turnover"], ["net"], "2030-01-01")


@query(f"""WITH {PANEL}, {SILVER} SELECT * FROM rep""")
def a_silver_report(spark, sf):
    return silver(spark, sf)


@query(f"""WITH {PANEL}, {SILVER}, g(gate, "check", most) AS (VALUES ('daily_compat', 'absent', 1), ('daily_compat', 'crossed', 1000000), ('deep_full', 'absent', 0), ('deep_full', 'null', 0), ('deep_full', 'not_positive', 0), ('deep_full', 'crossed', 0), ('deep_full', 'behind', 0))
SELECT gate, "check", CAST(sum(n) AS BIGINT) AS n, most::BIGINT AS most, sum(n) <= most AS passed FROM g JOIN rep USING ("check") GROUP BY gate, "check", most""")
def a_two_gates(spark, sf):
    """A compatible daily gate and a full one over the same report."""
    report = silver(spark, sf)
    daily = audits.gate(report, {"absent": 1, "crossed": 1_000_000}).withColumn("gate", F.lit("daily_compat"))
    return daily.unionByName(audits.gate(report, {"absent": 0, "null": 0, "not_positive": 0, "crossed": 0, "behind": 0}).withColumn("gate", F.lit("deep_full")))


@query(f"""WITH {PANEL}, w AS (SELECT s_suppkey - 3 AS code FROM supplier), l AS (SELECT code, max(trade_date) AS latest FROM panel GROUP BY 1) SELECT w.code, latest, latest IS NOT NULL AS present, coalesce(latest >= DATE '2001-10-01', false) AS current FROM w LEFT JOIN l USING (code)""")
def a_series_presence(spark, sf):
    wanted = table(spark, sf, "supplier").select((F.col("s_suppkey") - 3).alias("code"))
    return audits.series_presence(bars(spark, sf), wanted, "2001-10-01")


@query(f"""WITH {PANEL}, f AS (SELECT *, 1 + year(trade_date) % 4 / 4.0::DOUBLE AS factor FROM panel), a AS (SELECT *, close * factor / last_value(factor) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS want FROM f),
b AS (SELECT *, abs(want + CASE WHEN volume = 7 THEN 1 ELSE 0 END - want) > 0.02 + 1e-5 * abs(want) AS off FROM a) SELECT code, count(*) AS n, count(*) FILTER (off) AS mismatches FROM b GROUP BY 1""")
def a_adjusted_consistency(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("code").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = bars(spark, sf).withColumn("factor", 1 + F.year("trade_date") % 4 / 4.0)
    p = p.withColumn("adjusted", F.col("close") * F.col("factor") / F.last("factor").over(w) + F.when(F.col("volume") == 7, 1.0).otherwise(0.0))
    return audits.adjusted_consistency(p, "factor", "adjusted")


@query(f"""WITH {PANEL}, s AS (SELECT code, trade_date, close AS c0, volume AS v0, CASE WHEN volume <> 5 THEN close + CASE WHEN discount = 0.02 THEN 1 ELSE 0.001 END END AS c1, CASE WHEN volume <> 5 THEN volume END AS v1, close AS c2, CASE WHEN code % 3 > 0 THEN volume + 1 ELSE volume END AS v2 FROM panel),
l AS (SELECT unnest(['source', 'source', 'view', 'view']) AS surface, unnest(['close', 'volume', 'close', 'volume']) AS field, unnest([c1, v1, c2, v2]) AS x, unnest([c0, v0, c0, v0]) AS b, unnest([0.01, 0, 0.01, 0]::DOUBLE[]) AS t FROM s)
SELECT surface, field, CASE WHEN x IS NULL THEN 'absent' WHEN abs(x - b) <= t THEN 'same' ELSE 'differs' END AS outcome, count(*) AS n FROM l GROUP BY 1, 2, 3""")
def j_reconcile(spark, sf):
    p = bars(spark, sf).select("code", "trade_date", "close", "volume", "discount")
    source = p.where("volume <> 5").withColumn("close", F.col("close") + F.when(F.col("discount") == 0.02, 1.0).otherwise(0.001))
    view = p.withColumn("volume", F.col("volume") + F.when(F.col("code") % 3 > 0, 1).otherwise(0))
    return audits.reconcile({"raw": p, "source": source, "view": view}, "raw", ["code", "trade_date"], {"close": 0.01, "volume": 0.0})


@query("""WITH s AS (SELECT 'orders' AS surface, max(CAST(o_orderdate AS DATE)) AS latest FROM orders UNION ALL SELECT 'lines', max(CAST(l_shipdate AS DATE)) FROM lineitem UNION ALL SELECT 'events', max(CAST(ts AS DATE)) FROM events) SELECT *, CAST((SELECT max(latest) FROM s) - latest AS INTEGER) AS behind FROM s""")
def a_readiness(spark, sf):
    day = lambda t, c: table(spark, sf, t).select(F.to_date(c).alias("trade_date"))
    return audits.readiness({"orders": day("orders", "o_orderdate"), "lines": day("lineitem", "l_shipdate"), "events": day("events", "ts")})


@query(f"""WITH {PANEL}, d AS (SELECT code, trade_date, discount FROM panel UNION ALL SELECT code, trade_date, NULL FROM panel WHERE volume = 3) SELECT count(*) AS n, count(*) FILTER (k > 1) AS repeated, count(*) FILTER (trade_date < '1993-01-01' OR trade_date > '2000-12-31') AS outside, count(*) FILTER (discount IS NULL) AS nulls, true AS monotonic FROM (SELECT *, count(*) OVER (PARTITION BY code, trade_date) AS k FROM d)""")
def a_prediction_audit(spark, sf):
    p = bars(spark, sf).select("code", "trade_date", "discount", "volume")
    both = p.drop("volume").unionByName(p.where("volume = 3").select("code", "trade_date", F.lit(None).cast("double").alias("discount")))
    return audits.prediction_audit(both.withColumn("place", F.unix_date("trade_date")), "discount", "1993-01-01", "2000-12-31")


@query(f"""WITH {PANEL}, c AS (SELECT trade_date, count(close) FILTER (volume > 20) AS valid FROM panel GROUP BY 1) SELECT min(valid) AS least, median(valid) AS middle, max(valid) AS most, count(*) AS dates FROM c""")
def a_coverage_summary(spark, sf):
    p = bars(spark, sf)
    c = evaluate.coverage(p.where("volume > 20"), panel.calendar(p), "close", 12)
    return c.agg(F.min("valid").alias("least"), F.median("valid").alias("middle"), F.max("valid").alias("most"), F.count(F.lit(1)).alias("dates"))


# Lookups, snapshots, events.


@query("""WITH c AS (SELECT s_suppkey AS code, s_name FROM supplier), d AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'SH' || s_suppkey WHEN 1 THEN s_suppkey || '.SH' ELSE 'none' || s_suppkey END AS key, s_name AS name FROM supplier)
SELECT code, d.key AS found_as, d.name FROM c LEFT JOIN d ON d.key IN ('SH' || code, code || '.SH')""")
def j_fallback_lookup(spark, sf):
    k = F.col("s_suppkey").cast("string")
    d = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("SH"), k)).when(F.col("s_suppkey") % 3 == 1, F.concat(k, F.lit(".SH"))).otherwise(F.concat(F.lit("none"), k)).alias("key"), F.col("s_name").alias("name"))
    code = F.col("code").cast("string")
    return audits.fallback_lookup(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code")), d, [F.concat(F.lit("SH"), code), F.concat(code, F.lit(".SH"))], "name")


@query(f"""WITH {PANEL} SELECT code, volume AS score, NULL AS error FROM panel WHERE trade_date = (SELECT max(trade_date) FROM panel WHERE trade_date < '1999-01-01') ORDER BY volume DESC, code LIMIT 10""")
def t_snapshot(spark, sf):
    p = bars(spark, sf)
    day = p.where(F.col("trade_date") < F.lit("1999-01-01").cast("date")).agg(F.max("trade_date").alias("day"))
    at = p.join(F.broadcast(day))
    return audits.latest_snapshot(at.where(F.col("trade_date") == F.col("day")), F.col("day"), "volume", 10)


@query("""SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 6000)""")
def t_tail(spark, sf):
    """The last 6,000 rows by date."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(6000).orderBy("o_orderdate", "o_orderkey")


@query("""WITH e AS (SELECT event_type AS stage, user_id % 50 AS grp, ts AS moment, CAST(CAST(round(value) AS INTEGER) AS VARCHAR) AS body FROM events),
h AS (SELECT md5(concat_ws('|', stage, grp, body)) AS event, min(row(moment, stage, grp, body)) AS m FROM e GROUP BY 1), r AS (SELECT event, m[2] AS stage, m[3] AS grp, row_number() OVER (PARTITION BY m[3] ORDER BY m[1] DESC, event) AS nth FROM h) SELECT event, stage, grp, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 20""")
def a_events_projected(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_type").alias("stage"), (F.col("user_id") % 50).alias("grp"), F.col("ts").alias("at"), F.round("value").cast("int").cast("string").alias("body"))
    return audits.projected_events(rows, None, 20).select("event", "stage", "grp", "nth")


@query("""WITH a AS (SELECT o_custkey AS k, o_orderpriority AS p, o_orderkey AS moment, 0 AS src FROM orders UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey - 7, 1 FROM orders WHERE o_orderstatus = 'F') SELECT k, p, moment, src FROM (SELECT *, row_number() OVER (PARTITION BY k, p ORDER BY moment, src) AS nth FROM a) WHERE nth = 1""")
def k_merged_trials(spark, sf):
    o = table(spark, sf, "orders")
    one = o.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("moment"), F.lit(0).alias("src"))
    two = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"), (F.col("o_orderkey") - 7).alias("moment"), F.lit(1).alias("src"))
    return audits.merged_trials(one, two, keys=["k", "p"], order=F.struct("moment", "src"))


PATHS = ["admission.deep", "deep_score", "scores.deep", "score", "quick.score", "quick_score", "legacy.value", "value"]


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 50 WHEN 1 THEN p_partkey % 60 WHEN 2 THEN p_partkey % 70 END AS s FROM part) SELECT p_partkey, s::DOUBLE AS admission, CAST(row_number() OVER (ORDER BY s DESC NULLS LAST, p_partkey) AS INTEGER) AS place FROM r""")
def t_fallback_scores(spark, sf):
    """Rank by the first of several score paths in a JSON record."""
    k = F.col("p_partkey")
    doc = F.when(k % 4 == 0, F.format_string('{"admission": {"deep": %d}, "score": 1}', k % 50)).when(k % 4 == 1, F.format_string('{"score": %d, "value": 3}', k % 60)).when(k % 4 == 2, F.format_string('{"legacy": {"value": %d}}', k % 70)).otherwise(F.lit("{}"))
    score = F.coalesce(*[F.get_json_object("doc", f"$.{p}").try_cast("double") for p in PATHS])
    df = table(spark, sf, "part").select("p_partkey", doc.alias("doc")).withColumn("admission", score)
    out = ranking.positions(df.select("p_partkey", "admission"), [], [F.col("admission").desc_nulls_last(), F.col("p_partkey")], "place")
    return out.withColumn("place", F.col("place").cast("int"))


# Portfolio.

ACCOUNTS = """pos AS (SELECT a.account, s_suppkey AS code, 5 + s_suppkey % 40 * 0.25::DOUBLE AS price, CASE WHEN (s_suppkey + account) % 3 = 0 THEN (1 + (s_suppkey * 7 + account) % 20) / 1000.0::DOUBLE END AS weight, CASE WHEN (s_suppkey * 3 + account) % 4 = 0 THEN (s_suppkey + account) % 30 * 100 END AS held,
1000000.0::DOUBLE AS equity, 20000.0::DOUBLE * (1 + account % 5) AS cash FROM supplier, (SELECT n_nationkey AS account FROM nation) a)"""


def positions(spark, sf):
    """Holdings and targets of an account per nation."""
    a = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("account")))  # 25 rows
    k, n = F.col("s_suppkey"), F.col("account")
    df = table(spark, sf, "supplier").select("s_suppkey").join(a)
    weight = F.when((k + n) % 3 == 0, (1 + (k * 7 + n) % 20) / F.lit(1000.0))
    return df.select("account", k.alias("code"), (5 + k % 40 * 0.25).alias("price"), weight.alias("weight"), F.when((k * 3 + n) % 4 == 0, (k + n) % 30 * 100).alias("held"), F.lit(1_000_000.0).alias("equity"), (20_000.0 * (1 + n % 5)).alias("cash"))


ORDERS = f"""{ACCOUNTS}, w AS (SELECT *, CAST(coalesce(floor(weight * equity / price / 100) * 100, 0) AS BIGINT) - coalesce(held, 0) AS c0 FROM pos), c AS (SELECT *, CASE WHEN abs(c0 * price) >= 0.005::DOUBLE * equity THEN c0 ELSE 0 END AS change FROM w),
q AS (SELECT *, CAST(CASE WHEN change < 0 THEN -change ELSE 0 END AS BIGINT) AS sell, CAST(CASE WHEN change > 0 THEN least(change, floor(0.015::DOUBLE * equity / price / 100) * 100) ELSE 0 END AS BIGINT) AS asked FROM c),
f AS (SELECT *, greatest(0.0, cash + sum(sell * price * (1 - 0.001::DOUBLE)) OVER (PARTITION BY account) - coalesce(sum(asked * price * (1 + 0.001::DOUBLE)) OVER (PARTITION BY account ORDER BY weight DESC NULLS LAST, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS left_over FROM q),
fills AS (SELECT account, code, price, CAST(least(asked, floor(left_over / (price * (1 + 0.001::DOUBLE)) / 100) * 100) AS BIGINT) AS buy, sell FROM f), fl AS (SELECT *, (buy + sell) * price * 0.001::DOUBLE AS fee FROM fills WHERE buy > 0 OR sell > 0)"""


def fills(spark, sf):
    return portfolio.rebalance(positions(spark, sf), ramp=0.015)


@query(f"""WITH {ORDERS} SELECT account, code, price, buy, sell, round(fee, 4) AS fee FROM fl""")
def g_rebalance(spark, sf):
    return rounded(fills(spark, sf), 4, "fee")


@query(f"""WITH {ORDERS}, m AS (SELECT pos.account, coalesce(held, 0) + coalesce(buy, 0) - coalesce(sell, 0) AS now, pos.price, cash, (coalesce(buy, 0) - coalesce(sell, 0)) * pos.price + coalesce(fee, 0) AS spent FROM pos LEFT JOIN fl ON fl.account = pos.account AND fl.code = pos.code)
SELECT account, round(sum(now * price), 3) AS value, round(max(cash) - sum(spent), 3) AS cash, count(*) FILTER (now > 0) AS holdings, round(sum(now * price) + max(cash) - sum(spent), 3) AS equity FROM m GROUP BY 1""")
def g_marked(spark, sf):
    return rounded(portfolio.marked(positions(spark, sf), fills(spark, sf)), 3, "value", "cash", "equity")


@query(f"""WITH {ORDERS} SELECT account, round(sum(buy * price), 2) AS bought, round(sum(sell * price), 2) AS sold, round(sum(fee), 3) AS fees, count(*) FILTER (buy > 0) AS buys, count(*) FILTER (sell > 0) AS sells FROM fl GROUP BY 1""")
def a_ledger(spark, sf):
    return rounded(rounded(portfolio.ledger(fills(spark, sf)), 2, "bought", "sold"), 3, "fees")


@query(f"""WITH {ORDERS} SELECT account, code, CASE WHEN buy > 0 THEN 'buy' ELSE 'sell' END AS action FROM fl WHERE code % 11 > 0 AND NOT (code % 7 = 0 AND buy > 0) AND NOT (code % 5 = 0 AND buy = 0)""")
def g_tradable_orders(spark, sf):
    k = F.col("s_suppkey")
    blocked = table(spark, sf, "supplier").select(k.alias("code"), (k % 7 == 0).alias("at_up"), (k % 5 == 0).alias("at_down"), (k % 11 == 0).alias("no_price"))
    orders = fills(spark, sf).select("account", "code", F.when(F.col("buy") > 0, "buy").otherwise("sell").alias("action"))
    return portfolio.allowed_orders(orders, blocked)


@query(f"""WITH {PANEL}, s AS (SELECT code, trade_date, volume, CASE WHEN code % 12 > 0 THEN discount < 0.1 END AS normal FROM panel), m AS (SELECT *, avg(CASE WHEN normal IS NULL THEN 0.0 ELSE 1.0::DOUBLE END) OVER (PARTITION BY trade_date) AS matched FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS place FROM m WHERE matched >= 0.95 AND normal) SELECT code, trade_date, CAST(place AS INTEGER) AS place, 0.095::DOUBLE AS target_weight FROM r WHERE place <= 10""")
def g_matched_targets(spark, sf):
    p = bars(spark, sf).select("code", "trade_date", "volume", "discount")
    status = p.where("code % 12 > 0").select("code", "trade_date", (F.col("discount") < 0.1).alias("normal"))
    out = portfolio.matched_targets(p.drop("discount"), status, "volume", 10, 0.95)
    return out.select("code", "trade_date", "place", F.round("target_weight", 6).alias("target_weight"))


@query(f"""WITH {PANEL}, r AS (SELECT code, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS place FROM panel), w AS (SELECT code, trade_date, 0.1::DOUBLE AS w FROM r WHERE place <= 10), d AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nxt FROM (SELECT DISTINCT trade_date FROM w)),
c AS (SELECT code, trade_date, w FROM w UNION ALL SELECT code, nxt, -w FROM w JOIN d USING (trade_date) WHERE nxt IS NOT NULL), p AS (SELECT code, trade_date, sum(w) AS x FROM c GROUP BY 1, 2) SELECT trade_date, round(sum(abs(x)) / 2, 6) AS turnover FROM p GROUP BY 1""")
def a_turnover(spark, sf):
    picks = scoring.equal_targets(bars(spark, sf).select("code", "trade_date", "volume"), "volume", 10, 1.0)
    return rounded(portfolio.turnover(picks, "target_weight"), 6, "turnover")


@query(f"""WITH {PANEL}, r AS (SELECT code, trade_date, rank() OVER (PARTITION BY trade_date ORDER BY discount DESC) AS place FROM panel) SELECT trade_date, count(DISTINCT code) AS holdings FROM r WHERE place <= 5 GROUP BY 1""")
def a_holding_counts(spark, sf):
    return portfolio.held_counts(scoring.top_k(bars(spark, sf).select("code", "trade_date", "discount"), "discount", 5, "all"))


@query(f"""WITH {PANEL}, t AS (SELECT code, trade_date, close, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS place FROM panel WHERE discount < 0.1), a AS (SELECT *, 0.5::DOUBLE + day(trade_date) / 62.0::DOUBLE AS market FROM t WHERE place <= 5),
w AS (SELECT *, 0.19::DOUBLE * least(1.0::DOUBLE, least(1.0::DOUBLE, market) / sum(0.19::DOUBLE) OVER (PARTITION BY trade_date)) AS weight FROM a) SELECT left(sha256(trade_date || '|' || code || '|' || place), 16) AS id, code, trade_date, round(weight, 6) AS weight, CAST(floor(weight * 1000000 / close / 100) * 100 AS BIGINT) AS amount FROM w""")
def x_recommendation(spark, sf):
    """Scores to filtered, risk-capped targets in lots, named by content."""
    p = bars(spark, sf).where("discount < 0.1")
    t = scoring.equal_targets(p.select("code", "trade_date", "volume", "close"), "volume", 5, 0.95)
    t = scoring.risk_cap(t, "target_weight", {"model": F.lit(1.0), "market": 0.5 + F.dayofmonth("trade_date") / 62.0})
    amount = (F.floor(F.col("capped") * 1_000_000 / F.col("close") / 100) * 100).cast("long")
    return t.select(portfolio.identified(t, F.col("trade_date"), F.col("code"), F.col("place")).alias("id"), "code", "trade_date", F.round("capped", 6).alias("weight"), amount.alias("amount"))


@query(f"""WITH {PANEL}, h AS (SELECT code, trade_date, name FROM panel JOIN (SELECT s_suppkey AS code, s_name AS name FROM supplier) USING (code)) SELECT CASE WHEN code % 2 = 0 THEN 'SH' ELSE 'SZ' END AS market, count(DISTINCT code) AS codes, count(*) AS n FROM h GROUP BY 1""")
def a_market_counts(spark, sf):
    named = bars(spark, sf).join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name")), "code")
    return named.groupBy(F.when(F.col("code") % 2 == 0, "SH").otherwise("SZ").alias("market")).agg(F.count_distinct("code").alias("codes"), F.count(F.lit(1)).alias("n"))


def _plan(k: int = 10, drop: int = 3):
    return f"""ab AS (SELECT code, coalesce(score, -1e30) AS score, h.code IS NOT NULL AS held FROM sc FULL JOIN h USING (code)), k AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY score DESC, code) AS in_kind, count(*) FILTER (held) OVER () AS n_held FROM ab),
p AS (SELECT *, row_number() OVER (ORDER BY score, code DESC) AS from_end FROM k WHERE held OR in_kind <= {drop} + greatest(0, {k} - n_held)), s AS (SELECT *, count(*) FILTER (held AND from_end <= {drop}) OVER () AS n_sold FROM p)
SELECT code, score, CASE WHEN held AND from_end <= {drop} THEN 'sell' WHEN NOT held AND in_kind <= n_sold + {k} - n_held THEN 'buy' WHEN held THEN 'hold' END AS action FROM s"""


@query(f"""WITH sc AS (SELECT s_suppkey AS code, CASE WHEN s_suppkey % 9 > 0 THEN s_acctbal END AS score FROM supplier), h AS (SELECT s_suppkey AS code FROM supplier WHERE s_nationkey = 3), x AS (WITH {_plan()}) SELECT * FROM x WHERE action IS NOT NULL""".replace("SELECT * FROM x WHERE", "SELECT code, score, action FROM x WHERE"))
def g_dropout_plan(spark, sf):
    s = table(spark, sf, "supplier")
    scores = s.select(F.col("s_suppkey").alias("code"), F.when(F.col("s_suppkey") % 9 > 0, F.col("s_acctbal")).alias("score"))
    return scoring.dropout_plan(scores, s.where("s_nationkey = 3").select(F.col("s_suppkey").alias("code")), 10, 3)


# Clusters.

OLD = "o AS (SELECT p_partkey AS member, p_size AS cluster FROM part)"
NEW = "n AS (SELECT p_partkey AS member, CASE WHEN p_size < 10 THEN p_size WHEN p_size < 20 THEN 100 + p_size // 2 WHEN p_size < 30 THEN 200 + p_size * 2 + p_partkey % 2 WHEN p_size < 40 AND p_partkey % 5 = 0 THEN 999 WHEN p_size < 45 THEN p_size + 300 ELSE 400 + p_partkey % 3 END AS cluster FROM part)"


@query(f"""WITH {OLD}, {NEW}, a AS (SELECT cluster AS o, count(*) AS no FROM o GROUP BY 1), b AS (SELECT cluster AS c, count(*) AS nc FROM n GROUP BY 1), k AS (SELECT o.cluster AS o, n.cluster AS c, count(*) AS k FROM o JOIN n USING (member) GROUP BY 1, 2),
j AS (SELECT *, count(*) OVER (PARTITION BY c) AS olds, count(*) OVER (PARTITION BY o) AS news FROM k JOIN a USING (o) JOIN b USING (c)), e AS (SELECT *, CASE WHEN k = no AND k = nc THEN 'unchanged' WHEN olds = 1 AND news = 1 AND k / (no + nc - k) >= 0.5 THEN 'membership_changed' WHEN olds > 1 THEN 'merged' WHEN news > 1 THEN 'split' ELSE 'reclustered' END AS event FROM j)
SELECT c AS cluster, min(event) AS event, max(CASE WHEN event IN ('unchanged', 'membership_changed') THEN o END) AS continues FROM e GROUP BY 1""")
def r_region_identity(spark, sf):
    p, s, k = table(spark, sf, "part"), F.col("p_size"), F.col("p_partkey")
    now = F.when(s < 10, s).when(s < 20, 100 + F.floor(s / 2)).when(s < 30, 200 + s * 2 + k % 2).when((s < 40) & (k % 5 == 0), 999).when(s < 45, s + 300).otherwise(400 + k % 3)
    return graph.region_identity(p.select(k.alias("member"), s.alias("cluster")), p.select(k.alias("member"), now.alias("cluster")))


@query("""WITH l AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 4 = 0 THEN -p_partkey ELSE p_size END AS root, p_retailprice AS score FROM part), d AS (SELECT *, count(*) OVER (PARTITION BY root) AS size, row_number() OVER (PARTITION BY root ORDER BY score DESC, node) AS nth FROM l),
s AS (SELECT node FROM d WHERE size = 1 ORDER BY score DESC, node LIMIT 8), t AS (SELECT node FROM d ORDER BY score DESC, node LIMIT 12)
SELECT node, 'family_top' || k AS feature_set FROM d, range(1, 4) x(k) WHERE size > 1 AND nth <= k UNION ALL SELECT node, 'family_top' || k FROM s, range(1, 4) x(k) UNION ALL SELECT node, 'quality_top12' FROM t""")
def r_recommended(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("node"), F.when(k % 4 == 0, -k).otherwise(F.col("p_size")).alias("root"), F.col("p_retailprice").alias("score"))
    return graph.recommended(p.select("node", "root"), p.select("node", "score"))


@query()
def r_complete_linkage(spark, sf):
    """Nations by how unlike their suppliers' and customers' balances are; tested against a plain loop."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("x"))
    x = n.join(c, "n_nationkey", "left").select(F.col("n_nationkey").alias("node"), F.coalesce("x", F.lit(0.0)).alias("x"))
    a, b = x.withColumnsRenamed({"node": "a", "x": "xa"}), x.withColumnsRenamed({"node": "b", "x": "xb"})
    return graph.complete_linkage(x.select("node"), a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.abs(F.col("xa") - F.col("xb")).alias("d")), 500.0)


@query(f"""WITH {PAIRS}, n AS (SELECT node, node % 7 AS g, sum(w) AS s FROM (SELECT a AS node, w FROM w UNION ALL SELECT -1 - b, w FROM w WHERE false) GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, node) AS nth FROM n), rep AS (SELECT node, g FROM r WHERE nth = 1)
SELECT r.node, rep.node AS representative FROM r JOIN rep USING (g) WHERE r.node <> rep.node""")
def r_representative_links(spark, sf):
    e = pair_edges(spark, sf).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("score"))
    groups = e.select("node", (F.col("node") % 7).alias("root"))
    rep = graph.representatives(groups, e).select("root", "representative")
    return groups.join(rep, "root").where("node != representative").select("node", "representative")


# Scans and sinks: written to the shared folder, then read back.


def _folder(spark) -> str:
    return f"{graph.shared_folder(spark)}/sinks/{uuid.uuid4().hex}"


def _lines(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("year"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE year(o_orderdate) IN (1993, 1996)""")
def s_partitions_by_date(spark, sf):
    path = _folder(spark)
    tables.write_partitioned(_lines(spark, sf), path, ["year"])
    return tables.partitions_of(spark, path, "year", [1993, 1996]).select("o_orderkey", "day")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 16 IN (3, 9)""")
def s_partitions_by_code(spark, sf):
    path = _folder(spark)
    tables.write_partitioned(_lines(spark, sf).withColumn("bucket", F.col("o_custkey") % 16), path, ["bucket"])
    return tables.partitions_of(spark, path, "bucket", [3, 9]).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN year(o_orderdate) = 1995 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders""")
def k_overwrite_partitions(spark, sf):
    path = _folder(spark)
    tables.write_partitioned(_lines(spark, sf), path, ["year"])
    tables.overwrite_partitions(_lines(spark, sf).where("year = 1995").withColumn("o_totalprice", F.lit(0.0)), path, ["year"])
    return spark.read.parquet(path).select("o_orderkey", "day", "o_totalprice")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < '1996-03-10'""")
def k_truncate(spark, sf):
    path = _folder(spark)
    tables.write_partitioned(_lines(spark, sf), path, ["year"])
    tables.truncated(path, "year", "day", F.lit("1996-03-10").cast("date"), spark)
    return spark.read.parquet(path).select("o_orderkey", "day")


@query("""WITH s AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS source_date FROM orders GROUP BY 1), t AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS target_date FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_custkey, source_date, target_date FROM s LEFT JOIN t USING (o_custkey) WHERE target_date IS NULL OR target_date < source_date""")
def k_stale_keys(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    return tables.stale_keys(o, o.where("o_orderstatus = 'F'"), "o_custkey", "day")


@query("""SELECT s_suppkey AS code, s_acctbal AS weight FROM supplier""")
def k_csv(spark, sf):
    path = _folder(spark)
    df = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_acctbal").alias("weight"))
    tables.write_csv(df, path)
    return tables.read_csv(spark, path, df.schema)


@query("""SELECT user_id, count(*) * 2 AS n FROM events GROUP BY 1""")
def k_append_events(spark, sf):
    path = _folder(spark)
    e = table(spark, sf, "events").select("event_id", "user_id", "props")
    for _ in range(2):
        tables.append_events(e, path)
    return tables.read_events(spark, path, e.schema).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT s_suppkey % 90 AS code, CASE WHEN s_suppkey % 30 = 0 THEN -0.001::DOUBLE ELSE 0.02::DOUBLE END AS weight FROM supplier) SELECT 'repeated' AS fault, CAST(code AS VARCHAR) AS detail FROM t GROUP BY code HAVING count(*) > 1 UNION ALL SELECT 'negative', CAST(code AS VARCHAR) FROM t WHERE weight < 0
UNION ALL SELECT 'sum', CAST(round(sum(weight), 6) AS VARCHAR) FROM t HAVING sum(weight) > 1 + 1e-9""")
def s_validated_targets(spark, sf):
    k = F.col("s_suppkey")
    return tables.validated_targets(table(spark, sf, "supplier").select((k % 90).alias("code"), F.when(k % 30 == 0, -0.001).otherwise(0.02).alias("weight")))


@query("""SELECT s_suppkey AS code, s_name AS name, NULL::DOUBLE AS turnover, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier""")
def p_conformed(spark, sf):
    df = tables.first_available(table(spark, sf, "supplier"), {"code": ["ts_code", "s_suppkey"], "name": ["s_name", "name"], "nation": ["s_nationkey"], "other": ["none"]}).withColumn("nation", F.col("nation").cast("string"))
    kinds = T.StructType([T.StructField("code", T.LongType()), T.StructField("name", T.StringType()), T.StructField("turnover", T.DoubleType()), T.StructField("nation", T.DoubleType())])
    return tables.conform(df, kinds)


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN day END AS parsed, CASE WHEN o_orderkey % 4 < 3 THEN day - 400 END AS read_from FROM d""")
def p_lenient_dates(spark, sf):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.date_format(d, "yyyyMMdd")).when(k % 4 == 1, F.date_format(d, "yyyy/M/d")).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("not a day")
    parsed = tables.lenient_date(text)
    return table(spark, sf, "orders").select("o_orderkey", parsed.alias("parsed"), tables.warm_up(parsed).alias("read_from"))


# Expression texts: a registry with a row a part, its shape by size and its numbers by key; some spelt in capitals and with blanks.

SHAPES = ("ts_mean(close, {n})", " TS_Mean( close,{n} )", "rank(ts_delta(volume, {n}))", "where(close > {n}, high, low)", "sign_power(close / {n} - 1.5, 2)", "ema(ts_std(volume, {n}), {m}) * rank(close)", "ts_corr(close, volume, {n})", "tanh(close / {n}) + adv{m}")
TEXTS = "l AS (SELECT p_partkey AS name, replace(replace(" + f"{list(SHAPES)}" + f"[1 + p_size % {len(SHAPES)}], '{{n}}', CAST(2 + p_partkey % 20 AS VARCHAR)), '{{m}}', CAST(3 + p_partkey % 7 AS VARCHAR)) AS expression FROM part)"


def registered(spark, sf):
    k = F.col("p_partkey")
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (1 + F.col("p_size") % len(SHAPES)).cast("int"))
    text = F.replace(F.replace(shape, F.lit("{n}"), (2 + k % 20).cast("string")), F.lit("{m}"), (3 + k % 7).cast("string"))
    return table(spark, sf, "part").select(k.alias("name"), text.alias("expression"))


@query(f"""WITH {TEXTS}, t AS (SELECT name, lower(regexp_replace(expression, '\\s+', '', 'g')) AS text FROM l)
SELECT name, text, len(regexp_extract_all(text, '(ts_mean|ts_rank|ts_zscore|decay_linear|ema|sma|wma)\\(')) AS smooth, len(regexp_extract_all(text, 'where\\(')) AS branches, len(regexp_extract_all(text, '(tanh|sigmoid|sign_power)\\(')) AS nonlinear, len(regexp_extract_all(text, '\\*')) AS products FROM t""")
def e_profiles(spark, sf):
    t = registered(spark, sf).withColumn("text", dsl.normalised(F.col("expression")))
    return t.select("name", "text", *[c.alias(n) for n, c in dsl.smoothness(F.col("text")).items()])


@query(f"""WITH {TEXTS}, t AS (SELECT name, regexp_replace(lower(regexp_replace(expression, '\\s+', '', 'g')), '([(,])-?[0-9]+(\\.[0-9]+)?', '\\1#', 'g') AS shape FROM l)
SELECT shape, count(*) AS n, min(name) AS first FROM t GROUP BY 1""")
def e_twins(spark, sf):
    """Structural twins: expressions that differ in their numbers only."""
    t = registered(spark, sf).withColumn("shape", dsl.shape(F.col("expression")))
    return t.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


@query()
def e_structure(spark, sf):
    """Fields, depth, look-back and signature of each different expression, told by tasks; tested against values written out."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("fields string, depth int, lookback int, signature string")
    def told(text):
        import pandas as pd

        return pd.DataFrame([(",".join(sorted(dsl.fields(x))), dsl.depth(x), dsl.lookback(x), dsl.signature(x)) for x in text], columns=["fields", "depth", "lookback", "signature"])

    texts = registered(spark, sf).groupBy(dsl.normalised(F.col("expression")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return texts.select("text", "n", told("text").alias("t")).select("text", "n", "t.*")


# Statistics with costs.


@query(f"""WITH {PANEL}, {LABEL}, r AS (SELECT trade_date, code, label, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS place FROM panel JOIN lab USING (code, trade_date) WHERE label IS NOT NULL), d AS (SELECT trade_date, avg(label) - 0.003::DOUBLE * 0.5 AS net, avg(label) AS gross FROM r WHERE place <= 10 GROUP BY 1), n AS (SELECT trade_date, sum(ln(1 + net)) OVER (ORDER BY trade_date) AS a, sum(ln(1 + gross)) OVER (ORDER BY trade_date) AS b FROM d WHERE net > -1)
SELECT trade_date, round(a, 6) + 0.0 AS log_net, round(a - b, 6) + 0.0 AS cost_drag FROM n""")
def w_cost_drag(spark, sf):
    """Running log value of the ten best after costs, and what costs took of it."""
    from pyspark.sql import Window

    p = bars(spark, sf)
    j = p.join(labels.forward_label(p, "close", 5, 1), ["code", "trade_date"]).where("label IS NOT NULL")
    daily = evaluate.top_mean(j, "volume", "label", 10).select("trade_date", (F.col("top_mean") - 0.003 * 0.5).alias("net"), F.col("top_mean").alias("gross")).where("net > -1")
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date")
    a, b = F.sum(F.log1p("net")).over(w), F.sum(F.log1p("gross")).over(w)
    return daily.select("trade_date", (F.round(a, 6) + 0.0).alias("log_net"), (F.round(a - b, 6) + 0.0).alias("cost_drag"))
