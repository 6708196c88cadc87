"""Queries of panel assembly, evaluation, scoring, sets, graphs and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import factor
from ..operators import evaluate, graph, labels, panel, scoring
from ..sources import tables
from ..streaming import events as streams
from .views import FEE, PANEL, cs, lag, line_count, rank, spread, ts
from .views import panel as bars
from .views import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})  # no negative zero


# Scans and sinks.


@query("""SELECT l_orderkey, l_suppkey, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30' AND l_suppkey = 7""")
def s_predicate_scan(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("l_shipdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-06-30").cast("timestamp_ntz")) & (F.col("l_suppkey") == 7)
    return tables.scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_suppkey", "l_shipdate", "no_such_column"], hit)


@query("""SELECT min(CAST(l_shipdate AS DATE)) AS first_date, max(CAST(l_shipdate AS DATE)) AS last_date, count(DISTINCT CAST(l_shipdate AS DATE)) AS dates, count(*) AS n FROM lineitem""")
def s_date_metadata(spark, sf):
    d = F.to_date("l_shipdate")
    return table(spark, sf, "lineitem").agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"), F.countDistinct(d).alias("dates"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PANEL}, c AS (SELECT *, count(*) OVER (PARTITION BY code) AS n, count(*) FILTER (trade_date BETWEEN '1997-01-01' AND '1997-12-31') OVER (PARTITION BY code) AS m FROM panel)
SELECT code, trade_date, volume FROM c WHERE n >= 20 AND m >= 60 AND trade_date BETWEEN '1997-01-01' AND '1997-12-31'""")
def s_market_panel(spark, sf):
    return panel.market_panel(bars(spark, sf), "1997-01-01", "1997-12-31", 20, 60, ["volume"])


@query(f"""WITH {PANEL} SELECT code, min(trade_date) AS first_date, max(trade_date) AS last_date FROM panel GROUP BY code""")
def s_instrument_book(spark, sf):
    return panel.instrument_book(bars(spark, sf))


@query(f"""WITH {PANEL} SELECT a.trade_date, round(a.close, 6) AS c0, round(b.close, 6) AS c1, round(c.close, 6) AS c2 FROM panel a JOIN panel b USING (trade_date) JOIN panel c USING (trade_date)
WHERE a.code = 0 AND b.code = 1 AND c.code = 2 AND a.trade_date <= '2000-12-31'""")
def s_benchmark_align(spark, sf):
    wide = bars(spark, sf).where(F.col("code").isin(0, 1, 2) & (F.col("trade_date") <= F.lit("2000-12-31").cast("date"))).groupBy("trade_date").pivot("code", [0, 1, 2]).agg(F.first("close"))
    return wide.dropna().select("trade_date", *[F.round(F.col(str(i)), 6).alias(f"c{i}") for i in range(3)])


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 50""")
def s_json_props(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf, "events").select("event_id", k.alias("k")).where("k > 50")


@query("""SELECT CAST(d AS DATE) AS trade_date FROM (SELECT unnest(generate_series(min(date_trunc('day', o_orderdate))::TIMESTAMP, max(date_trunc('day', o_orderdate))::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM orders) WHERE isodow(d) < 6""")
def s_business_days(spark, sf):
    ends = table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("trade_date"))
    return days.where(F.weekday("trade_date") < 5)


@query(f"""WITH {PANEL} SELECT code, trade_date, round(close, 6) AS close, 'base' AS origin FROM panel WHERE trade_date < '2001-01-01'
UNION ALL SELECT code, trade_date, round(close * 1.01::DOUBLE, 6), 'delta' FROM panel WHERE trade_date >= '2001-01-01'""")
def k_tail_replace(spark, sf):
    p = bars(spark, sf).select("code", "trade_date", "close")
    delta = p.withColumn("close", F.col("close") * 1.01).withColumn("origin", F.lit("delta"))
    out = panel.tail_replace(p.withColumn("origin", F.lit("base")), delta, "trade_date", F.lit("2001-01-01").cast("date"))
    return rounded(out, 6, "close")


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def k_upsert_latest(spark, sf):
    return panel.latest_per_key(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


DAYS = "days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS cal_idx FROM (SELECT DISTINCT trade_date FROM panel))"


@query(f"""WITH {PANEL}, {DAYS}, life AS (SELECT code, min(trade_date) AS f, max(trade_date) AS l FROM panel GROUP BY code),
grid AS (SELECT code, trade_date FROM life JOIN days ON trade_date BETWEEN f AND l)
SELECT code, trade_date, volume, last_value(volume IGNORE NULLS) {ts()} AS filled FROM grid LEFT JOIN panel USING (code, trade_date)""")
def k_calendar_densify(spark, sf):
    p = bars(spark, sf)
    return panel.densify(p, panel.calendar(p), "volume")


@query(f"""WITH {PANEL} SELECT count(*) AS n, min(code) AS min_code, max(code) AS max_code, CAST(sum(CAST(CAST('0x' || left(md5(len(CAST(code AS VARCHAR)) || ':' || code || len(CAST(trade_date AS VARCHAR)) || ':' || trade_date || len(CAST(CAST(volume AS BIGINT) AS VARCHAR)) || ':' || CAST(volume AS BIGINT)), 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS content FROM panel""")
def k_fingerprint(spark, sf):
    return tables.fingerprint(bars(spark, sf).select("code", "trade_date", F.col("volume").cast("long")), ["code"]).withColumn("content", F.col("content").cast("string"))


# Projections and predicates.


@query("""SELECT s_suppkey, d || '.' || upper(m) AS dotted, m || '.' || d AS prefixed, d || m AS suffixed, upper(m) || d AS "upper",
CASE WHEN regexp_matches(d, '^(6|9|5)') THEN 'sh' WHEN regexp_matches(d, '^(8|4)') THEN 'bj' ELSE 'sz' END AS market
FROM (SELECT s_suppkey, lpad(CAST(600000 - s_suppkey * 3001 AS VARCHAR), 6, '0') AS d, CASE WHEN s_suppkey % 2 = 0 THEN 'sh' ELSE 'sz' END AS m FROM supplier)""")
def p_code_dialects(spark, sf):
    digits = F.lpad((600000 - F.col("s_suppkey") * 3001).cast("string"), 6, "0")
    code = F.concat(digits, F.lit("."), F.when(F.col("s_suppkey") % 2 == 0, "SH").otherwise("SZ"))
    return table(spark, sf, "supplier").select("s_suppkey", *[c.alias(n) for n, c in panel.code_dialects(code).items()], panel.market_of(digits).alias("market"))


@query("""SELECT p_partkey, p_name, regexp_matches(p_name, '(?i)^(\\*?st|small)|ring') AS distressed, left(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), 80) AS alias FROM part""")
def p_name_rules(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_name").rlike(r"(?i)^(\*?st|small)|ring").alias("distressed"), F.substring(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_"), 1, 80).alias("alias"))


LIMITS = f"""b AS (SELECT *, {lag('close', 1)} AS pre_close, CASE WHEN CAST(code AS VARCHAR) LIKE '8%' OR CAST(code AS VARCHAR) LIKE '4%' THEN 0.30::DOUBLE
WHEN CAST(code AS VARCHAR) LIKE '68%' OR CAST(code AS VARCHAR) LIKE '30%' THEN 0.20::DOUBLE WHEN code % 7 = 0 THEN 0.05::DOUBLE ELSE 0.10::DOUBLE END AS rate FROM panel)"""


@query(f"""WITH {PANEL}, {LIMITS}, l AS (SELECT *, pre_close * (1 + rate) AS up, pre_close * (1 - rate) AS dn FROM b)
SELECT code, trade_date, round(up, 5) AS up_limit, round(dn, 5) AS down_limit, coalesce(close >= up - 1e-4, false) AS close_at_up, coalesce(close <= dn + 1e-4, false) AS close_at_down,
coalesce(high >= up, false) AS hit_up, coalesce(low <= dn, false) AS hit_down, coalesce(low >= up - 1e-4 AND high <= up + 1e-4, false) AS sealed_up FROM l""")
def p_limit_flags(spark, sf):
    p = panel.previous_close(bars(spark, sf)).withColumn("rate", panel.limit_rate(F.col("code").cast("string"), F.col("code") % 7 == 0))
    return rounded(panel.limit_flags(p), 5, "up_limit", "down_limit").select("code", "trade_date", "up_limit", "down_limit", "close_at_up", "close_at_down", "hit_up", "hit_down", "sealed_up")


@query(f"""WITH {PANEL}, b AS (SELECT *, {lag('close', 1)} AS pre FROM panel)
SELECT code, trade_date, round((close - pre) / pre * 100, 5) AS pct_chg, round((high - low) / pre * 100, 5) AS amp FROM b""")
def w_previous_close(spark, sf):
    return rounded(panel.previous_close(bars(spark, sf)), 5, "pct_chg", "amp").select("code", "trade_date", "pct_chg", "amp")


@query(f"""WITH {PANEL}, v AS (SELECT code, trade_date, CASE WHEN volume > 10 THEN close END AS v FROM panel)
SELECT code, trade_date, round((v / last_value(v IGNORE NULLS) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1) * 100, 5) AS pct_change,
round(v / first_value(v IGNORE NULLS) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 100, 5) AS index100,
round((v - avg(v) OVER (PARTITION BY code)) / stddev_pop(v) OVER (PARTITION BY code), 5) AS zscore FROM v""")
def p_display(spark, sf):
    p = bars(spark, sf).select("code", "trade_date", F.when(F.col("volume") > 10, F.col("close")).alias("v"))
    return rounded(panel.display(p, "v"), 5, "pct_change", "index100", "zscore").drop("v")


@query(f"""WITH {PANEL} SELECT code, trade_date, round(coalesce(CASE WHEN code % 3 = 0 THEN close * 2 END, close * (1 + discount)), 5) AS adj_close, round(amount * 10 / nullif((volume - 5) * {FEE}::DOUBLE, 0), 5) AS vwap FROM panel""")
def p_adjusted_price(spark, sf):
    vendor = F.when(F.col("code") % 3 == 0, F.col("close") * 2)
    return bars(spark, sf).select("code", "trade_date", F.round(F.coalesce(vendor, F.col("close") * (1 + F.col("discount"))), 5).alias("adj_close"), F.round(F.try_divide(F.col("amount") * 10, (F.col("volume") - 5) * FEE), 5).alias("vwap"))


# Joins.


@query(f"""WITH {PANEL}, d AS (SELECT o_custkey % 100 AS code, CAST(o_orderdate AS DATE) AS ann_date, max(o_totalprice) AS equity FROM orders GROUP BY 1, 2)
SELECT p.code, p.trade_date, d.ann_date, d.equity FROM panel p ASOF LEFT JOIN d ON p.code = d.code AND p.trade_date >= d.ann_date""")
def j_asof(spark, sf):
    d = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 100).alias("code"), F.to_date("o_orderdate").alias("ann_date")).agg(F.max("o_totalprice").alias("equity"))
    return panel.asof_join(bars(spark, sf).select("code", "trade_date"), d, "code", "trade_date", "ann_date", ["equity"])


SPANS = """spans AS (SELECT o_custkey AS code, o_orderkey AS name, CAST(o_orderdate AS DATE) AS s, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS e FROM orders)"""


@query(f"""WITH {SPANS}, points AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date FROM lineitem) SELECT p.code, p.trade_date, (SELECT arg_max(name, (s, name)) FROM spans WHERE spans.code = p.code AND p.trade_date >= s AND (e IS NULL OR p.trade_date <= e)) AS name FROM points p""")
def j_interval_lookup(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = F.to_date("o_orderdate")
    spans = table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("name"), d.alias("s"), F.date_sub(F.lead(d).over(w), 1).alias("e"))
    points = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date"))
    return panel.interval_lookup(points, spans, "code", "trade_date", "s", "e", ["name"])


@query(f"""WITH {PANEL} SELECT s_suppkey AS code, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT code FROM panel WHERE trade_date = (SELECT max(trade_date) FROM panel))""")
def j_anti_coverage_gap(spark, sf):
    p = bars(spark, sf).select("code", "trade_date")
    newest = p.agg(F.max("trade_date").alias("trade_date"))
    there = p.join(F.broadcast(newest), "trade_date", "left_semi").select("code")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), "s_name").join(there, "code", "left_anti")


@query(f"""WITH {PANEL}, a AS (SELECT code, trade_date, close, volume FROM panel WHERE volume <> 1), b AS (SELECT code, trade_date, CASE WHEN volume > 40 THEN close * 1.1::DOUBLE ELSE close END AS close, volume + CASE WHEN discount = 0.05 THEN 1 ELSE 0 END AS volume FROM panel WHERE volume <> 2),
x AS (SELECT a.code IS NOT NULL AS ia, b.code IS NOT NULL AS ib, a.close AS ac, b.close AS bc, a.volume AS av, b.volume AS bv FROM a FULL JOIN b USING (code, trade_date)),
s AS (SELECT 'close' AS field, ia, ib, ac AS p, bc AS q FROM x UNION ALL SELECT 'volume', ia, ib, av, bv FROM x)
SELECT field, CASE WHEN NOT ib THEN 'only_left' WHEN NOT ia THEN 'only_right' WHEN p IS NOT DISTINCT FROM q OR coalesce(abs(p - q) <= 1e-8 + 1e-8 * abs(q), false) THEN 'same' ELSE 'differs' END AS outcome, count(*) AS n FROM s GROUP BY 1, 2""")
def j_tolerant_diff(spark, sf):
    p = bars(spark, sf).select("code", "trade_date", "close", "volume", "discount")
    close, volume = F.when(F.col("volume") > 40, F.col("close") * 1.1).otherwise(F.col("close")), F.col("volume") + F.when(F.col("discount") == 0.05, 1).otherwise(0)
    b = p.where("volume <> 2").withColumns({"close": close, "volume": volume})
    return panel.tolerant_diff(p.where("volume <> 1"), b, ["code", "trade_date"], ["close", "volume"])


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def j_semi_anti(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    big = o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(big, "c_custkey", "left_semi").join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


# Aggregations.


FACTORS = f"""fx AS (SELECT code, trade_date, close AS f1, volume AS f2, high - low AS f3, close * volume AS f4, {lag('close', 1)} AS f5 FROM panel)"""


def five_factors(spark, sf):
    return factor_columns(bars(spark, sf))


def factor_columns(p: DataFrame, *more: str) -> DataFrame:
    return p.select("code", "trade_date", *more, F.col("close").alias("f1"), F.col("volume").alias("f2"), (F.col("high") - F.col("low")).alias("f3"), (F.col("close") * F.col("volume")).alias("f4"), factor.ts_shift(F.col("close"), 1).alias("f5"))


def sql_corr(x: str, y: str) -> str:
    return f"CASE WHEN count({x}) FILTER ({y} IS NOT NULL) >= 10 AND stddev_pop({x}) FILTER ({y} IS NOT NULL) > 1e-10 AND stddev_pop({y}) FILTER ({x} IS NOT NULL) > 1e-10 THEN corr({x}, {y}) END"


@query(f"""WITH {PANEL}, d AS (SELECT trade_date, {sql_corr('close', 'volume')} AS c FROM panel GROUP BY 1) SELECT trade_date, round(c, 6) AS corr FROM d""")
def a_daily_pearson(spark, sf):
    return rounded(evaluate.daily_correlation(bars(spark, sf), "close", "volume"), 6, "corr").select("trade_date", "corr")


RANKED = f"""r AS (SELECT trade_date, {rank('close')} AS a, {rank('volume')} AS b FROM panel), d AS (SELECT trade_date, {sql_corr('a', 'b')} AS c FROM r GROUP BY 1)"""


@query(f"""WITH {PANEL}, {RANKED} SELECT trade_date, round(c, 6) AS corr FROM d""")
def a_daily_spearman(spark, sf):
    return rounded(evaluate.daily_correlation(bars(spark, sf), "close", "volume", ranked=True), 6, "corr").select("trade_date", "corr")


@query(f"""WITH {PANEL}, {RANKED} SELECT round(avg(abs(c)), 6) AS mean, round(quantile_cont(abs(c), 0.9), 6) AS p90, round(max(abs(c)), 6) AS max, count(c) AS days FROM d""")
def a_correlation_summary(spark, sf):
    return rounded(evaluate.correlation_summary(evaluate.daily_correlation(bars(spark, sf), "close", "volume", ranked=True)), 6, "mean", "p90", "max")


@query(f"""WITH {PANEL}, {FACTORS}, d AS (SELECT trade_date, {', '.join(f'{sql_corr(a, b)} AS {a}{b}' for a, b in (('f1','f2'),('f1','f3'),('f1','f4'),('f1','f5'),('f2','f3'),('f2','f4'),('f2','f5'),('f3','f4'),('f3','f5'),('f4','f5')))} FROM fx GROUP BY 1),
u AS (SELECT * FROM d UNPIVOT INCLUDE NULLS (c FOR p IN (f1f2, f1f3, f1f4, f1f5, f2f3, f2f4, f2f5, f3f4, f3f5, f4f5)))
SELECT left(p, 2) AS a, right(p, 2) AS b, round(avg(c), 6) AS mean, round(avg(abs(c)), 6) AS mean_abs, round(quantile_cont(abs(c), 0.9), 6) AS p90_abs, round(max(abs(c)), 6) AS max_abs, count(c) AS days FROM u GROUP BY p""")
def a_pairwise(spark, sf):
    return rounded(evaluate.pairwise(five_factors(spark, sf), ["f1", "f2", "f3", "f4", "f5"]), 6, "mean", "mean_abs", "p90_abs", "max_abs")


LABEL = f"""{DAYS}, pos AS (SELECT code, trade_date, cal_idx, close FROM panel JOIN days USING (trade_date)),
lab AS (SELECT t.code, t.trade_date, e.close AS entry, x.close / e.close - 1 AS label FROM pos t LEFT JOIN pos e ON e.code = t.code AND e.cal_idx = t.cal_idx + 1 LEFT JOIN pos x ON x.code = t.code AND x.cal_idx = t.cal_idx + 6)"""


@query(f"""WITH {PANEL}, {LABEL} SELECT code, trade_date, round(label, 6) AS label FROM lab""")
def w_forward_label(spark, sf):
    return rounded(labels.forward_label(bars(spark, sf), "close", 5, 1), 6, "label")


@query(f"""WITH {PANEL}, {LABEL}, j AS (SELECT trade_date, volume AS x, label AS y FROM panel JOIN lab USING (code, trade_date) WHERE label IS NOT NULL),
r AS (SELECT trade_date, {rank('x')} AS a, {rank('y')} AS b FROM j), d AS (SELECT trade_date, CASE WHEN count(*) >= 5 AND stddev_pop(a) > 1e-10 AND stddev_pop(b) > 1e-10 THEN corr(a, b) END AS c FROM r GROUP BY 1)
SELECT round(avg(c), 6) AS ic, round(avg(c) / stddev_samp(c), 6) AS ir, count(c) AS days FROM d""")
def a_rank_ic(spark, sf):
    p = bars(spark, sf)
    j = p.join(labels.forward_label(p, "close", 5, 1), ["code", "trade_date"])
    return rounded(evaluate.information(evaluate.daily_correlation(j, "volume", "label", least=5, ranked=True)), 6, "ic", "ir")


@query(f"""WITH {PANEL}, {DAYS} SELECT trade_date, count(close) FILTER (volume > 20) AS valid, count(close) FILTER (volume > 20) < 12 AS short FROM days LEFT JOIN panel USING (trade_date) GROUP BY 1""")
def a_coverage(spark, sf):
    p = bars(spark, sf)
    return evaluate.coverage(p.where("volume > 20"), panel.calendar(p), "close", 12)


@query(f"""WITH {PANEL}, {FACTORS}, m AS (SELECT year(trade_date) AS grp, avg(CASE WHEN f1 > 3000 THEN 1.0::DOUBLE ELSE 0 END) AS f1, avg(CASE WHEN f5 IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS f5 FROM fx GROUP BY 1)
SELECT grp, CASE WHEN f5 >= f1 THEN 'f5' ELSE 'f1' END AS worst_field, round(greatest(f1, f5), 6) AS worst_missing FROM m""")
def a_missing_ratio(spark, sf):
    fx = five_factors(spark, sf).withColumn("f1", F.when(F.col("f1") <= 3000, F.col("f1")))
    return rounded(evaluate.missing_ratio(fx, ["f1", "f5"], F.year("trade_date")), 6, "worst_missing")


@query("""WITH l AS (SELECT o_custkey AS code, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders GROUP BY 1), g AS (SELECT *, (SELECT max(last_date) FROM l) - last_date AS gap_days FROM l)
SELECT code, last_date, gap_days, CASE WHEN gap_days = 0 THEN 'current' WHEN gap_days <= 5 THEN 'recent' WHEN gap_days <= 30 THEN 'stale' ELSE 'inactive' END AS bucket FROM g""")
def a_activity(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("trade_date"))
    return evaluate.activity(o)


@query("""SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def a_duplicate_keys(spark, sf):
    return evaluate.duplicate_keys(table(spark, sf, "lineitem"), ["l_suppkey", "l_shipdate"])


@query(f"""WITH {PANEL} SELECT count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (close > high + 1e-9 OR close < low - 1e-9) AS close_outside, count(*) FILTER (close < 0) AS negative, count(*) FILTER (volume IS NULL) AS no_volume, count(*) AS n FROM panel""")
def a_price_checks(spark, sf):
    return evaluate.price_checks(bars(spark, sf))


@query(f"""WITH {PANEL}, c AS (SELECT avg(CASE WHEN volume < 5 THEN 1.0::DOUBLE ELSE 0 END) AS thin, CAST(count(*) FILTER (high < low) AS DOUBLE) AS crossed FROM panel)
SELECT 'thin' AS name, round(thin, 6) AS value, 0.05::DOUBLE AS most, thin <= 0.05 AS passed FROM c UNION ALL SELECT 'crossed', crossed, 0.0::DOUBLE, crossed <= 0 FROM c""")
def a_quality_gate(spark, sf):
    limits = {"thin": (F.avg((F.col("volume") < 5).cast("double")), 0.05), "crossed": (F.count_if(F.col("high") < F.col("low")), 0.0)}
    return rounded(evaluate.checks(bars(spark, sf), limits), 6, "value")


@query(f"""WITH {PANEL}, e AS (SELECT s_suppkey AS code, DATE '1997-03-01' + CAST(i AS INTEGER) AS trade_date FROM supplier, range(5) t(i))
SELECT code FROM e GROUP BY code HAVING count(*) FILTER ((code, trade_date) IN (SELECT code, trade_date FROM panel)) = 0""")
def a_absent_everywhere(spark, sf):
    start = F.lit("1997-03-01").cast("date")
    e = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.explode(F.sequence(start, F.date_add(start, 4))).alias("trade_date"))
    return evaluate.absent_everywhere(bars(spark, sf), e)


@query(f"""WITH {PANEL}, {LABEL}, r AS (SELECT trade_date, label, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS r FROM panel JOIN lab USING (code, trade_date))
SELECT trade_date, round(avg(label), 6) AS top_mean FROM r WHERE r <= 5 GROUP BY 1""")
def a_top_mean(spark, sf):
    p = bars(spark, sf)
    return rounded(evaluate.top_mean(p.join(labels.forward_label(p, "close", 5, 1), ["code", "trade_date"]), "volume", "label", 5), 6, "top_mean")


@query(f"""WITH {PANEL}, r AS (SELECT trade_date, discount, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS r FROM panel), d AS (SELECT trade_date, avg(CASE WHEN discount >= 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS s FROM r WHERE r <= 5 GROUP BY 1)
SELECT round(avg(s), 6) AS mean, round(quantile_cont(s, 0.95), 6) AS p95, arg_max(s, trade_date) AS latest, avg(s) >= 0.05 OR quantile_cont(s, 0.95) >= 0.15 AS blocked FROM d""")
def a_exposure_guard(spark, sf):
    return rounded(evaluate.exposure(bars(spark, sf), "volume", F.col("discount") >= 0.1, 5), 6, "mean", "p95")


@query(f"""WITH {PANEL}, f AS (SELECT median(close) AS med FROM panel WHERE trade_date < '1999-01-01'), s AS (SELECT median(abs(close - med)) * 1.4826::DOUBLE AS mad FROM panel, f WHERE trade_date < '1999-01-01')
SELECT code, trade_date, round(least(greatest((close - med) / mad, -3.0::DOUBLE), 3.0::DOUBLE), 5) AS z FROM panel, f, s""")
def a_robust_scale(spark, sf):
    return rounded(evaluate.robust_scale(bars(spark, sf), "close", F.col("trade_date") < F.lit("1999-01-01").cast("date")), 5, "z").select("code", "trade_date", "z")


RETURNS = """t AS (SELECT trade_date, sum(CAST(volume AS BIGINT)) AS v FROM panel GROUP BY 1), ret AS (SELECT trade_date, (v / lag(v) OVER (ORDER BY trade_date) - 1) / 100 AS r FROM t)"""


def daily_returns(spark, sf):
    from pyspark.sql import Window

    v = bars(spark, sf).groupBy("trade_date").agg(F.sum(F.col("volume").cast("long")).alias("v"))
    return v.select("trade_date", ((F.col("v") / F.lag("v").over(Window.partitionBy(F.lit(0)).orderBy("trade_date")) - 1) / 100).alias("r"))


@query(f"""WITH {PANEL}, {RETURNS}, n AS (SELECT trade_date, r, product(1 + r) OVER (ORDER BY trade_date) AS nav FROM ret WHERE r IS NOT NULL)
SELECT trade_date, round(nav, 4) AS nav, round(nav / max(nav) OVER (ORDER BY trade_date) - 1, 5) + 0.0::DOUBLE AS drawdown FROM n""")
def w_nav(spark, sf):
    return rounded(evaluate.nav(daily_returns(spark, sf).dropna(), "r"), 5, "drawdown").select("trade_date", F.round("nav", 4).alias("nav"), "drawdown")


@query(f"""WITH {PANEL}, {RETURNS}, n AS (SELECT r, product(1 + r) OVER (ORDER BY trade_date) AS nav, trade_date FROM ret WHERE r IS NOT NULL), d AS (SELECT r, nav / max(nav) OVER (ORDER BY trade_date) - 1 AS dd FROM n)
SELECT round(avg(r) * 238, 5) AS annual, round(avg(r) / stddev_samp(r) * sqrt(238.0::DOUBLE), 5) AS ir, round(min(dd), 5) AS max_drawdown, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 5) AS positive_share, count(r) AS days FROM d""")
def a_return_statistics(spark, sf):
    return rounded(evaluate.return_statistics(daily_returns(spark, sf).dropna(), "r"), 5, "annual", "ir", "max_drawdown", "positive_share")


@query(f"""WITH {PANEL} SELECT trade_date, count(discount) AS n, count(DISTINCT discount) AS distinct_scores, count(DISTINCT discount) < least(20, greatest(floor(count(discount) / 20), 1)) AS degenerate FROM panel GROUP BY 1""")
def a_degenerate_scores(spark, sf):
    return evaluate.degenerate(bars(spark, sf), "discount", 5)


@query(f"""WITH {PANEL}, {LABEL}, n AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS r, count(*) OVER () AS m FROM days)
SELECT trade_date FROM n WHERE r IN (SELECT floor(k * (m - 1) / 19.0::DOUBLE + 0.5) FROM n, range(20) t(k))""")
def w_evenly_spaced(spark, sf):
    return evaluate.evenly_spaced(panel.calendar(bars(spark, sf)).select("trade_date"), 20, "trade_date")


@query("""SELECT o_custkey, round(regr_slope(o_totalprice, n), 4) AS slope, round(stddev_pop(o_totalprice), 4) AS spread FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) GROUP BY 1""")
def a_trajectory(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").withColumn("n", F.row_number().over(w))
    return o.groupBy("o_custkey").agg(F.round(F.regr_slope("o_totalprice", "n"), 4).alias("slope"), F.round(F.stddev_pop("o_totalprice"), 4).alias("spread"))


# Windows, labels, weights.


RAMP = "CASE WHEN {0} <= 5 THEN 3.0::DOUBLE - 2.0::DOUBLE * ({0} - 1) / 5 ELSE 1.0::DOUBLE END"


@query(f"""WITH {PANEL}, r AS (SELECT code, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS t, row_number() OVER (PARTITION BY trade_date ORDER BY volume, code) AS l FROM panel),
w AS (SELECT *, greatest({RAMP.format('t')}, {RAMP.format('l')}) AS raw FROM r) SELECT code, trade_date, round(raw / avg(raw) {cs()}, 6) AS weight FROM w""")
def w_rank_weights(spark, sf):
    return rounded(labels.rank_weights(bars(spark, sf).select("code", "trade_date", "volume"), "volume", 5), 6, "weight").drop("volume")


@query(f"""WITH {PANEL}, r AS (SELECT code, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS r, count(*) {cs()} AS n FROM panel)
SELECT code, trade_date, CASE WHEN r <= 5 THEN 4 WHEN r <= 10 THEN 3 WHEN r <= 20 THEN 2 WHEN r <= n * 0.2 THEN 1 ELSE 0 END AS grade FROM r""")
def w_grades(spark, sf):
    return labels.grades(bars(spark, sf).select("code", "trade_date", "volume"), "volume").drop("volume")


@query(f"""WITH {PANEL}, v AS (SELECT code, trade_date, CASE WHEN volume > 15 THEN close END AS v FROM panel), g AS (SELECT min(v) - 0.001::DOUBLE * (max(v) - min(v)) AS g FROM v)
SELECT code, trade_date, round(coalesce(v, min(v) {cs()} - 0.001::DOUBLE * (max(v) {cs()} - min(v) {cs()}), g), 5) AS filled FROM v, g""")
def w_floor_fill(spark, sf):
    p = bars(spark, sf).select("code", "trade_date", F.when(F.col("volume") > 15, F.col("close")).alias("v"))
    return rounded(labels.floor_fill(p, "v"), 5, "filled").drop("v")


@query(f"""WITH {PANEL}, {DAYS}, m AS (SELECT max(cal_idx) AS m FROM days), f AS (SELECT k AS fold, m + 1 - (4 - k) * 60 AS a FROM m, range(4) t(k))
SELECT CAST(fold AS INTEGER) AS fold, trade_date, CASE WHEN cal_idx <= a - 8 THEN 'train' WHEN cal_idx >= a THEN 'test' ELSE 'purged' END AS part FROM days JOIN f ON cal_idx <= a + 59""")
def w_folds(spark, sf):
    return labels.folds(panel.calendar(bars(spark, sf)), 4, 60, 7)


@query(f"""WITH {PANEL}, {RETURNS}, h AS (SELECT trade_date, coalesce(r > 0.001, false) AS hot, row_number() OVER (ORDER BY trade_date) AS i FROM ret), g AS (SELECT *, i - row_number() OVER (PARTITION BY hot ORDER BY trade_date) AS isl FROM h),
s AS (SELECT *, row_number() OVER (PARTITION BY hot, isl ORDER BY trade_date) AS streak FROM g), e AS (SELECT *, CASE WHEN hot AND streak >= 2 THEN true WHEN NOT hot AND streak >= 3 THEN false END AS ev FROM s)
SELECT trade_date, hot, streak, coalesce(last_value(ev IGNORE NULLS) OVER (ORDER BY trade_date), false) AS "on" FROM e""")
def w_hysteresis(spark, sf):
    return scoring.hysteresis(daily_returns(spark, sf), F.col("r") > 0.001).select("trade_date", "hot", "streak", "on")


@query(f"""WITH {PANEL} SELECT DISTINCT max(trade_date) OVER (PARTITION BY date_trunc('month', trade_date)) AS trade_date FROM panel""")
def w_month_end(spark, sf):
    return bars(spark, sf).groupBy(F.trunc("trade_date", "month").alias("m")).agg(F.max("trade_date").alias("trade_date")).select("trade_date")


@query(f"""WITH {PANEL}, x AS (SELECT code, trade_date, volume * ({lag('close', 1)} * 0 + close - {lag('close', 1)}) * 0 + {lag('volume', 1)} * (close - {lag('close', 1)}) AS g FROM panel), s AS (SELECT code, sum(g) AS gain FROM x GROUP BY 1)
SELECT code, round(gain, 2) AS gain, round(gain / sum(gain) OVER (), 5) AS share FROM s""")
def a_contributions(spark, sf):
    return scoring.contributions(bars(spark, sf)).select("code", F.round("gain", 2).alias("gain"), F.round("share", 5).alias("share"))


@query(f"""WITH {PANEL} SELECT code, trade_date, round(100.0::DOUBLE * amount / sum(amount) {cs()}, 5) AS cost_share FROM panel""")
def a_cost_shares(spark, sf):
    return rounded(scoring.cost_shares(bars(spark, sf).withColumn("cost", F.lit(100.0)), "cost", "amount"), 5, "cost_share").select("code", "trade_date", "cost_share")


@query(f"""WITH {PANEL} SELECT code, trade_date, round(ln(volume) - avg(ln(volume)) {cs()} - coalesce(covar_pop(ln(volume), ln(close)) {cs()} / nullif(var_pop(ln(close)) {cs()}, 0), NULL) * (ln(close) - avg(ln(close)) {cs()}), 5) + 0.0::DOUBLE AS residual FROM panel""")
def g_neutral_residual(spark, sf):
    p = bars(spark, sf).select("code", "trade_date", F.log("volume").alias("y"), F.log("close").alias("x"))
    return rounded(scoring.neutral_residual(p, "y", "x"), 5, "residual").select("code", "trade_date", "residual")


# Ranking and portfolio.


@query(f"""WITH {PANEL} SELECT code, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY CASE WHEN volume > 10 THEN volume END DESC NULLS LAST, code) AS place FROM panel""")
def t_ranked(spark, sf):
    p = bars(spark, sf).select("code", "trade_date", F.when(F.col("volume") > 10, F.col("volume")).alias("score"))
    return scoring.ranked(p, "score").drop("score")


TIES = {
    "code": "SELECT code, trade_date, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY discount DESC, code) AS place FROM panel) WHERE place <= 5",
    "dense": "SELECT code, trade_date, CAST(place AS INTEGER) AS place FROM (SELECT *, dense_rank() OVER (PARTITION BY trade_date ORDER BY discount DESC) AS place FROM panel) WHERE place <= 5",
    "all": "SELECT code, trade_date, CAST(place AS INTEGER) AS place FROM (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY discount DESC) AS place FROM panel) WHERE place <= 5",
    "strict": "SELECT code, trade_date, CAST(place AS INTEGER) AS place FROM (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY discount DESC) AS place, count(*) OVER (PARTITION BY trade_date, discount) AS n FROM panel) WHERE place + n - 1 <= 5",
}
for _kind, _sql in TIES.items():
    query(f"WITH {PANEL} {_sql}", f"t_top_k_{_kind}")(lambda spark, sf, kind=_kind: scoring.top_k(bars(spark, sf).select("code", "trade_date", "discount"), "discount", 5, kind).select("code", "trade_date", "place"))


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100""")
def t_paged_order(spark, sf):
    first = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(first, F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(100).limit(50)


@query(f"""WITH {PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS place FROM panel), t AS (SELECT code, trade_date, 0.19::DOUBLE AS w, sum(0.19::DOUBLE) {cs()} AS total, 0.9::DOUBLE AS model, 0.5::DOUBLE + day(trade_date) / 62.0::DOUBLE AS market FROM r WHERE place <= 5)
SELECT code, trade_date, round(w * least(1.0::DOUBLE, least(model, market) / total), 6) AS capped, CASE WHEN model = least(model, market) THEN 'model' ELSE 'market' END AS binding FROM t""")
def g_risk_cap(spark, sf):
    t = scoring.equal_targets(bars(spark, sf).select("code", "trade_date", "volume"), "volume", 5, 0.95)
    market = 0.5 + F.dayofmonth("trade_date") / 62.0
    return rounded(scoring.risk_cap(t, "target_weight", {"model": F.lit(0.9), "market": market}), 6, "capped").select("code", "trade_date", "capped", "binding")


@query(f"""WITH {PANEL}, t AS (SELECT s_suppkey AS code, 0.01::DOUBLE + s_suppkey * 0.001::DOUBLE AS weight, (s_suppkey % 7 + 3) * 1.37::DOUBLE AS price FROM supplier WHERE s_acctbal > 0), h AS (SELECT s_suppkey AS code, s_suppkey * 300 AS amount FROM supplier WHERE s_acctbal < 5000),
b AS (SELECT code, price, CAST(coalesce(floor(weight * 1000000 / price / 100) * 100, 0) AS BIGINT) AS want, CAST(coalesce(amount, 0) AS BIGINT) AS have FROM t FULL JOIN h USING (code))
SELECT code, want, have, CASE WHEN want > have THEN 'buy' WHEN want < have THEN 'sell' WHEN want > 0 THEN 'hold' ELSE 'ignore' END AS action, round(abs(want - have) * price, 4) AS notional FROM b""")
def z_order_preview(spark, sf):
    s = table(spark, sf, "supplier")
    t = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("code"), (0.01 + F.col("s_suppkey") * 0.001).alias("weight"), ((F.col("s_suppkey") % 7 + 3) * 1.37).alias("price"))
    h = s.where("s_acctbal < 5000").select(F.col("s_suppkey").alias("code"), (F.col("s_suppkey") * 300).alias("amount"))
    return rounded(scoring.order_preview(t, h, 1_000_000), 4, "notional")


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 10 THEN 'small' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END, CASE WHEN p_type = 'ECONOMY' THEN 'cheap_kind' END) AS reasons, p_size >= 10 AND p_retailprice <= 1500 AND p_type <> 'ECONOMY' AS passed FROM part""")
def g_vetoes(spark, sf):
    rules = {"small": F.col("p_size") < 10, "dear": F.col("p_retailprice") > 1500, "cheap_kind": F.col("p_type") == "ECONOMY"}
    return scoring.vetoes(table(spark, sf, "part"), rules).select("p_partkey", "reasons", "passed")


@query(f"""WITH {PANEL}, x AS (SELECT code, 2001 - year(trade_date) AS period, avg(discount) AS ic FROM panel GROUP BY 1, 2), w AS (SELECT *, [0.4, 0.25, 0.15, 0.12, 0.08][period + 1]::DOUBLE AS w FROM x WHERE period < 5),
s AS (SELECT code, sum(w * ic) / sum(w) AS m, sum(w * ic * ic) / sum(w) AS q, count(*) AS periods FROM w GROUP BY 1)
SELECT code, round(m, 6) AS mean_ic, round((m - 0.25::DOUBLE * sqrt(greatest(0, q - m * m))) / 0.08::DOUBLE * 100, 3) AS score, periods FROM s""")
def g_rolling_score(spark, sf):
    x = bars(spark, sf).groupBy("code", (2001 - F.year("trade_date")).alias("period")).agg(F.avg("discount").alias("ic"))
    return scoring.weighted_period_score(x, [0.40, 0.25, 0.15, 0.12, 0.08], 0.25, 0.08).select("code", F.round("mean_ic", 6).alias("mean_ic"), F.round("score", 3).alias("score"), "periods")


# Sets and graphs.


@query("""SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000""")
def u_intersect(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("key")).intersect(table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("key")))


@query("""SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders""")
def u_except(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key")).exceptAll(table(spark, sf, "orders").select(F.col("o_custkey").alias("key")).distinct())


@query("""SELECT s_suppkey AS key, s_name AS name, NULL::DOUBLE AS balance FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer""")
def u_union_aligned(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return s.unionByName(table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), allowMissingColumns=True)


@query("""WITH a AS (SELECT o_orderkey AS m, 'o' || o_custkey % 10 AS c FROM orders), b AS (SELECT o_orderkey AS m, 'n' || (o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 10 AS c FROM orders), x AS (SELECT a.c AS "old", b.c AS "new", count(*) AS common FROM a JOIN b USING (m) GROUP BY 1, 2)
SELECT "old", "new", common, round(common / ((SELECT count(*) FROM a WHERE c = x."old") + (SELECT count(*) FROM b WHERE c = x."new") - common), 6) AS jaccard FROM x WHERE common / ((SELECT count(*) FROM a WHERE c = x."old") + (SELECT count(*) FROM b WHERE c = x."new") - common) >= 0.5""")
def r_cluster_overlap(spark, sf):
    o = table(spark, sf, "orders")
    old = o.select(F.col("o_orderkey").alias("member"), F.concat(F.lit("o"), (F.col("o_custkey") % 10).cast("string")).alias("cluster"))
    moved = F.col("o_custkey") + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)
    new = o.select(F.col("o_orderkey").alias("member"), F.concat(F.lit("n"), (moved % 10).cast("string")).alias("cluster"))
    return rounded(graph.cluster_overlap(old, new), 6, "jaccard")


EDGES = """o AS (SELECT o_custkey AS node, min(o_custkey) OVER (PARTITION BY o_orderdate, o_orderpriority, o_orderstatus, floor(o_totalprice / 10000)) AS first FROM orders),
e AS (SELECT DISTINCT first AS a, node AS b FROM o WHERE first <> node)"""


def customer_edges(spark, sf):
    """Customers with like orders on one day: of equal priority and status and about one price."""
    from pyspark.sql import Window

    alike = Window.partitionBy("o_orderdate", "o_orderpriority", "o_orderstatus", F.floor(F.col("o_totalprice") / 10000))
    return table(spark, sf, "orders").select(F.min("o_custkey").over(alike).alias("a"), F.col("o_custkey").alias("b")).where("a != b").distinct()


@query(f"""WITH RECURSIVE {EDGES}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY 1""")
def r_components(spark, sf):
    return graph.connected_components(table(spark, sf, "customer").select(F.col("c_custkey").alias("node")), customer_edges(spark, sf))


PAIRS = "w AS (SELECT l_suppkey AS a, -1 - l_partkey AS b, count(*) AS w FROM lineitem GROUP BY 1, 2)"


def pair_edges(spark, sf):
    """Suppliers and parts (as negative nodes) by the number of lines that have both."""
    ends = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), (-1 - F.col("l_partkey")).alias("b"))
    return spread(ends, line_count(spark, sf), "a").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


@query(f"""WITH {PAIRS}, u AS (SELECT * FROM w UNION ALL SELECT b, a, w FROM w)
SELECT a, b, w, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS INTEGER) AS nth FROM u) WHERE nth <= 2""")
def r_top_neighbours(spark, sf):
    return graph.top_neighbours(pair_edges(spark, sf), 2)


# Streams, run as batches here.


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def st_tumbling(spark, sf):
    return streams.tumbling(table(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def st_sessions(spark, sf):
    return streams.sessions(table(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, arg_max(event_id, ts) - coalesce(arg_max(event_id, ts) FILTER (ts <= TIMESTAMP '2024-01-15'), 0) AS delta FROM events GROUP BY 1""")
def st_counter_delta(spark, sf):
    return streams.counter_delta(table(spark, sf, "events"), "event_id", "2024-01-15 00:00:00")
