"""Queries of reports, audits and plans, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, labels, panel, reports, scoring
from ..streaming import events as streams
from .panels import LABEL, PAIRS, pair_edges, query, rounded
from .views import PANEL, rank, table
from .views import panel as bars


def market(spark, sf):
    """One series: the market's mean close and volume per day."""
    return bars(spark, sf).groupBy("trade_date").agg(F.avg("close").alias("level"), F.sum("volume").alias("volume"))


MARKET = f"{PANEL}, market AS (SELECT trade_date, avg(close) AS level, sum(volume) AS volume FROM panel GROUP BY 1)"
RETURNS = f"{MARKET}, moved AS (SELECT trade_date, level, level / lag(level) OVER (ORDER BY trade_date) - 1 AS ret FROM market)"


def market_returns(spark, sf):
    m = market(spark, sf)
    before = F.lag("level").over(reports.Window.partitionBy(F.lit(0)).orderBy("trade_date"))
    return m.select("trade_date", "level", (F.col("level") / before - 1).alias("ret"))


SEEDS = ("close", "volume", "high")


@query(f"""WITH {PANEL}, s AS ({' UNION ALL '.join(f"SELECT '{c}' AS seed, code, trade_date, {c} AS score FROM panel" for c in SEEDS)}), r AS (SELECT seed, code, trade_date, {rank('score', 'seed')} AS r FROM s),
d AS (SELECT a.seed AS a, b.seed AS b, trade_date, CASE WHEN count(*) >= 10 AND stddev_pop(a.r) > 0 AND stddev_pop(b.r) > 0 THEN covar_pop(a.r, b.r) / (stddev_pop(a.r) * stddev_pop(b.r)) END AS c FROM r a JOIN r b USING (code, trade_date) WHERE a.seed < b.seed GROUP BY 1, 2, 3)
SELECT a, b, round(avg(c), 6) + 0.0 AS agreement, count(c) AS days FROM d GROUP BY 1, 2""")
def a_seed_agreement(spark, sf):
    p = bars(spark, sf)
    long = p.select("code", "trade_date", F.explode(F.array(*[F.struct(F.lit(c).alias("seed"), F.col(c).alias("score")) for c in SEEDS])).alias("s")).select("s.seed", "code", "trade_date", "s.score")
    return rounded(reports.seed_agreement(long), 6, "agreement")


@query(f"""WITH {PANEL} SELECT code, trade_date, round(({rank('close')} + {rank('volume')} + {rank('discount')}) / 3.0::DOUBLE, 6) AS baseline FROM panel""")
def a_rank_baseline(spark, sf):
    return rounded(reports.rank_baseline(bars(spark, sf), ["close", "volume", "discount"]), 6, "baseline").select("code", "trade_date", "baseline")


@query(f"""WITH {PANEL} SELECT trade_date, round(stddev_pop(close), 5) + 0.0 AS deviation, round(median(close), 5) AS median, round(max(close) - min(close), 5) AS spread FROM panel GROUP BY 1""")
def a_dispersion(spark, sf):
    return rounded(reports.dispersion(bars(spark, sf), ["trade_date"], "close"), 5, "deviation", "median", "spread")


@query(f"""WITH {RETURNS}, p AS (SELECT *, row_number() OVER (ORDER BY ret DESC NULLS LAST, trade_date) AS place, (SELECT median(abs(ret)) FROM moved) AS med FROM moved)
SELECT round(sum(greatest(ret, 0)) FILTER (place <= 5) / sum(greatest(ret, 0)), 6) AS top_share, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE WHEN ret IS NOT NULL THEN 0 END), 6) AS positive_share, count(*) FILTER (abs(ret) > 12 * med) AS outliers FROM p WHERE ret IS NOT NULL""")
def a_concentration(spark, sf):
    return rounded(reports.concentration(market_returns(spark, sf).where("ret IS NOT NULL"), "ret"), 6, "top_share", "positive_share")


@query(f"""WITH {PANEL} SELECT trade_date, round(stddev_samp(volume), 5) AS deviation, round(quantile_cont(abs(volume), 0.99), 5) AS p99, round(median(abs(volume)), 5) AS median, quantile_cont(abs(volume), 0.99) > median(abs(volume)) * 50 AS heavy FROM panel GROUP BY 1""")
def a_score_shape(spark, sf):
    return rounded(reports.score_shape(bars(spark, sf), "volume"), 5, "deviation", "p99", "median")


@query(f"""WITH {PANEL}, b AS (SELECT trade_date, discount, row_number() OVER (PARTITION BY trade_date ORDER BY discount DESC) AS r FROM panel), k AS (SELECT trade_date, max(discount) FILTER (r = 5) AS boundary FROM b GROUP BY 1)
SELECT trade_date, boundary, count(*) FILTER (discount > boundary) AS above, count(*) FILTER (discount = boundary) AS tied, 5 - count(*) FILTER (discount > boundary) AS slots FROM b JOIN k USING (trade_date) WHERE boundary IS NOT NULL GROUP BY 1, 2""")
def t_tie_evidence(spark, sf):
    return reports.tie_evidence(bars(spark, sf), "discount", 5)


@query(f"""WITH {PANEL}, {LABEL} SELECT DISTINCT trade_date FROM panel WHERE trade_date NOT IN (SELECT trade_date FROM lab WHERE label IS NOT NULL)""")
def a_label_gaps(spark, sf):
    p = bars(spark, sf)
    return reports.missing_dates(panel.calendar(p), labels.forward_label(p, "close", 5, 1), "label")


@query(f"""WITH {RETURNS}, o AS (SELECT *, CASE WHEN extract(day FROM trade_date) = 15 THEN ret + 0.01::DOUBLE ELSE ret END AS said FROM moved)
SELECT trade_date, round(ret - said, 6) AS residual FROM o WHERE abs(ret - said) > 1e-10""")
def a_continuity(spark, sf):
    said = market_returns(spark, sf).withColumn("said", F.when(F.dayofmonth("trade_date") == 15, F.col("ret") + 0.01).otherwise(F.col("ret")))
    return rounded(reports.continuity(said, "level", "said"), 6, "residual").select("trade_date", "residual")


@query("""SELECT count(*) AS n, count(o_custkey) - count(DISTINCT o_custkey) AS repeated, count(*) FILTER (o_totalprice IS NULL) AS nulls, count(*) FILTER (NOT isfinite(o_totalprice)) AS not_finite FROM orders""")
def a_report_integrity(spark, sf):
    return reports.integrity(table(spark, sf, "orders"), "o_custkey", "o_totalprice")


@query("""WITH w AS (SELECT DISTINCT p_partkey, p_brand, unnest(string_split(p_type, ' ')) AS member FROM part), n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
SELECT p_brand, member, count(*) AS having, count(*) / n AS share FROM w JOIN n USING (p_brand) GROUP BY p_brand, member, n HAVING count(*) / n >= 0.2""")
def a_frequent_members(spark, sf):
    return reports.frequent_members(table(spark, sf, "part"), "p_brand", F.split("p_type", " "), 0.2)


@query(f"""WITH {PANEL}, g AS (SELECT code, trade_date, close, lag(close, 252) OVER (PARTITION BY code ORDER BY trade_date) AS b FROM panel) SELECT code, trade_date, round(CASE WHEN b > 0 THEN close / b - 1 END, 5) + 0.0 AS growth FROM g""")
def w_year_growth(spark, sf):
    return rounded(reports.growth(bars(spark, sf), "close"), 5, "growth").select("code", "trade_date", "growth")


@query(f"""WITH {PANEL} SELECT code, trade_date, round(close / max(close) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - 1, 6) + 0.0 AS drawdown FROM panel""")
def w_rolling_drawdown(spark, sf):
    return rounded(reports.rolling_drawdown(bars(spark, sf), "close"), 6, "drawdown").select("code", "trade_date", "drawdown")


@query(f"""WITH {MARKET}, b AS (SELECT *, row_number() OVER (ORDER BY trade_date DESC) - 1 AS back, CAST(ceil(count(*) OVER () / 260.0) AS BIGINT) AS step FROM market) SELECT trade_date, volume FROM b WHERE back % step = 0""")
def w_thinned(spark, sf):
    return reports.thinned(market(spark, sf), 260).select("trade_date", "volume")


@query(f"""WITH {PANEL}, c AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS following FROM (SELECT DISTINCT trade_date FROM panel WHERE isodow(trade_date) < 6)),
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_orderkey, day, c.trade_date AS on_after, following FROM o ASOF LEFT JOIN c ON o.day <= c.trade_date AND o.day >= (SELECT min(trade_date) FROM c)""")
def w_next_session(spark, sf):
    days = bars(spark, sf).where(F.weekday("trade_date") < 5).select("trade_date")
    first = days.agg(F.min("trade_date").alias("first"))
    found = reports.next_session(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.to_date("o_orderdate"), days)
    known = F.col("day") >= F.col("first")
    return found.join(first).select("o_orderkey", "day", F.when(known, F.col("on_after")).alias("on_after"), F.when(known, F.col("following")).alias("following"))


@query(f"""WITH {PANEL}, c AS (SELECT code FROM (SELECT DISTINCT code FROM panel) ORDER BY md5('7:' || code) LIMIT 30) SELECT code, trade_date, volume FROM panel WHERE code IN (SELECT code FROM c)""")
def t_seeded_sample(spark, sf):
    return reports.seeded_sample(bars(spark, sf), 30, 7).select("code", "trade_date", "volume")


@query(f"""WITH {PANEL} SELECT round(covar_pop(close, volume) / (stddev_pop(close) * stddev_pop(volume)), 6) AS pooled, count(*) AS n FROM panel""")
def a_pooled_correlation(spark, sf):
    return rounded(reports.pooled_correlation(bars(spark, sf), "close", "volume"), 6, "pooled")


@query(f"""WITH {PANEL} SELECT code, trade_date, round(close / sum(close) OVER (PARTITION BY trade_date), 6) AS share FROM panel""")
def g_normalised_weights(spark, sf):
    return rounded(reports.normalised_weights(bars(spark, sf), "close"), 6, "share").select("code", "trade_date", "share")


@query(f"""WITH {PANEL} SELECT code, trade_date, round(CASE WHEN code % 2 = 0 THEN high - low ELSE low - high END, 6) + 0.0 AS delta, round(CASE WHEN code % 2 = 0 THEN high - low ELSE low - high END / abs(low), 6) + 0.0 AS relative FROM panel""")
def g_improvement(spark, sf):
    return rounded(reports.improvement(bars(spark, sf), "low", "high", F.col("code") % 2 == 0), 6, "delta", "relative").select("code", "trade_date", "delta", "relative")


GROUPS = f"{PANEL}, {LABEL}, q AS (SELECT trade_date, label, ntile(5) OVER (PARTITION BY trade_date ORDER BY volume, code) AS bucket FROM panel JOIN lab USING (code, trade_date) WHERE label IS NOT NULL)"


def grouped(spark, sf):
    p = bars(spark, sf)
    return reports.group_returns(p.join(labels.forward_label(p, "close", 5, 1), ["code", "trade_date"]), "volume", "label")


@query(f"""WITH {GROUPS} SELECT trade_date, CAST(bucket AS INTEGER) AS bucket, round(avg(label), 6) + 0.0 AS mean_label, count(*) AS n FROM q GROUP BY 1, 2""")
def g_group_returns(spark, sf):
    return rounded(grouped(spark, sf), 6, "mean_label")


@query(f"""WITH {GROUPS}, d AS (SELECT trade_date, bucket, avg(label) AS m FROM q GROUP BY 1, 2), b AS (SELECT bucket, avg(m) AS mean FROM d GROUP BY 1), r AS (SELECT bucket, rank() OVER (ORDER BY mean) AS place FROM b)
SELECT round(covar_pop(bucket, place) / (stddev_pop(bucket) * stddev_pop(place)), 6) AS monotone FROM r""")
def g_monotonicity(spark, sf):
    return rounded(reports.monotonicity(grouped(spark, sf)), 6, "monotone")


@query(f"""WITH {MARKET}, m AS (SELECT trade_date, ln(level / lag(level, 1) OVER w) AS m1, ln(level / lag(level, 20) OVER w) AS m20, ln(level / lag(level, 60) OVER w) AS m60 FROM market WINDOW w AS (ORDER BY trade_date))
SELECT trade_date, round((m20 + m60) / 2, 6) + 0.0 AS composite, round(greatest(stddev_samp(m1) OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), stddev_samp(m1) OVER (ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) * sqrt(238.0::DOUBLE), 6) AS volatility FROM m""")
def w_breadth(spark, sf):
    return rounded(scoring.breadth(market(spark, sf), ["level"]), 6, "composite", "volatility").select("trade_date", "composite", "volatility")


@query(f"""WITH {PANEL}, r AS (SELECT code, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS place FROM panel WHERE volume IS NOT NULL) SELECT code, trade_date, CAST(place AS INTEGER) AS place, 0.095::DOUBLE AS target_weight FROM r WHERE place <= 10""")
def g_equal_targets(spark, sf):
    return scoring.equal_targets(bars(spark, sf), "volume", 10, 0.95).select("code", "trade_date", "place", F.round("target_weight", 6).alias("target_weight"))


@query("""SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1, 2""")
def st_sliding(spark, sf):
    return streams.sliding(table(spark, sf, "events"), "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


def regions(spark, sf):
    nodes = pair_edges(spark, sf).selectExpr("explode(array(a, b)) AS node").distinct()
    return nodes.withColumn("root", F.pmod("node", F.lit(7)))


@query(f"""WITH {PAIRS} SELECT least(a % 7, (b % 7 + 7) % 7) AS r1, greatest(a % 7, (b % 7 + 7) % 7) AS r2, max(w) AS w FROM w WHERE a % 7 <> (b % 7 + 7) % 7 GROUP BY 1, 2""")
def r_strongest_between(spark, sf):
    return graph.strongest_between(pair_edges(spark, sf), regions(spark, sf))


@query(f"""WITH {PAIRS}, n AS (SELECT node, sum(w) AS score FROM (SELECT a AS node, w FROM w UNION ALL SELECT b, w FROM w) GROUP BY 1), r AS (SELECT (node % 7 + 7) % 7 AS root, node, score, row_number() OVER (PARTITION BY (node % 7 + 7) % 7 ORDER BY score DESC, node) AS nth, count(*) OVER (PARTITION BY (node % 7 + 7) % 7) AS size FROM n)
SELECT root, node AS representative, CAST(score AS BIGINT) AS score, size FROM r WHERE nth = 1""")
def r_representatives(spark, sf):
    e = pair_edges(spark, sf)
    scores = e.selectExpr("a AS node", "w").unionByName(e.selectExpr("b AS node", "w")).groupBy("node").agg(F.sum("w").alias("score"))
    return graph.representatives(regions(spark, sf), scores)


@query()
def x_replay(spark, sf):
    """Top-k-dropout portfolios of every region's account; tested against a plain loop."""
    p = bars(spark, sf)
    after = F.lead("close").over(reports.Window.partitionBy("code").orderBy("trade_date"))
    scored = p.select((F.col("code") % 5).alias("account"), "trade_date", "code", F.col("volume").alias("score"), (after / F.col("close") - 1).alias("ret"))
    return reports.replay(scored, 5, 2, 0.001)

