"""Queries of scores, gates and advice over metrics that stand in for research results, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, gates, graph, scoring
from .panels import FACTORS, five_factors, query, rounded
from .views import PANEL, line_count, rank, spread, table
from .views import panel as bars

#: Metric: whole number of the part's key, and what it is divided by. Quotients of whole numbers round alike everywhere.
METRICS = {
    "quick": ("k % 101", 1), "overfit": ("CASE WHEN k % 19 > 0 THEN k % 97 END", 1), "rolling": ("CASE WHEN k % 23 > 0 THEN k % 89 END", 1), "adversarial": ("k % 83", 1),
    "annual": ("k % 37 - 4", 50), "sharpe": ("k % 11 - 1", 4), "ic": ("k % 13 - 6", 100), "ir": ("k % 17 - 8", 10), "drawdown": ("-(k % 45)", 100),
    "rank_ic": ("k % 7", 100), "rank_ir": ("k % 9", 16), "stability": ("k % 100", 1), "stress": ("k % 71 + 20", 1), "placebo": ("k % 61 + 30", 1), "half_life": ("k % 91", 1),
    "pearson": ("k % 80", 100), "rank": ("k % 85", 100), "p90_pearson": ("k % 73", 100), "p90_rank": ("CASE WHEN k % 11 > 0 THEN k % 79 END", 100),
}
SQL_METRICS = "m AS (SELECT k, " + ", ".join(f"CAST({x} AS DOUBLE) / {d} AS {c}" for c, (x, d) in METRICS.items()) + " FROM (SELECT p_partkey AS k, p_brand, p_size FROM part))"


def metrics(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).select("k", *[(F.expr(x).cast("double") / d).alias(c) for c, (x, d) in METRICS.items()])


def clip(x: str, zero: float, full: float) -> str:
    return f"CASE WHEN {x} IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, ({x} - {zero}::DOUBLE) / ({full}::DOUBLE - {zero}::DOUBLE) * 100)) END"


DEEP = "d AS (SELECT *, annual < 0 OR sharpe < 0 AS loss, CASE WHEN overfit IS NULL OR rolling IS NULL THEN 0.0::DOUBLE ELSE quick * 0.55::DOUBLE + overfit * 0.15::DOUBLE + rolling * 0.20::DOUBLE + adversarial * 0.10::DOUBLE END AS total FROM m), e AS (SELECT *, CASE WHEN loss THEN least(total, 59.9::DOUBLE) ELSE total END AS deep FROM d)"


LIFE = f"""{DEEP.replace('FROM m)', 'FROM m0)')}, l AS (SELECT *, quick >= 70 AND abs(ic) >= 0.02 AND abs(ir) >= 0.30 AS base, deep < 70 OR quick < 55 OR abs(ic) < 0.01 OR abs(ir) < 0.15 AS weak FROM e),
a AS (SELECT *, CASE WHEN k % 29 = 0 THEN CASE WHEN status = 'active' THEN 'exit_candidate' ELSE 'keep_retired' END WHEN k % 5 = 0 AND quick >= 70 THEN 'direction_review' WHEN status = 'active' AND base AND deep >= 79.5 THEN 'keep_active'
WHEN status = 'active' AND weak THEN 'exit_candidate' WHEN status = 'active' THEN 'active_review' WHEN base AND deep >= 80 AND k % 7 = 0 THEN 'policy_review' WHEN base AND deep >= 80 THEN 'restore_candidate' ELSE 'keep_retired' END AS advice FROM l)"""
SQL_LIFE = f"""{SQL_METRICS}, m0 AS (SELECT k, 60 + quick * 0.4::DOUBLE AS quick, 60 + overfit * 0.4::DOUBLE AS overfit, 60 + rolling * 0.4::DOUBLE AS rolling, 60 + adversarial * 0.4::DOUBLE AS adversarial, 0.1::DOUBLE AS annual, 1.0::DOUBLE AS sharpe, ic, ir,
CASE WHEN k % 2 = 0 THEN 'active' ELSE 'retired' END AS status, CASE WHEN k % 3 > 0 THEN 'x' || (k // 6) END AS expression FROM m), {LIFE}"""


def recomputed(spark, sf):
    """Better scores than the stand-in has, so that every advice occurs."""
    better = {c: 60 + F.col(c) * 0.4 for c in gates.DEEP_WEIGHTS}
    df = metrics(spark, sf).withColumns(better | {"annual": F.lit(0.1), "sharpe": F.lit(1.0)})
    k = F.col("k")
    df = gates.deep_score(df).withColumns({"status": F.when(k % 2 == 0, "active").otherwise("retired"), "succeeded": k % 29 != 0, "direction_review": k % 5 == 0, "policy_reason": k % 7 == 0})
    return gates.lifecycle(df.withColumn("expression", F.when(k % 3 > 0, F.concat(F.lit("x"), F.floor(k / 6).cast("string")))))


@query(f"""WITH {SQL_LIFE}, o AS (SELECT *, row_number() OVER w AS nth, first_value(k) OVER w AS keeper FROM a WINDOW w AS (PARTITION BY expression ORDER BY CASE WHEN status = 'active' THEN 0 ELSE 1 END, deep DESC, k))
SELECT k, CASE WHEN nth > 1 AND expression IS NOT NULL AND status = 'retired' AND advice = 'restore_candidate' THEN 'keep_retired_duplicate' WHEN nth > 1 AND expression IS NOT NULL AND status = 'active' THEN 'active_redundancy_review' ELSE advice END AS advice,
CASE WHEN nth > 1 AND expression IS NOT NULL THEN keeper END AS duplicate_of FROM o""")
def g_lifecycle(spark, sf):
    return gates.duplicate_advice(recomputed(spark, sf), "k", "expression").select("k", "advice", "duplicate_of")


@query(f"""WITH {SQL_LIFE} SELECT status, advice, count(*) AS n, round(avg(deep), 4) AS mean_deep FROM a GROUP BY 1, 2""")
def a_lifecycle_summary(spark, sf):
    return recomputed(spark, sf).groupBy("status", "advice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("deep"), 4).alias("mean_deep"))


@query(f"""WITH {SQL_METRICS} SELECT k, CASE WHEN rolling IS NULL THEN 'missing' WHEN rolling < 40 OR ic <= 0 THEN 'severe' WHEN rolling < 55 THEN 'weak' WHEN k % 4 = 0 THEN 'watch' WHEN rolling < 65 THEN 'watch' ELSE 'ok' END AS severity,
round(CASE WHEN overfit IS NOT NULL AND rolling IS NOT NULL THEN quick * 0.55::DOUBLE + overfit * 0.15::DOUBLE + rolling * 0.20::DOUBLE + adversarial * 0.10::DOUBLE END, 3) AS simulated FROM m""")
def g_audit_severity(spark, sf):
    df = metrics(spark, sf).withColumns({"score": F.col("rolling"), "recent_ic": F.col("ic"), "negative_period": F.col("k") % 4 == 0})
    return rounded(gates.simulated_deep(gates.severity(df)), 3, "simulated").select("k", "severity", "simulated")


TRIALS = """s AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderkey % 97 AS score FROM orders), w AS (SELECT *, row_number() OVER x AS nth, coalesce(score < lag(score) OVER x, false) AS fell FROM s WINDOW x AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
p AS (SELECT o_custkey, count(*) AS n, max(score) AS best, avg(score) AS mean, stddev_pop(score) AS sd, regr_slope(score, nth) AS slope, count(*) - max(nth) FILTER (NOT fell) AS declines, arg_max(score, nth) AS last FROM w GROUP BY 1),
t AS (SELECT o_custkey, n, best, CASE WHEN n >= 2 AND mean > 0 THEN least(sd / mean, 1.0) ELSE 0 END AS diversity, CASE WHEN n >= 2 THEN greatest(0.0, least(1.0, slope / 10)) ELSE 0 END AS convergence, CASE WHEN n >= 2 AND best > 0 THEN greatest(0.0, 1 - sd / best) ELSE 1 END AS stability, declines, last FROM p)"""


def trials(spark, sf):
    o = table(spark, sf, "orders").withColumn("score", F.col("o_orderkey") % 97)
    last = o.groupBy("o_custkey").agg(F.max_by("score", F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return gates.trajectory(o, "o_custkey", ["o_orderdate", "o_orderkey"], "score").join(last, "o_custkey")


@query(f"""WITH {TRIALS} SELECT o_custkey, n, best, round(diversity, 5) AS diversity, round(convergence, 5) AS convergence, round(stability, 5) AS stability, declines FROM t""")
def a_search_trajectory(spark, sf):
    return rounded(trials(spark, sf), 5, "diversity", "convergence", "stability").drop("last")


@query(f"""WITH {TRIALS} SELECT o_custkey, CASE WHEN o_custkey % 12 > 8 THEN 'simplify' WHEN declines >= 2 AND n >= 3 THEN 'recombine' WHEN last < 30 AND n <= 3 THEN 'explore' WHEN best - last > 20 AND n >= 2 THEN 'recombine' WHEN last >= 60 AND diversity < 0.3 THEN 'exploit'
WHEN diversity > 0.6 AND convergence < 0.4 THEN 'explore' ELSE 'exploit' END AS strategy FROM t""")
def g_strategy(spark, sf):
    t = trials(spark, sf).withColumns({"nesting": F.col("o_custkey") % 12, "score": F.col("last")})
    return gates.strategy(t).select("o_custkey", "strategy")


@query(f"""WITH {PANEL}, r AS (SELECT trade_date, discount AS s, row_number() OVER (PARTITION BY trade_date ORDER BY discount DESC) AS r FROM panel), b AS (SELECT trade_date, s, coalesce(max(s) FILTER (r = 5) OVER (PARTITION BY trade_date), min(s) OVER (PARTITION BY trade_date)) AS edge FROM r),
c AS (SELECT trade_date, count(*) AS n, count(DISTINCT s) AS u, count(*) FILTER (s > edge) AS above, count(*) FILTER (s = edge) AS tied FROM b GROUP BY 1), d AS (SELECT *, above + tied > 5 AS bt, CASE WHEN above + tied > 5 THEN above ELSE above + tied END AS sel, day(trade_date) <= 10 AS weak FROM c)
SELECT trade_date, n, u AS distinct_scores, bt AS boundary_tied, sel AS selected, round(least(1.0::DOUBLE, CASE WHEN weak THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END / 5 * sel), 6) AS exposure, CASE WHEN sel = 0 THEN 'no_trade' WHEN weak OR u < least(20, greatest(floor(n / 20), 1)) OR bt THEN 'weak' ELSE 'strong' END AS state FROM d""")
def g_confidence(spark, sf):
    df = gates.confidence(bars(spark, sf), "discount", 5, F.dayofmonth("trade_date") <= 10)
    return rounded(df, 6, "exposure").select("trade_date", "n", "distinct_scores", "boundary_tied", "selected", "exposure", "state")


RANKS = ", ".join(f"{rank(f'f{i}')} AS r{i}" for i in range(1, 6))
PAIRS5 = [(i, j) for i in range(1, 6) for j in range(i + 1, 6)]


@query(f"""WITH {PANEL}, {FACTORS}, r AS (SELECT trade_date, {RANKS} FROM fx), d AS (SELECT trade_date, {', '.join(f'CASE WHEN count(r{i}) FILTER (r{j} IS NOT NULL) >= 10 AND stddev_pop(r{i}) FILTER (r{j} IS NOT NULL) > 1e-10 AND stddev_pop(r{j}) FILTER (r{i} IS NOT NULL) > 1e-10 THEN corr(r{i}, r{j}) END AS c{i}{j}' for i, j in PAIRS5)} FROM r GROUP BY 1),
u AS (SELECT * FROM d UNPIVOT INCLUDE NULLS (c FOR p IN ({', '.join(f'c{i}{j}' for i, j in PAIRS5)}))) SELECT 'r' || p[2] AS a, 'r' || p[3] AS b, round(abs(avg(c)), 6) AS size FROM u GROUP BY p HAVING abs(avg(c)) >= 0.5""")
def g_redundant(spark, sf):
    """Pairs of factors whose daily rank correlation is large on average."""
    fx = five_factors(spark, sf).drop("code").withColumnsRenamed({f"f{i}": f"r{i}" for i in range(1, 6)})
    return evaluate.pairwise(spread(fx, line_count(spark, sf), "trade_date"), [f"r{i}" for i in range(1, 6)], ranked=True).select("a", "b", F.round(F.abs("mean"), 6).alias("size")).where("size >= 0.5")


CONFLICTS = "x AS (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS a, greatest(a.l_partkey, b.l_partkey) AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey % 16 = b.l_suppkey % 16 AND a.l_partkey < b.l_partkey)"


@query(f"""WITH RECURSIVE {CONFLICTS}, p AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM part), n AS (SELECT p.i, p.node, list(y.b) AS near FROM p LEFT JOIN (SELECT a, b FROM x UNION ALL SELECT b, a FROM x) y ON y.a = p.node GROUP BY 1, 2),
g(i, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.i + 1, CASE WHEN list_has_any(g.taken, near::BIGINT[]) THEN g.taken ELSE list_append(g.taken, node::BIGINT) END FROM g JOIN n ON n.i = g.i + 1)
SELECT unnest(taken) AS node FROM g WHERE i = (SELECT count(*) FROM part)""")
def g_novel(spark, sf):
    """Parts, dearest first, that share no order and supplier group with an accepted one."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 16).alias("g"), "l_partkey").distinct()
    x = lines.withColumnRenamed("l_partkey", "a").join(lines.withColumnRenamed("l_partkey", "b"), ["l_orderkey", "g"]).where("a < b").select("a", "b").distinct()
    return graph.novel(table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score")), x)
