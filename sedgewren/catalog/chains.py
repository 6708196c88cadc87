"""Queries of chained joins, repairs and costs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, gates, graph, labels, panel, portfolio, scoring
from ..plans import tail
from . import factors
from .gates import SQL_METRICS, metrics
from .panels import DAYS, LABEL, query, rounded
from .views import FEE, PANEL, lag, table
from .views import panel as bars

# Announced figures of four kinds: orders by priority and customer number modulo 100.
KINDS = {"equity": ("1-URGENT",), "profit": ("2-HIGH",), "shares": ("3-MEDIUM",), "holders": ("4-NOT SPECIFIED", "5-LOW")}


def announced(spark, sf, kind: str):
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").isin(*KINDS[kind]))
    return o.groupBy((F.col("o_custkey") % 100).alias("code"), F.to_date("o_orderdate").alias(f"{kind}_date")).agg(F.max("o_totalprice").alias(kind))


@query(f"""WITH {PANEL}, {', '.join(f"{k} AS (SELECT o_custkey % 100 AS code, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS v FROM orders WHERE o_orderpriority IN ({', '.join(map(repr, p))}) GROUP BY 1, 2)" for k, p in KINDS.items())}
SELECT p.code, p.trade_date, {', '.join(f'{k}.d AS {k}_date, {k}.v AS {k}' for k in KINDS)} FROM panel p {' '.join(f'ASOF LEFT JOIN {k} ON p.code = {k}.code AND p.trade_date >= {k}.d' for k in KINDS)}""")
def j_asof_four(spark, sf):
    """Four announced figures as known on each day."""
    out = bars(spark, sf).select("code", "trade_date")
    for kind in KINDS:
        out = panel.asof_join(out, announced(spark, sf, kind), "code", "trade_date", f"{kind}_date", [kind])
    return out


@query(f"""WITH {PANEL} SELECT code, trade_date, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY discount DESC, volume DESC, code) AS place FROM panel) WHERE place <= 5""")
def t_top_k_secondary(spark, sf):
    """Ties in the score go by a second one."""
    p = bars(spark, sf).select("code", "trade_date", F.struct("discount", "volume").alias("score"))
    return scoring.top_k(p, "score", 5).select("code", "trade_date", "place")


@query(f"""WITH {PANEL}, {LABEL}, r AS (SELECT code, trade_date, label, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS place FROM panel JOIN lab USING (code, trade_date)), w AS (SELECT code, trade_date, label, 0.1::DOUBLE AS w FROM r WHERE place <= 10),
d AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nxt FROM (SELECT DISTINCT trade_date FROM w)), c AS (SELECT code, trade_date, w FROM w UNION ALL SELECT code, nxt, -w FROM w JOIN d USING (trade_date) WHERE nxt IS NOT NULL), p AS (SELECT code, trade_date, sum(w) AS x FROM c GROUP BY 1, 2),
t AS (SELECT trade_date, sum(abs(x)) / 2 AS turnover FROM p GROUP BY 1), g AS (SELECT trade_date, avg(label) AS gross FROM w GROUP BY 1) SELECT round(quantile_cont(turnover, 0.95), 6) AS turnover_p95, round(avg(gross) - 0.003::DOUBLE * avg(turnover), 6) AS net, round(sum(turnover) * 0.003::DOUBLE / sum(abs(gross)), 6) AS cost_share FROM t JOIN g USING (trade_date) WHERE gross IS NOT NULL""")
def a_costed_returns(spark, sf):
    """Long-only best ten: mean after costs, the turnover's 95th percentile and the share of the gross that costs are."""
    p = bars(spark, sf).select("code", "trade_date", "volume", "close")
    picks = scoring.equal_targets(p, "volume", 10, 1.0)
    gross = picks.join(labels.forward_label(p, "close", 5, 1), ["code", "trade_date"]).groupBy("trade_date").agg(F.avg("label").alias("gross"))
    both = portfolio.turnover(picks, "target_weight").join(gross, "trade_date").where("gross IS NOT NULL")
    net = F.avg("gross") - 0.003 * F.avg("turnover")
    return both.agg(F.round(F.percentile("turnover", F.lit(0.95)), 6).alias("turnover_p95"), F.round(net, 6).alias("net"), F.round(F.sum("turnover") * 0.003 / F.sum(F.abs("gross")), 6).alias("cost_share"))


@query(f"""WITH {PANEL}, m AS (SELECT trade_date, avg(close) AS a, avg(high) AS b FROM panel GROUP BY 1), r AS (SELECT trade_date, a / first_value(a) OVER w AS nav, b / first_value(b) OVER w AS benchmark FROM m WINDOW w AS (ORDER BY trade_date)) SELECT trade_date, round(nav / benchmark, 6) AS relative, round(nav / benchmark / max(nav / benchmark) OVER (ORDER BY trade_date) - 1, 6) + 0.0 AS drawdown FROM r""")
def w_relative_nav(spark, sf):
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date")
    m = bars(spark, sf).groupBy("trade_date").agg(F.avg("close").alias("a"), F.avg("high").alias("b"))
    r = m.select("trade_date", (F.col("a") / F.first("a").over(w) / (F.col("b") / F.first("b").over(w))).alias("relative"))
    return r.select("trade_date", F.round("relative", 6).alias("relative"), (F.round(F.col("relative") / F.max("relative").over(w) - 1, 6) + 0.0).alias("drawdown"))


@query(f"""WITH {PANEL} SELECT code, trade_date, round({lag('close', 1)}, 5) AS pre_close FROM panel""")
def w_chunk_carry(spark, sf):
    """Previous closes of yearly chunks: each code's last close of earlier chunks is carried into its first row of the next one."""
    p = bars(spark, sf).select("code", "trade_date", "close", F.year("trade_date").alias("chunk"))
    inside = F.lag("close").over(Window.partitionBy("code", "chunk").orderBy("trade_date"))
    last = p.groupBy("code", "chunk").agg(F.max_by("close", "trade_date").alias("last"))
    carried = last.withColumn("carried", F.lag("last").over(Window.partitionBy("code").orderBy("chunk"))).select("code", "chunk", "carried")
    out = p.withColumn("inside", inside).join(carried, ["code", "chunk"])
    return out.select("code", "trade_date", F.round(F.coalesce("inside", "carried"), 5).alias("pre_close"))


@query(f"""WITH {PANEL}, n AS (SELECT code, trade_date, close * 2 AS close FROM panel WHERE trade_date >= '2000-06-01'), a AS (SELECT code, trade_date, close FROM panel WHERE trade_date < '2000-06-01' UNION ALL SELECT * FROM n) SELECT code, trade_date, round(close, 5) AS close, round(lag(close) OVER (PARTITION BY code ORDER BY trade_date), 5) AS pre_close FROM a""")
def k_tail_repaired(spark, sf):
    """A replaced tail, each key once (the last said), with previous closes repaired across the boundary."""
    p = bars(spark, sf).select("code", "trade_date", "close")
    said = p.withColumn("nth", F.lit(0)).unionByName(p.withColumn("close", F.col("close") * 2).withColumn("nth", F.lit(1)))  # the delta says each row twice
    delta = panel.latest_per_key(said, ["code", "trade_date"], F.col("nth").desc()).drop("nth")
    out = panel.previous_close(panel.tail_replace(p, delta, "trade_date", F.lit("2000-06-01").cast("date")).withColumns({"high": F.col("close"), "low": F.col("close")}))
    return rounded(out, 5, "close", "pre_close").select("code", "trade_date", "close", "pre_close")


@query(f"""WITH {PANEL}, f AS (SELECT *, 1 + code % 5 / 10.0::DOUBLE AS factor FROM panel) SELECT code, trade_date, round(amount * 10 / (volume * {FEE}::DOUBLE) * CASE WHEN code % 2 = 0 THEN factor ELSE 1 END, 4) AS vwap, round(low * CASE WHEN code % 2 = 0 THEN factor ELSE 1 END, 4) AS cost FROM f""")
def p_adjusted_once(spark, sf):
    """VWAP and chip cost in adjusted prices, multiplied only where they are not adjusted yet."""
    p = bars(spark, sf).withColumns({"factor": 1 + F.col("code") % 5 / 10.0, "done": F.col("code") % 2 == 1})
    return rounded(panel.adjusted_once(p.withColumn("vwap", F.try_divide(F.col("amount") * 10, F.col("volume") * FEE)).withColumn("cost", F.col("low")), ["vwap", "cost"], "factor", "done"), 4, "vwap", "cost").select("code", "trade_date", "vwap", "cost")


@query(f"""WITH {SQL_METRICS}, s AS (SELECT k, overfit, quick * 0.55::DOUBLE + overfit * 0.15::DOUBLE + (50 + k % 50) * 0.20::DOUBLE + adversarial * 0.10::DOUBLE AS simulated, ic, ir, quick FROM m) SELECT k, round(simulated, 3) AS simulated, coalesce(simulated >= 60 AND quick >= 70 AND abs(ic) >= 0.02 AND abs(ir) >= 0.30, false) AS passes FROM s""")
def z_rescored(spark, sf):
    """Registry rows with a new rolling score, and whether they would pass a gate at 60."""
    df = gates.simulated_deep(metrics(spark, sf).withColumn("rolling", 50 + F.col("k") % 50)).withColumn("deep", F.col("simulated"))
    return df.select("k", F.round("simulated", 3).alias("simulated"), F.coalesce(gates.official(60.0), F.lit(False)).alias("passes"))


@query(f"""WITH {PANEL}, {DAYS}, d AS (SELECT max(trade_date) AS day FROM panel WHERE trade_date <= '1999-05-05') SELECT s_suppkey AS code, s_name AS name, day, round(close, 5) AS close, CAST(volume AS BIGINT) AS traded FROM supplier, d LEFT JOIN panel ON code = s_suppkey AND trade_date = day""")
def z_account_context(spark, sf):
    """Names, closes and trades of every code on the last session by a day."""
    p = bars(spark, sf).select("code", "trade_date", "close", "volume")
    day = p.where(F.col("trade_date") <= F.lit("1999-05-05").cast("date")).agg(F.max("trade_date").alias("day"))
    at = p.join(F.broadcast(day), F.col("trade_date") == F.col("day")).select("code", F.round("close", 5).alias("close"), F.col("volume").cast("long").alias("traded"))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    return names.join(F.broadcast(day)).join(at, "code", "left").select("code", "name", "day", "close", "traded")


@query(f"""WITH {PANEL}, b AS (SELECT code, trade_date, CASE WHEN volume % 3 > 0 THEN close * 1.1::DOUBLE END AS up_limit, close FROM panel), f AS (SELECT code, trade_date, close * 1.2::DOUBLE AS up FROM panel WHERE volume % 3 = 0 AND volume % 2 = 0) SELECT b.code, b.trade_date, round(coalesce(up_limit, up), 5) AS up_limit, CASE WHEN up_limit IS NOT NULL THEN 'there' WHEN up IS NOT NULL THEN 'backfilled' ELSE 'missing' END AS origin FROM b LEFT JOIN f ON f.code = b.code AND f.trade_date = b.trade_date""")
def k_backfilled(spark, sf):
    """Missing limits taken from a backfill; what was there stays."""
    p = bars(spark, sf)
    base = p.select("code", "trade_date", F.when(F.col("volume") % 3 > 0, F.col("close") * 1.1).alias("up_limit"))
    fill = p.where("volume % 3 = 0 AND volume % 2 = 0").select("code", "trade_date", (F.col("close") * 1.2).alias("up_limit"))
    return rounded(panel.backfilled(base, fill, ["code", "trade_date"], "up_limit"), 5, "up_limit")


@query(f"""WITH {PANEL}, r AS (SELECT trade_date, discount, volume, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS r FROM panel), d AS (SELECT trade_date, avg(CASE WHEN discount >= 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS s, max(volume) > 49 AS crowded FROM r WHERE r <= 5 GROUP BY 1)
SELECT avg(s) < 0.05 AND quantile_cont(s, 0.95) < 0.15 AS distress_ok, avg(CAST(crowded AS INTEGER)) < 0.9 AS crowd_ok, (avg(s) < 0.05 AND quantile_cont(s, 0.95) < 0.15) AND avg(CAST(crowded AS INTEGER)) < 0.9 AS allowed FROM d""")
def g_combined_guard(spark, sf):
    p = bars(spark, sf)
    guard = evaluate.exposure(p, "volume", F.col("discount") >= 0.1, 5).select((~F.col("blocked")).alias("distress_ok"))
    top = scoring.top_k(p.select("code", "trade_date", "volume"), "volume", 5).groupBy("trade_date").agg((F.max("volume") > 49).alias("crowded"))
    crowd = top.agg((F.avg(F.col("crowded").cast("int")) < 0.9).alias("crowd_ok"))
    return guard.join(F.broadcast(crowd)).withColumn("allowed", F.col("distress_ok") & F.col("crowd_ok"))  # one row each


@query("""WITH l AS (SELECT p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) AS blob FROM part) SELECT p_partkey, CASE WHEN regexp_matches(blob, '(^|[^a-z0-9])(st|red)([^a-z0-9]|$)') OR contains(blob, 'copper') THEN 'metal' WHEN contains(blob, 'standard') THEN 'plain' ELSE 'other' END AS kind FROM l""")
def p_search_kinds(spark, sf):
    """Kinds by tokens of a search text: short tokens must be whole words, long ones may lie anywhere."""
    blob = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return table(spark, sf, "part").select("p_partkey", panel.kind_by_tokens(blob, {"metal": ["st", "red", "copper"], "plain": ["standard"]}, "other").alias("kind"))


# Values of three tails of days from a state table, each expression's SQL over all days.
TAILED = {"d23_ts_mean": 4, "d33_ts_corr": 5, "d40_ema": 5, "rank_momentum": 6, "d44_macd": 5, "d45_obv": 4, "d53_nested": 5}
TAIL_DAYS = ("1998-06-30", "1999-12-31", "2000-12-31")


def _tail_sql() -> str:
    parts = []
    for i, n in enumerate(TAILED):
        step, sql = factors.STAGED[n][1:3] if n in factors.STAGED else ("0", factors.CASES[n][1])
        parts.append(f"s{i} AS (SELECT *, {step} AS step FROM panel), t{i} AS (SELECT code, trade_date, round(CAST({sql} AS DOUBLE), {TAILED[n]}) AS {n} FROM s{i})")
    joined = " ".join(f"JOIN t{i} USING (code, trade_date)" for i in range(1, len(TAILED)))
    return f"WITH {PANEL}, {', '.join(parts)} SELECT code, trade_date, {', '.join(TAILED)} FROM t0 {joined}"


@query(_tail_sql())
def k_factor_tail(spark, sf):
    """Values appended tail by tail: each tail reads its own days and the state that the one before left."""
    texts = {n: (factors.STAGED[n] if n in factors.STAGED else factors.CASES[n])[0] for n in TAILED}
    p, day = bars(spark, sf), F.col("trade_date")
    limits = [F.lit(x).cast("date") for x in TAIL_DAYS]
    values, state = tail.begin(p.where(day <= limits[0]), texts)
    out = values
    for since, until in zip(limits, [*limits[1:], None]):
        fresh = p.where((day > since) & (F.lit(True) if until is None else day <= until))
        values, state = tail.extend(graph.shared_checkpoint(state), fresh, texts)
        out = out.unionByName(values)
    return out.select("code", "trade_date", *[F.round(F.col(n).cast("double"), d).alias(n) for n, d in TAILED.items()])


@query(f"""WITH {PANEL}, {', '.join(f"{k} AS (SELECT o_custkey % 100 AS code, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS v FROM orders WHERE o_orderpriority IN ({', '.join(map(repr, KINDS[k]))}) GROUP BY 1, 2)" for k in ('equity', 'shares'))}
SELECT p.code, p.trade_date, round(equity.v / shares.v, 6) AS book_per_share, round(close / (equity.v / shares.v), 4) AS price_to_book FROM panel p ASOF LEFT JOIN equity ON p.code = equity.code AND p.trade_date >= equity.d ASOF LEFT JOIN shares ON p.code = shares.code AND p.trade_date >= shares.d""")
def p_per_share(spark, sf):
    """Book value per share and price to book, of figures as known on each day."""
    out = bars(spark, sf).select("code", "trade_date", "close")
    for kind in ("equity", "shares"):
        out = panel.asof_join(out, announced(spark, sf, kind), "code", "trade_date", f"{kind}_date", [kind])
    return rounded(rounded(panel.per_share(out, "equity", "shares", "close"), 6, "book_per_share"), 4, "price_to_book").select("code", "trade_date", "book_per_share", "price_to_book")


COVERED = f"c AS (SELECT code, trade_date, CASE WHEN volume > 2 THEN close END AS close, {lag('close', 1)} AS pre_close, CASE WHEN volume % 7 > 0 THEN discount END AS discount, row_number() OVER (PARTITION BY code ORDER BY trade_date) = 1 AS first FROM panel)"


@query(f"""WITH {PANEL}, {COVERED}, u AS (SELECT 'close' AS field, trade_date, true AS wanted, close IS NOT NULL AS there FROM c UNION ALL SELECT 'pre_close', trade_date, NOT first, pre_close IS NOT NULL FROM c UNION ALL SELECT 'discount', trade_date, true, discount IS NOT NULL FROM c),
g AS (SELECT field, trade_date, count(*) FILTER (wanted) AS expected, count(*) FILTER (wanted AND there) AS there FROM u GROUP BY 1, 2) SELECT field, trade_date, expected, round(there / nullif(expected, 0), 6) AS ratio, there / nullif(expected, 0) = 0 AS zero, there / nullif(expected, 0) < 0.98 AS low FROM g""")
def a_field_coverage(spark, sf):
    """Coverage of each field by date; a code's first day need not have a previous close."""
    p = bars(spark, sf)
    before = F.lag("close").over(Window.partitionBy("code").orderBy("trade_date"))
    c = p.select("code", "trade_date", before.alias("pre_close"), F.when(F.col("volume") > 2, F.col("close")).alias("close"), F.when(F.col("volume") % 7 > 0, F.col("discount")).alias("discount"))
    return rounded(evaluate.field_coverage(c, ["close", "pre_close", "discount"], ["pre_close"]), 6, "ratio")


@query(f"""WITH {PANEL}, s AS (SELECT code, trade_date, CASE WHEN volume % 5 > 0 THEN discount END AS s FROM panel), b AS (SELECT *, lag(s) OVER (PARTITION BY code ORDER BY trade_date) AS before FROM s)
SELECT trade_date, count(*) AS expected, round(1 - count(s) / count(*), 6) AS missing, round(count(*) FILTER (s = before) / nullif(count(s), 0), 6) AS identical FROM b GROUP BY 1""")
def a_replay_quality(spark, sf):
    """Share of codes without a prediction on each date, and of predictions that are the day before's."""
    p = bars(spark, sf)
    return rounded(evaluate.replay_quality(p.select("code", "trade_date"), p.where("volume % 5 > 0"), "discount"), 6, "missing", "identical")


@query("""WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders UNION SELECT DISTINCT CAST(year(ts) AS INTEGER) FROM events), k AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), b AS (SELECT y FROM y WHERE y NOT IN (SELECT year(d) FROM k))
SELECT d AS trade_date, true AS known FROM k WHERE year(d) IN (SELECT y FROM y) UNION ALL SELECT CAST(d AS DATE), false FROM (SELECT unnest(generate_series(make_date(y, 1, 1)::TIMESTAMP, make_date(y, 12, 31)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM b) WHERE isodow(d) < 6""")
def s_calendar_fallback(spark, sf):
    """Trading dates of each year that orders or events name; business days where the calendar has none."""
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).union(table(spark, sf, "events").select(F.year("ts").alias("year")))
    return panel.calendar_or_business_days(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")), years)


@query(f"""WITH {PANEL}, i AS (SELECT 'index' || code % 3 AS code, trade_date, avg(close) FILTER (volume > 10) AS close FROM panel GROUP BY 1, 2), r AS (SELECT * FROM i WHERE close IS NOT NULL)
SELECT code, trade_date, round(close, 5) AS close, round(lag(close) OVER (PARTITION BY code ORDER BY trade_date), 5) AS pre_close, min(trade_date) OVER (PARTITION BY code) AS list_date FROM r""")
def w_index_frame(spark, sf):
    """Three averages of the panel as securities of their own, listed on their first date."""
    means = bars(spark, sf).groupBy(F.concat(F.lit("index"), (F.col("code") % 3).cast("string")).alias("name"), "trade_date").agg(F.avg(F.when(F.col("volume") > 10, F.col("close"))).alias("value"))
    return rounded(panel.index_frame(means, "name", "value"), 5, "close", "pre_close")
