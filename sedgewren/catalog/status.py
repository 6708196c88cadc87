"""Queries of status, universe, limits, calendars, feature matrices and styles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, matrix, panel, scoring, status
from .panels import DAYS, FACTORS, LABEL, LIMITS, five_factors, query, rounded
from .views import PANEL, lag, line_count, rank, spread, table, ts
from .views import panel as bars

# Stand-ins: a supplier's listing, its names over time, and the days of special treatment.
BOOK = """book AS (SELECT s_suppkey AS code, CASE s_suppkey % 12 WHEN 0 THEN 'ST Alpha' WHEN 1 THEN ' *st beta' WHEN 2 THEN 'SST x' WHEN 3 THEN 'y 退市' ELSE s_name END AS name, CASE s_suppkey % 10 WHEN 0 THEN 'D' WHEN 1 THEN 'P' WHEN 2 THEN 'I' ELSE 'L' END AS list_status,
DATE '1992-01-01' + CAST(s_suppkey % 700 AS INTEGER) AS list_date, CASE WHEN s_suppkey % 10 = 0 THEN DATE '1996-01-01' + CAST(s_suppkey % 50 * 30 AS INTEGER) END AS delist_date FROM supplier)"""


def book(spark, sf):
    k = F.col("s_suppkey")
    name = F.when(k % 12 == 0, "ST Alpha").when(k % 12 == 1, " *st beta").when(k % 12 == 2, "SST x").when(k % 12 == 3, "y 退市").otherwise(F.col("s_name"))
    kind = F.when(k % 10 == 0, "D").when(k % 10 == 1, "P").when(k % 10 == 2, "I").otherwise("L")
    day = lambda s, n: F.date_add(F.lit(s).cast("date"), n.cast("int"))
    return table(spark, sf, "supplier").select(k.alias("code"), name.alias("name"), kind.alias("list_status"), day("1992-01-01", k % 700).alias("list_date"), F.when(k % 10 == 0, day("1996-01-01", k % 50 * 30)).alias("delist_date"))


@query(f"""WITH {BOOK} SELECT code, regexp_matches(name, '(?i)^\\s*(\\*?ST|SST)') AS special, contains(name, '退市') AS delisting, upper(trim(name)) LIKE 'ST%' OR upper(trim(name)) LIKE '*ST%' OR contains(name, '退市') AS distressed FROM book""")
def p_distress_rules(spark, sf):
    n = F.col("name")
    return book(spark, sf).select("code", status.special_name(n).alias("special"), status.delist_name(n).alias("delisting"), status.distressed(n).alias("distressed"))


@query(f"""WITH {BOOK} SELECT code, list_status FROM book WHERE list_status IN ('L', 'P') OR (list_status = 'D' AND list_date <= DATE '1998-06-30' AND delist_date > DATE '1998-06-30')""")
def p_tradable(spark, sf):
    return status.tradable(book(spark, sf), F.lit("1998-06-30").cast("date")).select("code", "list_status")


@query(f"""WITH {BOOK} SELECT code FROM book WHERE list_status = 'D' OR delist_date IS NOT NULL OR regexp_matches(name, '(?i)^\\s*(\\*?ST|SST)') OR contains(name, '退市')""")
def p_name_candidates(spark, sf):
    return status.name_candidates(book(spark, sf)).select("code")


NAMES = """names AS (SELECT o_custkey % 100 AS code, CAST(o_orderdate AS DATE) AS start, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS "end", CASE o_orderkey % 7 WHEN 0 THEN 'ST ' || o_orderkey WHEN 1 THEN '退市 ' || o_orderkey ELSE 'name ' || o_orderkey END AS name,
CASE o_orderkey % 9 WHEN 0 THEN 'st change' WHEN 1 THEN '终止上市' ELSE 'other' END AS reason FROM orders)"""


def names(spark, sf):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    name = F.when(k % 7 == 0, F.concat(F.lit("ST "), k.cast("string"))).when(k % 7 == 1, F.concat(F.lit("退市 "), k.cast("string"))).otherwise(F.concat(F.lit("name "), k.cast("string")))
    reason = F.when(k % 9 == 0, "st change").when(k % 9 == 1, "终止上市").otherwise("other")
    return table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("code"), d.alias("start"), F.when(k % 5 > 0, F.date_add(d, (k % 90).cast("int"))).alias("end"), name.alias("name"), reason.alias("reason"))


@query(f"""WITH {PANEL}, {BOOK}, {NAMES}, n AS (SELECT *, regexp_matches(name, '(?i)^\\s*(\\*?ST|SST)') OR contains(upper(reason), 'ST') AS st, contains(name, '退市') OR contains(reason, '终止上市') AS gone FROM names),
h AS (SELECT p.code, p.trade_date, arg_max(n.name, (start, n.name)) AS new_name, coalesce(bool_or(st), false) AS st, coalesce(bool_or(gone), false) AS gone FROM panel p JOIN n ON n.code = p.code AND p.trade_date >= start AND ("end" IS NULL OR p.trade_date <= "end") GROUP BY 1, 2),
s AS (SELECT p.code, p.trade_date, coalesce(new_name, book.name) AS name, CASE WHEN list_status = 'I' THEN 'I' WHEN p.trade_date > delist_date THEN 'D' ELSE 'L' END AS list_status, coalesce(h.st, false) OR p.volume = 13 AS st, coalesce(h.gone, false) AS gone FROM panel p LEFT JOIN book USING (code) LEFT JOIN h ON h.code = p.code AND h.trade_date = p.trade_date)
SELECT code, trade_date, name, list_status, CASE WHEN list_status = 'D' OR gone THEN 'delist' WHEN st THEN 'st' ELSE 'normal' END AS st_status FROM s""")
def p_status(spark, sf):
    p = bars(spark, sf).select("code", "trade_date", "volume")
    return status.with_status(p.select("code", "trade_date"), book(spark, sf), p.where("volume = 13"), names(spark, sf))


@query(f"""WITH {PANEL}, {BOOK}, {NAMES}, n AS (SELECT *, contains(name, '退市') OR contains(reason, '终止上市') AS gone FROM names), g AS (SELECT DISTINCT p.code, p.trade_date FROM panel p JOIN n ON gone AND n.code = p.code AND p.trade_date >= start AND ("end" IS NULL OR p.trade_date <= "end")),
s AS (SELECT CASE WHEN list_status = 'I' THEN 'I' WHEN p.trade_date > delist_date THEN 'D' ELSE 'L' END AS list_status, g.code IS NOT NULL AS gone FROM panel p LEFT JOIN book USING (code) LEFT JOIN g ON g.code = p.code AND g.trade_date = p.trade_date) SELECT list_status, count(*) AS n, count(*) FILTER (list_status = 'D' OR gone) AS delisting FROM s GROUP BY 1""")
def a_status_counts(spark, sf):
    s = p_status(spark, sf)
    return s.groupBy("list_status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("st_status") == "delist").alias("delisting"))


RAW = f"""{LIMITS}, raw AS (SELECT b.*, low AS open, list_date, list_status, CASE WHEN code % 4 > 0 THEN pre_close * (1 + rate) END AS up_limit, CASE WHEN code % 4 > 0 THEN pre_close * (1 - rate) END AS down_limit, (close - pre_close) / pre_close * 100 AS pct_chg, CASE WHEN volume > 3 THEN volume / 1000 ELSE NULL END AS turnover FROM b LEFT JOIN book USING (code))"""


def raw_rows(spark, sf):
    p = panel.previous_close(bars(spark, sf)).withColumn("rate", panel.limit_rate(F.col("code").cast("string"), F.col("code") % 7 == 0)).join(book(spark, sf).drop("name", "delist_date"), "code", "left")
    limits = {"up_limit": F.when(F.col("code") % 4 > 0, F.col("pre_close") * (1 + F.col("rate"))), "down_limit": F.when(F.col("code") % 4 > 0, F.col("pre_close") * (1 - F.col("rate")))}
    return p.withColumns(limits | {"open": F.col("low"), "turnover": F.when(F.col("volume") > 3, F.col("volume") / 1000)})


@query(f"""WITH {PANEL}, {BOOK}, {RAW} SELECT code, trade_date, CASE WHEN up_limit IS NOT NULL AND down_limit IS NOT NULL THEN 'official' WHEN list_date = trade_date THEN 'structural_no_limit' WHEN list_status = 'I' THEN 'index' ELSE 'missing' END AS source FROM raw""")
def p_limit_source(spark, sf):
    df = raw_rows(spark, sf)
    return df.select("code", "trade_date", status.limit_source(df).alias("source"))


_PIN = " AND ".join(f"abs({{c}} - {{at}}) <= 1e-4".format(c=c, at="{at}") for c in ("open", "high", "low", "close"))


@query(f"""WITH {PANEL}, {BOOK}, {RAW} SELECT code, trade_date, coalesce(close >= up_limit - 1e-4, false) AS limit_buy, coalesce(close <= down_limit + 1e-4, false) AS limit_sell, coalesce(open >= up_limit - 1e-4, false) AS limit_buy_open, coalesce(open <= down_limit + 1e-4, false) AS limit_sell_open,
coalesce((open + close) / 2 >= up_limit - 1e-4, false) AS limit_buy_mid, coalesce((open + close) / 2 <= down_limit + 1e-4, false) AS limit_sell_mid, coalesce(pct_chg / 100 >= rate - 1e-4, false) AS fallback_buy, coalesce(pct_chg / 100 <= -(rate - 1e-4), false) AS fallback_sell,
coalesce({_PIN.format(at='up_limit')} AND turnover / 100 <= 0.0005, false) AS sealed_up, coalesce({_PIN.format(at='down_limit')} AND turnover / 100 <= 0.0005, false) AS sealed_down FROM raw""")
def p_execution_flags(spark, sf):
    df = status.execution_flags(raw_rows(spark, sf))
    return df.select("code", "trade_date", *[c for c in df.columns if c.startswith(("limit_buy", "limit_sell", "fallback", "sealed"))])


@query(f"""WITH {PANEL}, {BOOK}, {RAW} SELECT trade_date, count(*) AS n, count(*) FILTER (up_limit IS NOT NULL AND down_limit IS NOT NULL) AS covered, round(count(*) FILTER (up_limit IS NOT NULL AND down_limit IS NOT NULL) / count(*), 6) AS share FROM raw GROUP BY 1 ORDER BY 4, 1 LIMIT 10""")
def a_limit_coverage(spark, sf):
    """The ten dates whose limits are covered worst."""
    known = F.col("up_limit").isNotNull() & F.col("down_limit").isNotNull()
    of = raw_rows(spark, sf).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("covered"))
    return of.withColumn("share", F.round(F.col("covered") / F.col("n"), 6)).orderBy("share", "trade_date").limit(10)


@query(f"""WITH {PANEL}, b AS (SELECT code, trade_date, CASE WHEN volume % 17 > 0 THEN {lag('close', 1)} END AS official, {lag('trade_date', 1)} AS before FROM panel) SELECT DISTINCT trade_date FROM b WHERE official IS NULL AND before IS NOT NULL""")
def a_no_official_close(spark, sf):
    p = panel.previous_close(bars(spark, sf))
    return status.no_official_close(p.withColumn("official", F.when(F.col("volume") % 17 > 0, F.col("pre_close"))))


@query(f"""WITH {PANEL}, f AS (SELECT code, trade_date, close, volume, 1 + code % 5 / 10.0::DOUBLE AS factor FROM panel), a AS (SELECT *, close * factor AS adj FROM f)
SELECT code, trade_date, round(close, 5) AS raw_close, round(adj, 5) AS close, round(volume / factor, 5) AS volume, round(adj / lag(adj) OVER (PARTITION BY code ORDER BY trade_date) - 1, 6) + 0.0 AS change FROM a""")
def p_provider_prices(spark, sf):
    p = bars(spark, sf).withColumns({"open": F.col("low"), "factor": 1 + F.col("code") % 5 / 10.0})
    return rounded(status.provider_prices(p), 5, "raw_close", "close", "volume").select("code", "trade_date", "raw_close", "close", "volume", (F.round("change", 6) + 0.0).alias("change"))


@query(f"""WITH {PANEL}, al AS (SELECT s_suppkey AS alias, s_suppkey - 1 AS canonical, DATE '1995-01-01' AS since, CASE WHEN s_suppkey % 4 = 1 THEN DATE '1997-12-31' END AS until FROM supplier WHERE s_suppkey % 2 = 1),
r AS (SELECT coalesce(canonical, code) AS code, trade_date, volume, alias IS NULL AS own, alias FROM panel LEFT JOIN al ON code = alias AND trade_date >= since AND (until IS NULL OR trade_date <= until))
SELECT code, trade_date, volume FROM (SELECT *, row_number() OVER (PARTITION BY code, trade_date ORDER BY own DESC, alias) AS nth FROM r) WHERE nth = 1""")
def j_aliases(spark, sf):
    k = F.col("s_suppkey")
    al = table(spark, sf, "supplier").where(k % 2 == 1).select(k.alias("alias"), (k - 1).alias("canonical"), F.lit("1995-01-01").cast("date").alias("since"), F.when(k % 4 == 1, F.lit("1997-12-31").cast("date")).alias("until"))
    return status.aliases_expanded(bars(spark, sf).select("code", "trade_date", "volume"), al)


@query("""WITH e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT day, CAST(date_trunc('month', day) - INTERVAL 2 MONTH AS DATE) AS test FROM e)
SELECT day, DATE '1992-01-01' AS train_start, CAST(test - INTERVAL 6 MONTH AS DATE) - 1 AS train_end, CAST(test - INTERVAL 6 MONTH AS DATE) AS valid_start, test - 1 AS valid_end, test AS test_start, day AS test_end FROM b""")
def w_model_windows(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", *[c.alias(n) for n, c in status.windows(F.col("day"), "1992-01-01", 6, 3).items()])


@query(f"""WITH {PANEL}, c AS (SELECT trade_date AS session, lead(trade_date, 1) OVER (ORDER BY trade_date) AS execution, lag(trade_date, 6) OVER (ORDER BY trade_date) AS purged_end FROM (SELECT DISTINCT trade_date FROM panel WHERE isodow(trade_date) < 6)),
e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT day, session, execution, purged_end FROM e ASOF LEFT JOIN c ON day >= session""")
def w_sessions_around(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return status.sessions_around(days, panel.calendar(bars(spark, sf).where(F.weekday("trade_date") < 5)), "day", 1, 5)


# Feature matrices.

SEVEN = {"adj": ("avg(l_tax)", None), "basics": ("count(*)", None), "limits": ("max(l_extendedprice)", "N"), "flow": ("sum(l_quantity)", "R"), "margin": ("sum(l_quantity)", "A"), "chips": ("min(l_extendedprice)", "R"), "hfq": ("max(l_discount)", "A")}


@query(f"""WITH {PANEL}, {', '.join(f"{n} AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date, CAST({e} AS DOUBLE) AS v FROM lineitem" + (f" WHERE l_returnflag = '{flag}'" if flag else "") + " GROUP BY 1, 2)" for n, (e, flag) in SEVEN.items())}
SELECT p.code, p.trade_date, {', '.join(f'round({n}.v, 4) AS {n}_v' for n in SEVEN)} FROM panel p {' '.join(f'LEFT JOIN {n} ON {n}.code = p.code AND {n}.trade_date = p.trade_date' for n in SEVEN)}""")
def j_seven_facts(spark, sf):
    lines = table(spark, sf, "lineitem").withColumns({"code": F.col("l_suppkey"), "trade_date": F.to_date("l_shipdate")})
    facts = {n: (lines.where(F.col("l_returnflag") == flag) if flag else lines).groupBy("code", "trade_date").agg(F.expr(e).cast("double").alias("v")) for n, (e, flag) in SEVEN.items()}
    return rounded(matrix.with_facts(bars(spark, sf).select("code", "trade_date"), facts), 4, *[f"{n}_v" for n in SEVEN])


def long_values(spark, sf):
    """The long store of five factors; some have no value on some days."""
    fx = five_factors(spark, sf)
    rows = F.explode(F.array(*[F.struct(F.lit(f"f{i}").alias("factor"), F.col(f"f{i}").alias("value")) for i in range(1, 6)]))
    return fx.select("code", "trade_date", rows.alias("x")).select("x.factor", "code", "trade_date", "x.value").where("value IS NOT NULL AND NOT (factor = 'f1' AND code % 3 = 0)")


LONG = f"{FACTORS}, long AS (SELECT * FROM (SELECT code, trade_date, unnest(['f1', 'f2', 'f3', 'f4', 'f5']) AS factor, unnest([f1, f2, f3, f4, f5]) AS value FROM fx) WHERE value IS NOT NULL AND NOT (factor = 'f1' AND code % 3 = 0))"


@query(f"""WITH {PANEL}, {LONG}, {LABEL}, w AS (SELECT code, trade_date, max(value) FILTER (factor = 'f1') AS f1, max(value) FILTER (factor = 'f3') AS f3, max(value) FILTER (factor = 'f5') AS f5 FROM long WHERE factor IN ('f1', 'f3', 'f5') GROUP BY 1, 2)
SELECT code, trade_date, round(f1, 4) AS f1, round(f3, 4) AS f3, round(f5, 4) AS f5, round(label, 6) + 0.0 AS label FROM w LEFT JOIN lab USING (code, trade_date)""")
def x_feature_matrix(spark, sf):
    lab = spread(labels.forward_label(bars(spark, sf), "close", 5, 1), line_count(spark, sf), "code", "trade_date")  # the join takes its parts
    out = rounded(matrix.feature_matrix(long_values(spark, sf), ["f1", "f3", "f5"], lab), 4, "f1", "f3", "f5")
    return rounded(out, 6, "label")


@query(f"""WITH {PANEL}, {LONG} SELECT factor, code, trade_date, round(value, 4) AS value FROM long WHERE factor <> 'f2' UNION ALL SELECT 'f2', code, trade_date, round(volume * 2, 4) FROM panel""")
def k_upsert_column(spark, sf):
    new = bars(spark, sf).select("code", "trade_date", (F.col("volume") * 2).alias("value"))
    return rounded(matrix.upsert_column(long_values(spark, sf), "f2", new), 4, "value")


GAPS = "v AS (SELECT code, trade_date, CASE WHEN volume > 15 THEN close END AS a, CASE WHEN volume > 25 THEN high END AS b, CASE WHEN discount > 0.03 THEN low END AS c, CAST(NULL AS DOUBLE) AS d, 1.0::DOUBLE AS e FROM panel)"


def gaps(spark, sf):
    return bars(spark, sf).select("code", "trade_date", F.when(F.col("volume") > 15, F.col("close")).alias("a"), F.when(F.col("volume") > 25, F.col("high")).alias("b"), F.when(F.col("discount") > 0.03, F.col("low")).alias("c"), F.lit(None).cast("double").alias("d"), F.lit(1.0).alias("e"))


@query(f"""WITH {PANEL}, {GAPS}, g AS (SELECT min(b) - 0.001::DOUBLE * (max(b) - min(b)) AS g FROM v) SELECT code, trade_date, round(coalesce(a, 0), 5) AS a, round(coalesce(b, min(b) OVER w - 0.001::DOUBLE * (max(b) OVER w - min(b) OVER w), g), 5) AS b, round(c, 5) AS c FROM v, g WINDOW w AS (PARTITION BY trade_date)""")
def g_missing_policies(spark, sf):
    return rounded(matrix.fill_missing(gaps(spark, sf).drop("d", "e"), {"a": matrix.ZERO, "b": matrix.FLOOR, "c": matrix.NEUTRAL}), 5, "a", "b", "c")


@query(f"""WITH {PANEL}, {GAPS}, s AS (SELECT CASE WHEN trade_date < '1998-01-01' THEN 'train' WHEN trade_date < '2000-01-01' THEN 'valid' ELSE 'test' END AS segment, unnest(['a', 'b', 'c', 'd']) AS field, unnest([a, b, c, d]) IS NULL AS gone FROM v)
SELECT segment, field, count(*) AS n, CAST(count(*) FILTER (gone) AS BIGINT) AS gone, round(count(*) FILTER (gone) / count(*), 6) AS share FROM s GROUP BY 1, 2""")
def a_missing_report(spark, sf):
    d = F.col("trade_date")
    segment = F.when(d < F.lit("1998-01-01").cast("date"), "train").when(d < F.lit("2000-01-01").cast("date"), "valid").otherwise("test")
    return rounded(matrix.missing_report(gaps(spark, sf), ["a", "b", "c", "d"], segment), 6, "share")


@query(f"""WITH {PANEL}, {GAPS} SELECT * FROM (SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS field, unnest([count(a) = 0, count(b) = 0, count(c) = 0, count(d) = 0, count(e) = 0]) AS all_null, unnest([count(DISTINCT a) = 1, count(DISTINCT b) = 1, count(DISTINCT c) = 1, count(DISTINCT d) = 1, count(DISTINCT e) = 1]) AS constant FROM v) WHERE all_null OR constant""")
def a_flat_features(spark, sf):
    return matrix.flat_features(gaps(spark, sf), ["a", "b", "c", "d", "e"])


@query(f"""WITH {PANEL}, {LABEL} SELECT code, trade_date, round(CASE WHEN label IS NULL THEN NULL WHEN stddev_pop(label) OVER w > 0 THEN (label - avg(label) OVER w) / stddev_pop(label) OVER w ELSE 0 END, 5) + 0.0 AS label_z FROM lab WINDOW w AS (PARTITION BY trade_date)""")
def w_label_zscore(spark, sf):
    return rounded(matrix.label_zscore(labels.forward_label(bars(spark, sf), "close", 5, 1), "label"), 5, "label_z").select("code", "trade_date", "label_z")


@query(f"""WITH {PANEL}, r AS (SELECT code, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS r FROM panel) SELECT code, trade_date, CASE WHEN r <= 5 THEN 2.0 WHEN r <= 10 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM r""")
def w_focus_weights(spark, sf):
    return labels.grades(bars(spark, sf).select("code", "trade_date", "volume"), "volume").select("code", "trade_date", matrix.focus_weights(F.col("grade")).alias("weight"))


STYLES = f"""st AS (SELECT code, trade_date, amount AS total_mv, CASE WHEN code % 5 > 0 THEN amount * discount END AS float_mv, discount AS roe, CASE WHEN volume > 9 THEN high - low END AS eps_growth, close AS profit_growth FROM panel),
sp AS (SELECT code, trade_date, {', '.join(f"{rank(c)} AS {c}_pct" for c in ('total_mv', 'float_mv', 'roe', 'eps_growth', 'profit_growth'))} FROM st),
sf AS (SELECT code, trade_date, coalesce(total_mv_pct <= 0.2, false) OR coalesce(float_mv_pct <= 0.2, false) AS small_cap, coalesce(greatest(eps_growth_pct, profit_growth_pct, roe_pct) >= 0.8, false) AS high_growth, (coalesce(total_mv_pct >= 0.8, false) OR coalesce(float_mv_pct >= 0.8, false)) AND coalesce(roe_pct >= 0.6, false) AS blue_chip FROM sp)"""


def styles(spark, sf):
    p = bars(spark, sf).select("code", "trade_date", F.col("amount").alias("total_mv"), F.when(F.col("code") % 5 > 0, F.col("amount") * F.col("discount")).alias("float_mv"), F.col("discount").alias("roe"), F.when(F.col("volume") > 9, F.col("high") - F.col("low")).alias("eps_growth"), F.col("close").alias("profit_growth"))
    return matrix.style_flags(spread(p, line_count(spark, sf), "trade_date"))


@query(f"""WITH {PANEL}, {STYLES} SELECT code, trade_date, small_cap, high_growth, blue_chip FROM sf""")
def p_style_flags(spark, sf):
    return styles(spark, sf).select("code", "trade_date", "small_cap", "high_growth", "blue_chip")


@query(f"""WITH {PANEL}, {STYLES}, r AS (SELECT code, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, code) AS r FROM panel), j AS (SELECT r.trade_date, sf.* EXCLUDE (trade_date) FROM r LEFT JOIN sf ON sf.code = r.code AND sf.trade_date = r.trade_date AND r.code % 6 > 0 WHERE r <= 10)
SELECT trade_date, count(*) AS picks, count(code) AS known, {', '.join(f'round(avg(CAST({c} AS INTEGER)), 6) AS {c}' for c in ('small_cap', 'high_growth', 'blue_chip'))} FROM j GROUP BY 1""")
def a_style_exposure(spark, sf):
    picks = scoring.top_k(bars(spark, sf).select("code", "trade_date", "volume"), "volume", 10).select("code", "trade_date")
    flags = ["small_cap", "high_growth", "blue_chip"]
    picked = styles(spark, sf).where("code % 6 > 0").join(F.broadcast(picks), ["code", "trade_date"], "left_semi")  # ten a day
    return rounded(matrix.style_exposure(picks, picked, flags), 6, *flags)


LIMITED = f"""{LIMITS.replace('b AS', 'b0 AS')}, lim AS (SELECT code, trade_date, pre_close * (1 + rate) AS up_limit FROM b0)"""


@query(f"""WITH {PANEL}, {LABEL}, {LIMITED}, e AS (SELECT lab.*, (SELECT n.trade_date FROM days n WHERE n.cal_idx = days.cal_idx + 1) AS entry_date FROM lab JOIN days USING (trade_date))
SELECT e.code, e.trade_date, round(CASE WHEN coalesce(entry >= up_limit - 1e-6, false) THEN 0 ELSE label END, 6) + 0.0 AS label FROM e LEFT JOIN lim ON lim.code = e.code AND lim.trade_date = e.entry_date""")
def w_limit_label(spark, sf):
    """Labels, zero where the entry day's price is at that day's own upper limit."""
    p = panel.previous_close(bars(spark, sf)).withColumn("up_limit", F.col("pre_close") * (1 + panel.limit_rate(F.col("code").cast("string"), F.col("code") % 7 == 0)))
    days = panel.calendar(p)
    entry = p.join(days, "trade_date").select("code", (F.col("cal_idx") - 1).alias("cal_idx"), F.col("close").alias("entry"), "up_limit")
    at = labels.forward_label(p, "close", 5, 1).join(days, "trade_date").join(entry, ["code", "cal_idx"], "left")
    return rounded(at.select("code", "trade_date", labels.executable(F.col("label"), F.col("entry"), F.col("up_limit")).alias("label")), 6, "label")
