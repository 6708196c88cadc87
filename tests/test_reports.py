"""Reports that SQL cannot express, against plain loops."""

import random
from datetime import date, timedelta

import pytest

from sedgewren.plans import dsl
from sedgewren.operators import evaluate, graph, reports

SCHEMA = "account long, trade_date date, code long, score double, ret double"


def plain_replay(rows, k, drop, cost):
    out = []
    for account in sorted({r[0] for r in rows}):
        held, value = set(), 1.0
        for day in sorted({r[1] for r in rows if r[0] == account}):
            today = {r[2]: r for r in rows if r[0] == account and r[1] == day}
            score = lambda c: today[c][3] if c in today and today[c][3] is not None else None  # noqa: B023, E731
            order = lambda c: (score(c) is None, -(score(c) or 0.0), c)  # noqa: B023, E731
            fresh = sorted((c for c in today if c not in held and score(c) is not None), key=order)
            pool = sorted([*held, *fresh[: drop + max(0, k - len(held))]], key=order)
            sold = {c for c in pool[len(pool) - drop :] if c in held}
            bought = set(fresh[: max(0, len(sold) + k - len(held))])
            held = (held - sold) | bought
            net = sum((today[c][4] or 0.0) if c in today else 0.0 for c in held) / len(held) if held else 0.0
            net -= cost * (len(sold) + len(bought)) / k
            value *= 1 + net
            out.append((account, day, ",".join(map(str, sorted(held))), len(bought), len(sold), round(net, 9), round(value, 9)))
    return out


@pytest.mark.parametrize("batch", [7, 10_000])
def test_replay(spark, batch):
    rng, rows = random.Random(3), []
    for account in range(3):
        for d in range(12):
            for code in rng.sample(range(30), 20):
                score = None if rng.random() < 0.1 else float(rng.randint(0, 9))
                rows.append((account, date(2020, 1, 1) + timedelta(d), code, score, None if rng.random() < 0.1 else rng.uniform(-0.1, 0.1)))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = reports.replay(spark.createDataFrame(rows, SCHEMA), 6, 2, 0.001).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    mine = sorted((r.account, r.trade_date, r.holdings, r.buys, r.sells, round(r.net, 9), round(r.value, 9)) for r in got)
    assert mine == plain_replay(rows, 6, 2, 0.001)
    assert reports.replay(spark.createDataFrame([], SCHEMA), 5, 1, 0.0).count() == 0


def test_tie_evidence(spark):
    df = spark.createDataFrame([(date(2020, 1, 1), i, s) for i, s in enumerate([9.0, 7.0, 5.0, 5.0, 5.0, 1.0, None])], "trade_date date, code long, score double")
    r = reports.tie_evidence(df, "score", 4).first()
    assert (r.boundary, r.above, r.tied, r.slots) == (5.0, 2, 3, 2)
    assert reports.tie_evidence(df, "score", 8).count() == 0


def plain_linkage(nodes, dist, most):
    clusters = [{n} for n in nodes]
    while True:
        best = None
        for i in range(len(clusters)):
            for j in range(i):
                pairs = [dist.get((min(a, b), max(a, b))) for a in clusters[i] for b in clusters[j]]
                if None not in pairs and max(pairs) <= most and (best is None or max(pairs) < best[0]):
                    best = (max(pairs), i, j)
        if best is None:
            return {n: min(c) for c in clusters for n in c}
        clusters[best[2]] |= clusters.pop(best[1])


def test_complete_linkage(spark):
    rng = random.Random(9)
    nodes = list(range(14))
    dist = {(a, b): rng.random() for a in nodes for b in nodes if a < b and rng.random() < 0.9}
    df = spark.createDataFrame([(b, a, d) for (a, b), d in dist.items()], "a int, b int, d double")
    got = {r.node: r.cluster for r in graph.complete_linkage(spark.createDataFrame([(n,) for n in nodes], "node int"), df, 0.6).collect()}
    assert got == plain_linkage(nodes, dist, 0.6) and 3 < len(set(got.values())) < 14


def test_linkage_query_against_a_plain_loop(spark, sf, duck):
    from sedgewren import catalog

    x = dict(duck.sql("SELECT n_nationkey, coalesce(avg(c_acctbal), 0) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1").fetchall())
    got = {r.node: r.cluster for r in catalog.QUERIES["r_complete_linkage"](spark, sf).collect()}
    assert got == plain_linkage(sorted(x), {(a, b): abs(x[a] - x[b]) for a in x for b in x if a < b}, 500.0)


def test_structure_of_expressions(spark, sf):
    from sedgewren import catalog

    told = lambda x: (",".join(sorted(dsl.fields(x))), dsl.depth(x), dsl.lookback(x), dsl.signature(x))
    assert told("ts_corr(close, volume, 10)") == ("close,volume", 1, 9, "ts_corr(close,volume)")
    assert told("ts_delta(close, 3)") == ("close", 1, 3, "ts_delta(close)")
    assert told("scale(close - 1500)") == ("close", 1, 0, "close")
    assert told("group_rank(close, region)")[0] == "close,region" and told("volume / adv5")[:3] == ("volume", 0, 4)
    got = {r.text: (r.fields, r.depth, r.lookback, r.signature) for r in catalog.QUERIES["e_structure"](spark, sf).collect()}
    assert got == {x: told(x) for x in got}
    assert got["ts_mean(close,2)"] == ("close", 1, 1, "ts_mean(close)") and got["rank(ts_delta(volume,3))"] == ("volume", 2, 3, "ts_delta(volume)")
    texts = catalog.QUERIES["e_profiles"](spark, sf).select("text").distinct().count()
    assert len(got) == texts > 40 and sum(r.n for r in catalog.QUERIES["e_structure"](spark, sf).collect()) == spark.read.parquet(f"{sf}/part.parquet").count()


def test_pairwise_with_missing_values(spark):
    rng, rows = random.Random(2), []
    for d in range(4):
        for code in range(25):
            x = rng.gauss(0, 1)
            rows.append((date(2020, 1, 1 + d), code, x, None if rng.random() < 0.2 else x + rng.gauss(0, 1), 1e9 + rng.random() if d else 7.0, None))
    got = {(r.a, r.b): r for r in evaluate.pairwise(spark.createDataFrame(rows, "trade_date date, code int, p double, q double, r double, s double"), ["p", "q", "r", "s"]).collect()}
    for (a, i), (b, j) in [(("p", 2), ("q", 3)), (("q", 3), ("r", 4)), (("p", 2), ("r", 4))]:
        daily = []
        for d in range(4):
            both = [(r[i], r[j]) for r in rows if r[0].day == d + 1 and r[i] is not None and r[j] is not None]
            mx, my = (sum(v) / len(both) for v in zip(*both))
            sx, sy = (sum((v[k] - m) ** 2 for v in both) for k, m in ((0, mx), (1, my)))
            if min(sx, sy) > 0:
                daily.append(sum((u - mx) * (v - my) for u, v in both) / (sx * sy) ** 0.5)
        assert got[a, b].days == len(daily) and abs(got[a, b].mean - sum(daily) / len(daily)) < 1e-6
    assert got["p", "s"].days == 0 and got["p", "s"].mean is None
