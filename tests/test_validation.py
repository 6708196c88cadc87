"""Global ranks, running sums, validation trials and the backtest against plain versions and planted signals."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sedgewren.operators import backtest, ranking, validation

DAY = date(2020, 1, 1)


def test_global_rank_is_the_mean_place_of_ties(spark):
    rng = random.Random(1)
    x = [None if rng.random() < 0.1 else 0.0 if rng.random() < 0.4 else rng.choice([-1.5, 2.0, float("nan"), rng.gauss(0, 1)]) for _ in range(3000)]
    df = spark.createDataFrame([(i, v, float(i % 7)) for i, v in enumerate(x)], "i long, v double, u double").repartition(5)
    got = {r.i: (r.rank_v, r.rank_u) for r in ranking.global_rank(df, ["v", "u"]).collect()}
    want = pd.Series([math.inf if v is not None and math.isnan(v) else v for v in x], dtype=float).rank()
    u = pd.Series([float(i % 7) for i in range(3000)]).rank()
    assert all((got[i][0] is None and x[i] is None) or got[i][0] == want[i] for i in range(3000))
    assert all(got[i][1] == u[i] for i in range(3000))


def windows(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition" in line]


def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(None if k == 3 else k, t, rng.randint(-5, 5) if rng.random() < 0.9 else None) for t in range(800) for k in [0, 0, 0, 0, rng.randrange(1, 6)]]
    rows = [(k, i, v) for i, (k, _, v) in enumerate(rows)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k long, t long, v long")
        out = ranking.running(df, ["k"], [F.col("t")], {"nth": F.lit(1).cast("long"), "total": F.col("v")})
        got = {r.t: (r.nth, r.total) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums = {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        n, s = sums.get(k, (0, 0))
        sums[k] = n + 1, s + (v or 0)
        assert got[t] == sums[k]
    assert len(got) == len(rows) and any("range_piece" in w for w in windows(plan))


def test_dense_names(spark):
    df = spark.range(500).selectExpr("id % 97 AS a", "cast(id % 5 AS string) AS b").distinct()
    got = ranking.dense_names(df, 10**6).collect()
    assert sorted(r.name for r in got) == list(range(485)) and len({(r.a, r.b) for r in got}) == 485


def planted(spark, codes=30, days=90, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.normal(size=(days, codes))
    factors = {"signal": label + rng.normal(size=label.shape), "against": -label + rng.normal(size=label.shape), "noise": rng.normal(size=label.shape), "flat": np.ones_like(label)}
    v = [(c, DAY + timedelta(days=d), f, float(x[d, c])) for f, x in factors.items() for d in range(days) for c in range(codes)]
    lab = [(c, DAY + timedelta(days=d), float(label[d, c])) for d in range(days) for c in range(codes)]
    return spark.createDataFrame(v, "code long, trade_date date, factor string, value double"), spark.createDataFrame(lab, "code long, trade_date date, label double")


def test_trials_pass_a_signal_and_fail_noise(spark):
    v, lab = planted(spark)
    got = {r.factor: r for r in validation.adversarial_trials(v, lab, trials=8, block=10).collect()}
    assert got["signal"].adversarial_passed and got["against"].adversarial_passed and got["signal"].ic > 0.5 > 0 > got["against"].ic
    assert not got["noise"].adversarial_passed and got["noise"].permutation < 60
    assert not got["flat"].adversarial_passed and got["flat"].ic is None
    again = {r.factor: r for r in validation.adversarial_trials(v.repartition(7), lab.repartition(3), trials=8, block=10).collect()}
    close = lambda a, b: (a is None and b is None) or abs(a - b) < 1e-9
    assert all(close(getattr(got[f], c), getattr(again[f], c)) for f in got for c in ("ic", "adversarial_score"))


def test_stability_and_stress(spark):
    v, lab = planted(spark, days=140)
    daily = validation.rank_correlations(validation.paired(v, lab), ["factor"], 10)
    got = {r.factor: r for r in validation.stability(daily, 20).collect()}
    assert got["signal"].stability == 100 and got["against"].stability == 100 and got["noise"].stability < 60
    left = {r.factor: r.stress for r in validation.stress(v, lab, least=8).collect()}
    assert left["signal"] > 80 and left["against"] > 80 and left["noise"] < 80 and left["flat"] == 0


def test_half_life_of_a_planted_decay(spark):
    rng = np.random.default_rng(4)
    rows = [(f, lag, DAY + timedelta(days=d), float(a * math.exp(-lag / life) + rng.normal() * 0.01)) for f, a, life in (("slow", 0.3, 8.0), ("fast", -0.2, 2.0)) for lag in (0, 1, 2, 3, 4) for d in range(200)]
    rows += [("rises", lag, DAY, 0.1 * (lag + 1)) for lag in range(4)] + [("turns", lag, DAY, (-1.0) ** lag) for lag in range(3)] + [("none", 0, DAY, None)]
    df = spark.createDataFrame(rows, "factor string, lag int, trade_date date, ic double")
    got = {r.factor: r for r in validation.decay(df, replicates=20, block=10).collect()}
    for f, life in (("slow", 8.0), ("fast", 2.0)):
        true = life * math.log(2)
        assert got[f].low <= got[f].half_life <= got[f].high and abs(got[f].half_life / true - 1) < 0.1 and got[f].low < true < got[f].high and got[f].fitted == 20
    assert got["rises"].half_life is None and got["turns"].half_life is None


def panel_of(seed, codes=23, days=40):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(codes):
        p = 10.0
        for d in range(days):
            p *= math.exp(rng.normal() * 0.02)
            if rng.random() < 0.9:
                rows.append((c, DAY + timedelta(days=d), p, None if rng.random() < 0.05 else float(rng.normal()), float(rng.normal()), float(c % 3)))
    return rows


SCHEMA = "code long, trade_date date, price double, score double, size double, board double"


def plain_days(rows, n_groups, hold, cost):
    """The backtest by loops over days."""
    days = sorted({r[1] for r in rows})
    price = {(r[0], r[1]): r[2] for r in rows}
    weights = []
    for j in range(len(days)):
        total, per = {}, {}
        for i in range(max(0, j - hold), j):
            ranked = sorted((r[3], r[0]) for r in rows if r[1] == days[i] and r[3] is not None)
            for g in range(1, n_groups + 1):
                own = [c for k, (_, c) in enumerate(ranked) if k * n_groups // len(ranked) + 1 == g]
                for c in own:
                    per[g, c] = per.get((g, c), 0) + 1 / len(own)
                    total[g] = total.get(g, 0) + 1 / len(own)
        weights.append({(g, c): x / total[g] for (g, c), x in per.items()})
    out = {}
    for j in range(1, len(days)):
        for g in {g for g, _ in weights[j]}:
            now, past = ({c: x for (h, c), x in weights[k].items() if h == g} for k in (j, j - 1))
            gross = sum(x * (price[c, days[j]] / price[c, days[j - 1]] - 1) for c, x in now.items() if (c, days[j]) in price and (c, days[j - 1]) in price)
            turnover = sum(abs(now.get(c, 0) - past.get(c, 0)) for c in {*now, *past}) / 2
            out[days[j], g] = gross, turnover, gross - cost * turnover
    return out


def test_backtest_equals_loops_and_knows_no_future(spark):
    rows = panel_of(5)
    df = spark.createDataFrame(rows, SCHEMA)
    daily = lambda d: {(r.trade_date, r.grp): (r.gross, r.turnover, r.net) for r in backtest.group_days(d, d, "score", "price", 4, 3, 0.01).collect()}
    got, want = daily(df), plain_days(rows, 4, 3, 0.01)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    cut = DAY + timedelta(days=25)
    early = daily(df.where(F.col("trade_date") <= F.lit(cut)))
    assert early == {k: pytest.approx(v, abs=1e-12) for k, v in got.items() if k[0] <= cut}


def test_side_is_chosen_in_training(spark):
    rows = panel_of(6, days=60)
    # In training the lowest scores win; later the highest do. The held group is the one of training.
    made = [(r[0], r[1], r[2] * math.exp((-1 if r[1] < DAY + timedelta(days=30) else 1) * 0.01 * r[0] * (r[1] - DAY).days), float(r[0]), r[4], r[5]) for r in rows]
    df = spark.createDataFrame(made, SCHEMA)
    daily = backtest.group_days(df, df, "score", "price", 3, 2, 0.001)
    got = {r.grp: r for r in backtest.group_statistics(daily, F.col("trade_date") < F.lit(DAY + timedelta(days=30))).collect()}
    assert [g for g in got if got[g].held] == [1] and got[1].train_mean > got[3].train_mean
    assert all(r.max_drawdown <= 0 and r.days > 20 for r in got.values())


def test_residuals_are_least_squares(spark):
    rows = panel_of(7)
    rows += [(90, DAY, 1.0, 2.0, None, 1.0), (91, DAY + timedelta(days=99), 1.0, 2.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"twice": F.col("size") * 2, "one": F.lit(4.0)})
    got = {(r.code, r.trade_date): r.residual for r in backtest.residuals(df, "score", ["size", "board", "twice", "one"]).collect()}
    assert len(got) == len(rows)
    for day in {r[1] for r in rows}:
        here = [r for r in rows if r[1] == day and r[3] is not None and r[4] is not None]
        x = np.array([[1, r[4], r[5]] for r in here])
        y = np.array([r[3] for r in here])
        want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose([got[r[0], r[1]] for r in here], want, atol=1e-9)
    assert got[90, DAY] is None and all(got[r[0], r[1]] is None for r in rows if r[3] is None)


def plain_pairs(v, least):
    """Daily correlations of every pair by pandas."""
    wide = v.pivot_table(index=["trade_date", "code"], columns="factor", values="value")
    out = {}
    for _, day in wide.groupby(level=0):
        for stat, frame in (("pearson", day), ("rank", day.rank())):
            c = frame.corr(min_periods=least)
            for i, a in enumerate(c.columns):
                for b in c.columns[i + 1 :]:
                    if (day[a].notna() & day[b].notna()).sum() >= least and not np.isnan(c.loc[a, b]):
                        out.setdefault((a, b), {}).setdefault(stat, []).append(abs(c.loc[a, b]))
    return out


def library(n, codes, days, seed):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=(days, codes, 5))
    rows = []
    for k in range(n):
        x = common[:, :, k % 5] * (0.2 + 0.16 * (k % 6)) + rng.normal(size=(days, codes)) * 0.5
        rows += [(c, DAY + timedelta(days=d), f"x{k:03}", float(x[d, c])) for d in range(days) for c in range(codes) if rng.random() < 0.95]
    return rows


def test_dependency_in_blocks_equals_the_pair_loop(spark):
    from sedgewren.operators import dependency

    rows = library(13, 25, 6, 1) + [(c, DAY, "flat", 1.0) for c in range(25)] + [(0, DAY, "x000", float("nan")), (1, DAY, "hole", None)]
    v = spark.createDataFrame([r for r in rows if not (r[:3] == (0, DAY, "x000") and r[3] == r[3])], "code long, trade_date date, factor string, value double")
    want = plain_pairs(pd.DataFrame([r for r in rows if r[3] is not None and r[3] == r[3] and r[:3] != (0, DAY, "x000")], columns=["code", "trade_date", "factor", "value"]), 10)
    for block in (4, 32):
        got = {(r.a, r.b): r for r in dependency.pairs(v, 10, 0, block).collect()}
        assert {p for p in got if "flat" not in p} == set(want)
        for p, stats in want.items():
            r = got[p]
            for s in ("pearson", "rank"):
                assert getattr(r, f"mean_{s}") == pytest.approx(np.mean(stats[s]), abs=1e-9) and getattr(r, f"p90_{s}") == pytest.approx(np.percentile(stats[s], 90), abs=1e-9)
            assert r.dependency == pytest.approx(max(np.mean(stats["rank"]), np.mean(stats["pearson"]), np.percentile(stats["rank"], 90), np.percentile(stats["pearson"], 90)), abs=1e-9)
    assert dependency.pairs(v, 10, 10**6).count() == 0


def test_two_hundred_factors_from_values_to_acceptance(spark):
    from sedgewren.operators import dependency

    rows = library(200, 30, 3, 2)
    v = spark.createDataFrame(rows, "code long, trade_date date, factor string, value double")
    scores = {f"x{k:03}": float((k * 37) % 200) for k in range(20, 200)}
    got = {r.node for r in dependency.accepted(v, spark.createDataFrame(list(scores.items()), "factor string, score double"), 10, 30).collect()}
    of = {(r.a, r.b): r for r in dependency.pairs(v, 10, 30).collect()}
    assert len(of) == 200 * 199 // 2
    clash = {p for p, r in of.items() if r.mean_pearson >= 0.75 or r.mean_rank >= 0.80 or r.p90_pearson >= 0.70 or r.p90_rank >= 0.75}
    near = {}
    for a, b in clash:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    taken = {f"x{k:03}" for k in range(20)}
    kept = set()
    for f in sorted(scores, key=lambda f: (-scores[f], f)):
        if not near.get(f, set()) & (taken | kept):
            kept.add(f)
    assert got == kept and 0 < len(kept) < len(scores)


def test_rolling_score(spark):
    last = DAY
    rows = [("good", last - timedelta(days=d), 0.05) for d in range(0, 1400, 3)] + [("short", last - timedelta(days=d), 0.05) for d in range(0, 300, 3)] + [("wrong", last - timedelta(days=d), -0.05) for d in range(0, 1400, 3)]
    rows += [("new", last - timedelta(days=d), 0.1 if d < 182 else 0.0) for d in range(0, 700, 3)]
    got = {r.factor: r.rolling for r in validation.rolling(spark.createDataFrame(rows, "factor string, trade_date date, ic double"), 50).collect()}
    mean = 0.4 * 0.1 / 0.8
    spread = math.sqrt(0.4 * 0.01 / 0.8 - mean**2)
    assert got["good"] == pytest.approx(62.5) and got["wrong"] == 0 and got["short"] is None and got["new"] == pytest.approx((mean - 0.25 * spread) / 0.08 * 100)


def test_placebo(spark):
    v, lab = planted(spark, days=60)
    got = {r.factor: r.placebo for r in validation.placebo(v, lab, trials=8).collect()}
    assert got["signal"] == 100 and got["against"] == 100 and got["noise"] < 60 and got["flat"] == 0
