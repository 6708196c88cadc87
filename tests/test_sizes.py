"""Steps whose cost must not grow faster than their input: intervals that overlap, spans, medians, blocks of factors, trees."""

import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from sedgewren.operators import boosting, dependency, evaluate, panel

DAY = date(2020, 1, 1)


def test_lookup_joins_parts_and_not_intervals(spark):
    rng = random.Random(5)
    spans = [(k, DAY + timedelta(rng.randint(0, 120)), None if rng.random() < 0.2 else DAY + timedelta(rng.randint(-5, 300)), f"n{i}", rng.random() < 0.02) for k in (1, 2) for i in range(3000)]
    points = [(k, DAY + timedelta(n)) for k in (1, 2, 3) for n in range(0, 310, 3)]
    out = panel.interval_lookup(spark.createDataFrame(points, "code int, day date"), spark.createDataFrame(spans, "code int, s date, e date, name string, odd boolean"), "code", "day", "s", "e", ["name"], ["odd"])
    got = {(r.code, r.day): (r.name, r.odd) for r in out.collect()}
    for k, d in points:
        holds = [(s, n, o) for c, s, e, n, o in spans if c == k and s <= d and (e is None or d <= e)]
        assert got[k, d] == ((max(holds)[1], any(o for _, _, o in holds)) if holds else (None, None))


def test_few_spans_go_to_every_task(spark):
    a = spark.range(1000).select("id", F.date_add(F.lit(DAY), F.col("id").cast("int") % 50).alias("s"), F.lit(None).cast("date").alias("e"))
    b = spark.createDataFrame([(DAY + timedelta(10 * n), DAY + timedelta(10 * n + 5)) for n in range(4)], "f date, u date")
    out = panel.overlaps(a, b, ("s", "e"), ("f", "u"), cell=7)
    got = {r.f: r["count"] for r in out.groupBy("f").count().collect()}
    assert got == {DAY + timedelta(10 * n): sum(i % 50 <= 10 * n + 5 for i in range(1000)) for n in range(4)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_medians_are_not_one_task(spark):
    rng = random.Random(6)
    for n in (0, 2, 801):
        data = [(i % 7, DAY + timedelta(i % 5), None if rng.random() < 0.1 and n > 2 else float(rng.randint(0, 40))) for i in range(n)]
        out = evaluate.robust_scale(spark.createDataFrame(data, "code int, trade_date date, x double"), "x", F.col("code") < 5)
        assert "median" not in out._jdf.queryExecution().toString() and "percentile" not in out._jdf.queryExecution().toString()
        got = sorted((r.code, r.trade_date, r.x, r.z) for r in out.where("x IS NOT NULL").collect())
        fit = np.array([x for c, _, x in data if c < 5 and x is not None])
        if not len(fit):
            assert not got
            continue
        med = np.median(fit)
        mad = np.median(np.abs(fit - med)) * 1.4826
        assert all(abs(z - np.clip((x - med) / mad, -3, 3)) < 1e-9 for _, _, x, z in got)


def test_a_block_is_sent_as_one_row_a_date(spark):
    data = [(c, DAY + timedelta(d), f"f{f}", float((c * (f + 3) + d) % 11)) for c in range(12) for d in range(3) for f in range(5) if (c + f) % 6]
    out = dependency.pair_days(spark.createDataFrame(data, "code long, trade_date date, factor string, value double"), 3, 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "cells" in plan
    of = {(f, c, d): v for c, d, f, v in data}
    rank = lambda v: np.array([np.sum(v < x) + (np.sum(v == x) + 1) / 2 for x in v])
    got = {(r.a, r.b, r.trade_date): r for r in out.collect()}
    assert len(got) == 30
    for (a, b, d), r in got.items():
        own = {f: [c for c in range(12) if (f, c, d) in of] for f in (a, b)}
        ranks = {f: dict(zip(own[f], rank(np.array([of[f, c, d] for c in own[f]])))) for f in (a, b)}
        both = [c for c in own[a] if c in own[b]]
        assert r.common == len(both)
        for name, value in (("pearson", lambda f, c: of[f, c, d]), ("rank", lambda f, c: ranks[f][c])):
            assert abs(r[name] - np.corrcoef([value(a, c) for c in both], [value(b, c) for c in both])[0, 1]) < 1e-9


def test_trees_are_not_written_one_by_one(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(boosting, "shared_checkpoint", lambda df: (kept.append(1), df.localCheckpoint())[1])
    df = spark.range(400).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"), ((F.col("id") % 17) * 2 + F.col("id") % 5).alias("y"))
    one = boosting.train(df, ["x", "z"], "y", trees=4, depth=2, bins=8, least=5)
    assert len(kept) == 1
    monkeypatch.setattr(boosting, "KEPT", 1)
    again = boosting.train(df, ["x", "z"], "y", trees=4, depth=2, bins=8, least=5)
    assert len(kept) == 5 and one.splits == again.splits and one.leaves == again.leaves
