"""Tests of factors in two passes: equal to the operators in long form, an array a value, no copies for trials, lags and seeds."""

import random
import re
from datetime import date, timedelta

import pytest
from conftest import rows as plain_rows
from conftest import sql_rows
from pyspark.sql import functions as F

import __spark_entry__
from sedgewren.catalog import validation as of_values
from sedgewren.catalog import views
from sedgewren.operators import backtest, dependency, labels, passes, sections, validation
from sedgewren.operators.panel import calendar

DAY = date(2021, 3, 1)
FACTORS, LEAST = ("a", "b"), 3


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(views, "ROWS", 1000)


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(7)
    value = lambda: rng.choice([None, float("nan"), *[float(rng.randrange(6)) for _ in range(9)]])
    rows = [(c, DAY + timedelta(days=d), value(), value(), rng.choice([None, *[rng.gauss(0, 1)] * 9]), rng.random() * 9 + 1, float(rng.randrange(3)), rng.choice([None, *[10 + rng.random()] * 9])) for c in range(25) for d in range(30) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "code long, trade_date date, a double, b double, label double, size double, board double, price double").cache()
    long = df.select("code", "trade_date", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in FACTORS])).alias("r")).select("code", "trade_date", "r.*")
    days = calendar(df).cache()
    return df.join(days, "trade_date"), long, df.select("code", "trade_date", "label"), days, [r.trade_date for r in days.orderBy("cal_idx").collect()]


def same(got, want):
    assert got.keys() == want.keys() and got
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v, abs=1e-9, nan_ok=True)), k


def dated(df, *keys, value="ic"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_trials_lags_and_placebo_equal_the_long_form(panel):
    wide, long, lab, days, dates = panel
    based = wide.where("label IS NOT NULL AND coalesce(a, b) IS NOT NULL")
    on = sorted(r.cal_idx for r in based.select("cal_idx").distinct().collect())
    moved = {f"lag{k}": ("label", [d + k if d + k < len(dates) else -1 for d in range(len(dates))]) for k in (1, 3)}
    moved |= {f"block{t}": ("label", come) for t, come in enumerate(passes.block_moves(on, len(dates), 4, 5, 4))}
    other = [f"other{t}" for t in range(4)]
    rows = wide.join(passes.swapped(based.select("code").distinct(), 4, 5), "code", "left")
    parts = passes.packed(rows, [*FACTORS, "label", *other], dates, 3, moved, [(f"5|universe|{t}", validation.KEPT) for t in range(4)])

    def tests(s, day):
        y = s.column("label")
        out = [("true", 0, f, None, ic) for f in FACTORS for ic in s.ic(s.column(f), y, LEAST)]
        out += [("lag", k, f, None, ic) for k in (1, 3) for f in FACTORS for ic in s.ic(s.column(f), s.column(f"lag{k}"), LEAST)]
        return out + passes.trials_of(s, day, FACTORS, "label", [f"block{t}" for t in range(4)], 0, 4, 5, LEAST) + passes.placebo_of(s, FACTORS, "label", other, LEAST), None

    found = passes.by_date(parts, tests).where("kind IS NOT NULL").cache()
    keys = "kind", "trial", "factor", "trade_date"
    trials = dated(validation.trial_correlations(long, lab, 4, 5, 4, LEAST), *keys)
    same(dated(found.where("kind NOT IN ('lag', 'placebo')"), *keys), trials)
    lags = validation.lagged_correlations(long, lab, (1, 3), LEAST)
    same(dated(found.where("kind = 'lag'"), "factor", "trial", "trade_date"), dated(lags, "factor", "lag", "trade_date"))
    own = found.where("kind IN ('true', 'placebo')").withColumn("trial", F.when(F.col("kind") == "true", -1).otherwise(F.col("trial")))
    same(dated(validation.placebo_scores(own), "factor", value="placebo"), dated(validation.placebo(long, lab, 4, 5, LEAST), "factor", value="placebo"))


def test_groups_equal_the_long_form(spark, panel):
    wide, long, lab, days, dates = panel
    parts = passes.packed(wide, [*FACTORS, "size", "board", "price"], dates, 4, draws=[("3|seed", 0.7), ("8|seed", 0.7)])
    found = passes.by_date(parts, lambda s, day: ([], passes.grouped(s, FACTORS, ["size", "board"], [None, s.drawn(0), s.drawn(1)], 3, 7)), "price")
    names = [{"factor": f, "seed": n} for f in FACTORS for n in (0, 3, 8)]
    got = passes.held_days(found, days, names, 3, 4, 0.01)
    seeds = F.array(F.lit(0), *[F.when(validation.uniform(validation.drawn(n, F.lit("seed"), "code")) < 0.7, n) for n in (3, 8)])
    exposed = long.join(wide.select("code", "trade_date", "size", "board"), ["code", "trade_date"]).withColumn("seed", F.explode(seeds)).where("seed IS NOT NULL AND value IS NOT NULL")
    neutral = backtest.residuals(exposed, "value", ["size", "board"], by=["factor", "seed"]).withColumn("residual", F.round("residual", 7))
    want = backtest.group_days(neutral, wide.select("code", "trade_date", "price"), "residual", "price", 3, 4, 0.01, ["factor", "seed"])
    for value in ("gross", "turnover", "net"):
        same(dated(got, "factor", "seed", "trade_date", "grp", value=value), dated(want, "factor", "seed", "trade_date", "grp", value=value))


def test_labels_of_single_rows_equal_those_of_ranges(panel):
    wide, _, _, days, _ = panel
    df = wide.select("code", "trade_date", "price")
    assert plain_rows(labels.forward_label(df, "price", 5, 1, days, single=True)) == plain_rows(labels.forward_label(df, "price", 5, 1))


def test_places_along_an_order_are_places(panel):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, 60).astype(float)
    x[rng.random(60) < 0.1] = np.nan
    c = passes.Column(pa.array(x, from_pandas=False))
    for m in (rng.random(60) < 0.5, np.ones(60, bool), np.zeros(60, bool)):
        assert np.array_equal(c.places(m), sections.places(x[m]))


def test_a_value_is_shuffled_once(spark, sf, small):  # F2 to F9, F12
    rows, days = of_values.wide(spark, sf)
    dates = [r.trade_date for r in days.orderBy("cal_idx").collect()]
    n = views.part_count(spark, views.line_count(spark, sf))
    parts = passes.packed(rows, ["f1", "label"], dates, n)
    plan = passes.by_date(parts, lambda s, day: ([], None))._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"Exchange hashpartitioning[^\n]*", plan)
    assert len(found) == 2 and "cal_idx" in found[0] and "REPARTITION_BY_NUM" in found[1], found


@pytest.mark.parametrize("name", ["g_confirmation", "g_rolling_seed", "g_forward_label", "g_research_score"])
def test_campaigns_have_no_long_copies(spark, duck, sf, small, monkeypatch, name):  # F2, F3, F4, F9, F12
    for long in ("residuals", "group_days"):
        monkeypatch.setattr(backtest, long, None)
    monkeypatch.setattr(sections, "variant_correlations", None)
    names, want = sql_rows(duck, __spark_entry__.oracle_sql()[name])
    df = __spark_entry__.queries()[name](spark, sf)
    assert sorted(df.columns) == names and plain_rows(df) == want


@pytest.mark.parametrize("name", ["g_quick_score", "g_anti_overfit", "g_deep_score", "g_admission"])
def test_evidence_has_no_long_copies(spark, duck, sf, small, monkeypatch, name):  # F5 to F8
    for long in ("trial_correlations", "lagged_correlations", "variant_correlations", "paired"):
        monkeypatch.setattr(validation, long, None)
    monkeypatch.setattr(backtest, "group_days", None)
    names, want = sql_rows(duck, __spark_entry__.oracle_sql()[name])
    df = __spark_entry__.queries()[name](spark, sf)
    assert sorted(df.columns) == names and plain_rows(df) == want


def test_pairs_of_columns_equal_the_long_form(spark, panel):
    wide, long, lab, _, dates = panel
    third = wide.withColumn("c", F.col("a") - 2 * F.col("size"))
    more = long.unionByName(third.select("code", "trade_date", F.lit("c").alias("factor"), F.col("c").alias("value")))
    got = dependency.section_days(passes.packed(third, ["a", "b", "c", "label"], dates, 3), ["c", "a", "b"], LEAST, 2, "label", ["c", "b"])
    keys = "a", "b", "trade_date"
    for value in ("common", "pearson", "rank"):
        same(dated(got.where("b IS NOT NULL"), *keys, value=value), dated(dependency.pair_days(more, LEAST, 2), *keys, value=value))
    same(dated(got.where("b IS NULL"), "a", "trade_date", value="rank"), dated(validation.daily_correlations(more.where("factor != 'a'"), lab, LEAST), "factor", "trade_date"))


@pytest.mark.parametrize("name", ["g_accepted", "a_dependency"])
def test_a_library_has_no_long_copies(spark, duck, sf, small, monkeypatch, name):  # F11
    monkeypatch.setattr(dependency, "pair_days", None)
    monkeypatch.setattr(validation, "variant_correlations", None)
    names, want = sql_rows(duck, __spark_entry__.oracle_sql()[name])
    df = __spark_entry__.queries()[name](spark, sf)
    assert sorted(df.columns) == names and plain_rows(df) == want
