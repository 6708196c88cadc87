"""Parts of the panel: as many as its lines need, one exchange by code for all windows along codes, few changes of partitioning."""

import re

import pytest
from conftest import rows, sql_rows
from pyspark.sql import functions as F

import __spark_entry__
from sedgewren.catalog import chains, factors, views
from sedgewren.operators import evaluate
from sedgewren.plans import dsl, tail
from sedgewren.operators.sections import percentiles


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(views, "ROWS", 1000)


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange (?!SinglePartition)\w+\([^\n]*", df._jdf.queryExecution().executedPlan().toString())


def test_windows_along_codes_share_one_exchange(spark, sf, small):
    for name in ("d44_macd", "d23_ts_mean", "d45_obv"):  # F26
        found = exchanges(factors.QUERIES[name](spark, sf))
        assert len(found) == 1 and "REPARTITION_BY_NUM" in found[0], found


def test_parts_follow_the_lines(spark, sf, small):
    n = views.line_count(spark, sf)
    assert views.panel(spark, sf).rdd.getNumPartitions() == max(-(-n // 1000), spark.sparkContext.defaultParallelism)
    assert not [x for x in exchanges(views.spread(spark.range(10), 10, "id"))]


def test_code_windows_come_before_date_windows(spark, sf, small):  # F20
    texts = {n: (factors.STAGED[n] if n in factors.STAGED else factors.CASES[n])[0] for n in chains.TAILED}
    assert len(exchanges(dsl.evaluate(views.panel(spark, sf), texts))) == 2
    values, state = tail.begin(views.panel(spark, sf), texts)
    assert len(exchanges(values)) == 2 and len(exchanges(state)) == 1
    plan = dsl.Plan()
    for t in ("rank(ts_mean(close, 3))", "ts_mean(rank(volume), 2)", "ema(close, 4)", "obv(close, volume)", "ts_std(close, 3)"):
        plan.column(dsl.parse(t))
    names = {k: n for k, (n, _) in plan.named.items()}
    assert set(plan.kept) == {names[k] for k in ("ts_mean(close, 3)", "rank(volume)", "ema(close, 4)", "obv(close, volume)")}


@pytest.mark.parametrize("name", ["k_factor_tail", "x_feature_matrix", "k_tail_repaired", "r_top_neighbours", "d44_macd", "d53_nested", "g_redundant", "a_style_exposure", "p_style_flags", "many_factors"])
def test_many_parts_equal_the_sql(spark, duck, sf, small, name):
    df = __spark_entry__.queries()[name](spark, sf)
    names, want = sql_rows(duck, __spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == names and rows(df) == want


def test_named_queries_have_bounded_parts(spark, sf, small):
    q = __spark_entry__.queries()
    for name in ("r_top_neighbours", "g_redundant", "x_feature_matrix"):  # F23, F13, F21
        assert any("REPARTITION_BY_NUM" in x for x in exchanges(q[name](spark, sf))), name
    assert "LeftSemi" in q["a_style_exposure"](spark, sf)._jdf.queryExecution().executedPlan().toString()  # F14


def test_ranked_pairs_equal_pairs_of_percentiles(spark):
    df = spark.range(300).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int") % 6).alias("trade_date"), *[F.when(F.col("id") % (k + 5) > 0, (F.col("id") * (k + 2) % 23).cast("double")).alias(f"x{k}") for k in range(3)])
    df = df.withColumn("x2", F.when(F.col("x2") == 7, F.lit(float("nan"))).otherwise(F.col("x2")))
    names = ["x0", "x1", "x2"]
    want = evaluate.pairwise(percentiles(df, {f"p{c}": c for c in names}).select("trade_date", *[F.col(f"p{c}").alias(c) for c in names]), names)
    assert rows(evaluate.pairwise(df, names, ranked=True)) == rows(want)


def test_a_backtest_has_parts_by_lines_and_buckets(spark, duck, sf, small, monkeypatch):  # F3 to F6
    from sedgewren.catalog import validation
    from sedgewren.operators import backtest

    monkeypatch.setattr(backtest, "CELLS", 500)
    plan = validation.backtested(spark, sf, 42, 17)._jdf.queryExecution().optimizedPlan().toString()
    n = len(validation.SHOWN) * views.line_count(spark, sf)
    assert re.search(rf"RepartitionByExpression \[factor[^\n]*, {-(-n // 1000)}\b", plan) and re.search(r"RepartitionByExpression \[bucket#", plan)
    names, want = sql_rows(duck, __spark_entry__.oracle_sql()["g_campaign"])
    df = __spark_entry__.queries()["g_campaign"](spark, sf)
    assert sorted(df.columns) == names and rows(df) == want
