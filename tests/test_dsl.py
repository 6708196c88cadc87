import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sedgewren.plans import dsl


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(1)
    data = [(c, dt.date(2024, 1, 1) + dt.timedelta(days=d), float(10 + c + d + rng.random()), float(rng.randrange(1, 50))) for c in range(6) for d in range(30) if rng.random() > 0.1]
    return spark.createDataFrame(data, "code int, trade_date date, close double, volume double")


def test_two_day_mean(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 10.0), (1, dt.date(2024, 1, 2), 10.1)], "code int, trade_date date, close double")
    got = [r.v for r in dsl.evaluate(df, {"v": "ts_mean(close, 2)"}).orderBy("trade_date").collect()]
    assert got[0] is None and got[1] == pytest.approx(10.05)


@pytest.mark.parametrize("text", ["rank(ts_mean(close, 5))", "zscore(ts_delta(close, 2)) + ts_corr(close, volume, 6)", "ema(close, 3)"])
def test_row_order_does_not_matter(bars, text):
    assert rows(dsl.evaluate(bars, {"v": text})) == rows(dsl.evaluate(bars.orderBy(F.rand(3)), {"v": text}))


def test_later_rows_change_nothing_earlier(bars):
    cut = dt.date(2024, 1, 20)
    text = "rank(ts_std(close, 4)) * ts_rank(volume, 3)"
    whole = dsl.evaluate(bars, {"v": text}).where(F.col("trade_date") <= cut)
    assert rows(whole) == rows(dsl.evaluate(bars.where(F.col("trade_date") <= cut), {"v": text}))


def test_lookback_is_enough(bars):
    text = "ts_mean(ts_delta(close, 2), 3)"
    assert dsl.lookback(text) == 4
    last = dt.date(2024, 1, 30)
    tail = bars.withColumn("n", F.row_number().over(dsl.f.Window.partitionBy("code").orderBy(F.col("trade_date").desc()))).where(F.col("n") <= dsl.lookback(text) + 1).drop("n")
    pick = lambda d: rows(dsl.evaluate(d, {"v": text}).groupBy("code").agg(F.round(F.max_by("v", "trade_date"), 9).alias("v")))
    assert pick(tail) == pick(bars)
    assert last


def test_shared_windows_are_planned_once(bars):
    plan = dsl.Plan()
    plan.column(dsl.parse("ts_mean(close, 5) + rank(ts_mean(close, 5))"))
    assert len(plan.named) == 2


@pytest.mark.parametrize("text", ["rank(close", "no_such(close)", "rank(close, 1, 2)", "ts_mean(close, volume)", "ts_mean(close, 0)", "close.real", "[close]", "lambda: 1", "'a'", "close < 1 < 2"])
def test_errors(text):
    with pytest.raises(dsl.ExpressionError):
        dsl.parse(text)


def test_signature_and_fields():
    assert dsl.signature("rank(close + volume)") == dsl.signature("volume + 2 * close") == "(close+volume)"
    assert dsl.signature("ts_mean(close, 5)") == dsl.signature("sma(close, 20)")
    assert dsl.fields("adv20 + returns + vwap / cap") == {"volume", "close", "amount", "total_mv"}
    assert dsl.functions("rank(delta(close, 2))") == ["rank", "ts_delta"] and dsl.depth("rank(delta(close, 2))") == 2


def test_division_and_logarithm_guards(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 0.0, -1.0), (2, dt.date(2024, 1, 1), 2.0, 4.0)], "code int, trade_date date, close double, volume double")
    got = {r.code: (r.a, r.b, r.c) for r in dsl.evaluate(df, {"a": "volume / close", "b": "log(volume)", "c": "sqrt(volume)"}).collect()}
    assert got[1] == (None, None, None) and got[2] == (2.0, pytest.approx(1.3862943611), 2.0)
