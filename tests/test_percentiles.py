"""Percentiles of several columns by date in one pass."""

from datetime import date

import pandas as pd
import pytest

from sedgewren.operators import matrix, reports
from sedgewren.operators.sections import percentiles

ROWS = [(i, date(2021, 3, 1 + i % 2), None if i % 7 == 0 else float(i % 5), float("nan") if i % 11 == 0 else float(-i), i) for i in range(60)]
SCHEMA = "code long, trade_date date, a double, b double, c long"


def test_percentiles_equal_pandas(spark):
    got = {r.code: r for r in percentiles(spark.createDataFrame(ROWS, SCHEMA), {"pa": "a", "pb": "b", "pc": "c"}).collect()}
    frame = pd.DataFrame(ROWS, columns=["code", "day", "a", "b", "c"])
    frame["b"] = frame.b.fillna(1e9)  # not a number is the largest value
    for n in "abc":
        want = frame.groupby("day")[n].rank(pct=True)
        assert all((getattr(got[i], f"p{n}") is None) if pd.isna(w) else getattr(got[i], f"p{n}") == pytest.approx(w, abs=1e-12) for i, w in enumerate(want))


def test_many_ranks_are_one_sort(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    wide = df.selectExpr("code", "trade_date", "a AS total_mv", "b AS float_mv", "a AS roe", "b AS eps_growth", "c AS profit_growth")
    for out in (reports.rank_baseline(df, ["a", "b", "c"]), matrix.style_flags(wide)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.split("== Initial Plan ==")[-1].count("Sort [") == 1
