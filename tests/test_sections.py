"""Correlations by date's cross-sections against pandas, and plans that copy no values for trials and lags."""

import random
from datetime import date, timedelta

import pandas as pd
import pytest

from sedgewren.operators import validation
from sedgewren.operators.sections import variant_correlations

DAY = date(2021, 3, 1)


def panel(spark, seed):
    rng = random.Random(seed)
    days = [DAY + timedelta(days=d) for d in range(6)]
    v = [(c, d, f, None if rng.random() < 0.1 else float(rng.randrange(8))) for c in range(12) for d in days for f in ("a", "b") if rng.random() < 0.9]
    y = [(c, d, None if rng.random() < 0.1 else rng.gauss(0, 1)) for c in range(2, 14) for d in days]
    return v, y, spark.createDataFrame(v, "code long, trade_date date, factor string, value double"), spark.createDataFrame(y, "code long, trade_date date, label double")


def test_variants_equal_pandas(spark):
    v, y, values, labels = panel(spark, 1)
    said = labels.selectExpr("code", "trade_date", "1 AS variant", "label AS y").unionByName(labels.where("code % 2 = 0").selectExpr("code", "trade_date", "2 AS variant", "-label AS y"))
    got = {(r.factor, r.variant, r.trade_date): r.ic for r in variant_correlations(values, said, 5).collect()}
    frame = pd.DataFrame(v, columns=["code", "day", "factor", "x"]).merge(pd.DataFrame(y, columns=["code", "day", "y"]), on=["code", "day"]).dropna()
    want = {}
    for k, part in ((1, frame), (2, frame[frame.code % 2 == 0].assign(y=lambda t: -t.y))):
        for (f, d), t in part.groupby(["factor", "day"]):
            want[f, k, d] = t.x.rank().corr(t.y.rank()) if len(t) >= 5 and t.x.nunique() > 1 else None
    assert set(got) == set(want) and all(got[k] == (None if w is None else pytest.approx(w, abs=1e-12)) for k, w in want.items())


@pytest.mark.parametrize("of", [lambda v, lab: validation.lagged_correlations(v, lab, (0, 1, 2), 3), lambda v, lab: validation.trial_correlations(v, lab, 3, 1, 2, 3)])
def test_no_window_ranks_copies_of_values(spark, of):
    _, _, values, labels = panel(spark, 2)
    plan = of(values, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan
