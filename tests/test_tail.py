"""Values of new days from the state against recomputing all days, for every case of the factor language."""

import math

from pyspark.sql import functions as F

from sedgewren.catalog import factors, views
from sedgewren.operators.graph import shared_checkpoint
from sedgewren.plans import dsl, tail

CUTS = ("1999-03-01", "1999-03-02", "2000-06-30")
MORE = {
    "m1": "ts_mean(rank(close), 5)", "m2": "rank(ema(close, 5))", "m3": "ema(ts_delta(volume, 2), 4)", "m4": "ema(rank(volume), 1)", "m5": "ts_sum(obv(close, volume), 3)",
    "m6": "macd(close)", "m7": "ts_corr(ema(close, 3), adv10, 6)", "m8": "zscore(macd(volume, 3, 6)) + obv(close, rank(volume))", "m9": "ema(where(close > 1500, close, log(0 - 1)), 3)",
}


def same(a, b):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7)


def test_three_tails_equal_the_whole(spark, sf):
    texts = {n: e for n, (e, *_) in (factors.CASES | factors.STAGED).items()} | MORE
    assert len(texts) >= 62
    panel = shared_checkpoint(views.grouped_panel(spark, sf))
    day = F.col("trade_date")
    parts = [panel.where(day <= CUTS[0]), *(panel.where((day > a) & (day <= b)) for a, b in zip(CUTS, CUTS[1:])), panel.where(day > CUTS[-1])]
    groups = [dict(list(texts.items())[i::4]) for i in range(4)]
    for some in groups:
        values, state = tail.begin(parts[0], some)
        got, state = [values], shared_checkpoint(state)
        for part in parts[1:]:
            values, state = tail.extend(state, part, some)
            got.append(values)
            state = shared_checkpoint(state)
            assert state.groupBy("code").count().agg(F.max("count")).first()[0] <= max(map(dsl.reach, some.values()))
        rows = {(r.code, r.trade_date): r for df in got for r in df.collect()}
        want = dsl.evaluate(panel, some).collect()
        assert len(rows) == len(want)
        wrong = [(n, r.code, r.trade_date, rows[r.code, r.trade_date][n], r[n]) for r in want for n in some if not same(rows[r.code, r.trade_date][n], r[n])]
        assert not wrong, wrong[:5]


def test_new_and_absent_codes(spark, sf):
    panel = shared_checkpoint(views.panel(spark, sf))
    some = {"a": "ts_mean(close, 3)", "b": "ema(volume, 4)", "c": "obv(close, volume)"}
    first = panel.where("trade_date <= '1998-01-01' AND code % 2 = 0")
    later = panel.where("trade_date > '1998-01-01' AND code % 3 = 0")
    values, state = tail.begin(first, some)
    values, state = tail.extend(shared_checkpoint(state), later, some)
    got = {(r.code, r.trade_date): r for r in values.collect()}
    want = dsl.evaluate(first.unionByName(later), some).where("trade_date > '1998-01-01'").collect()
    assert len(got) == len(want) and all(same(got[r.code, r.trade_date][n], r[n]) for r in want for n in some)
    assert {r.code for r in state.select("code").distinct().collect()} == {r.code for r in first.unionByName(later).select("code").distinct().collect()}


def test_a_tail_reads_its_own_partitions(spark, sf, tmp_path):
    panel = views.panel(spark, sf).withColumn("year", F.year("trade_date"))
    panel.write.partitionBy("year").parquet(f"{tmp_path}/panel")
    some = {"a": "rank(ts_mean(close, 3))", "b": "ema(volume, 4)"}
    read = spark.read.parquet(f"{tmp_path}/panel")
    _, state = tail.begin(read.where("year < 2001").drop("year"), some)
    state.write.parquet(f"{tmp_path}/state")
    values, _ = tail.extend(spark.read.parquet(f"{tmp_path}/state"), read.where("year = 2001").drop("year"), some)
    broken = [x for x in (tmp_path / "panel").glob("year=*/*.parquet") if "year=2001" not in str(x)]
    for x in broken:  # nothing else may be read
        x.with_name(f".{x.name}.crc").unlink(missing_ok=True)
        x.write_bytes(b"")
    assert broken and values.count() == panel.where("year = 2001").count()
