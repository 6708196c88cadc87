import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sedgewren.operators import evaluate, graph, labels, panel, scoring
from sedgewren.sources import tables
from sedgewren.streaming import events

D = [dt.date(2024, 1, d) for d in range(1, 15)]


def test_asof_takes_same_day_and_never_later(spark):
    left = spark.createDataFrame([(1, D[0]), (1, D[2]), (1, D[5]), (2, D[5])], "code int, trade_date date")
    right = spark.createDataFrame([(1, D[2], 5.0), (1, D[4], 6.0), (3, D[0], 9.0)], "code int, ann date, eps double")
    got = {(r.code, r.trade_date): r.eps for r in panel.asof_join(left, right, "code", "trade_date", "ann", ["eps"]).collect()}
    assert got == {(1, D[0]): None, (1, D[2]): 5.0, (1, D[5]): 6.0, (2, D[5]): None}


def test_interval_lookup_prefers_latest_start(spark):
    points = spark.createDataFrame([(1, D[3]), (1, D[9]), (1, D[0])], "code int, trade_date date")
    spans = spark.createDataFrame([(1, D[1], D[4], "a"), (1, D[3], None, "b")], "code int, s date, e date, name string")
    got = {r.trade_date: r.name for r in panel.interval_lookup(points, spans, "code", "trade_date", "s", "e", ["name"]).collect()}
    assert got == {D[3]: "b", D[9]: "b", D[0]: None}


def test_label_uses_calendar_positions(spark):
    df = spark.createDataFrame([(1, D[0], 10.0), (1, D[2], 11.0), (1, D[3], 12.0), (1, D[4], 14.0), (2, D[1], 1.0)], "code int, trade_date date, close double")
    got = {(r.code, r.trade_date): r.label for r in labels.forward_label(df, "close", 2, 0).collect()}
    assert got[1, D[2]] == pytest.approx(14 / 11 - 1) and got[1, D[0]] == pytest.approx(0.1) and got[2, D[1]] is None
    assert got[1, D[3]] is None


def test_executable_label(spark):
    df = spark.createDataFrame([(0.1, 11.0, 11.0), (0.1, 10.0, 11.0), (0.1, None, 11.0)], "label double, entry double, up double")
    assert [r[0] for r in df.select(labels.executable(F.col("label"), F.col("entry"), F.col("up"))).collect()] == [0.0, 0.1, 0.1]


def test_hysteresis_enters_after_two_and_leaves_after_three(spark):
    hot = [0, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0, 1]
    df = spark.createDataFrame(list(zip(D, map(bool, hot))), "trade_date date, h boolean")
    got = [int(r.on) for r in scoring.hysteresis(df, F.col("h")).orderBy("trade_date").collect()]
    assert got == [0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 0, 0]


def test_dropout_plan(spark):
    scores = spark.createDataFrame([("a", 9.0), ("b", 8.0), ("c", 7.0), ("d", 1.0)], "code string, score double")
    held = spark.createDataFrame([("c",), ("d",), ("x",)], "code string")
    got = {r.code: r.action for r in scoring.dropout_plan(scores, held, 3, 1).collect()}
    assert got == {"x": "sell", "a": "buy", "c": "hold", "d": "hold"}


def test_grade_and_quick_score_cap(spark):
    good = dict(ic=-0.1, ir=1.0, rank_ic=0.1, rank_ir=0.9, annual=-0.01, sharpe=3.0, drawdown=-0.05, turnover=0.2)
    df = scoring.quick_score(spark.createDataFrame([good, good | {"annual": 0.5}]))
    assert [(round(r.score, 1), r.grade) for r in df.orderBy("score").collect()] == [(59.9, "C"), (100.0, "A")]


def test_tail_replace_aligns_columns(spark):
    base = spark.createDataFrame([(1, D[0], 1.0), (1, D[3], 2.0)], "code int, trade_date date, x double")
    delta = spark.createDataFrame([(1, D[3], 5.0, "n"), (1, D[1], 4.0, "n")], "code int, trade_date date, x double, y string")
    assert rows(panel.tail_replace(base, delta, "trade_date", F.lit(D[2]))) == rows(spark.createDataFrame([(1, D[0], 1.0, None), (1, D[3], 5.0, "n")], "code int, trade_date date, x double, y string"))


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(i, D[0], 1.0, float(i)) for i in range(12)], "code int, trade_date date, x double, y double")
    assert evaluate.daily_correlation(df, "x", "y").first().corr is None


def test_components_and_novelty(spark):
    nodes = spark.range(8).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(5, 1), (1, 3), (6, 7)], "a long, b long")
    assert {r.node: r.root for r in graph.connected_components(nodes, edges).collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 4, 5: 1, 6: 6, 7: 6}
    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.5)], "node string, score double")
    conflicts = spark.createDataFrame([("a", "b"), ("c", "a")], "a string, b string")
    assert sorted(r.node for r in graph.novel(scores, conflicts).collect()) == ["b", "c"]


def test_scan_conform_and_csv(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 1.5)], "code int, x double").write.parquet(str(tmp_path / "t"))
    assert rows(tables.scan(spark, str(tmp_path / "t"), ["code", "x", "gone"])) == [(1, None), (2, 1.5)]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("new", T.StringType())])
    assert rows(tables.conform(spark.createDataFrame([("7",), ("q",)], "x string"), schema)) == [(None, 7), (None, None)]
    faults = tables.validated_targets(spark.createDataFrame([("a", 0.6), ("a", 0.6), ("b", -0.1)], "code string, weight double"))
    assert {r.fault for r in faults.collect()} == {"repeated", "negative", "sum"}


def test_overwrite_partitions_keeps_other_months(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "m int, v string")
    tables.write_partitioned(df, path, ["m"])
    tables.overwrite_partitions(spark.createDataFrame([(2, "c")], "m int, v string"), path, ["m"])
    assert rows(spark.read.parquet(path).select("m", "v")) == [(1, "a"), (2, "c")]


def test_stream_equals_batch(spark, sf, tmp_path):
    raw = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    raw.write.parquet(folder)
    stream = events.tumbling(events.read_stream(spark, folder))
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("tumbled")) == rows(events.tumbling(raw))


def test_upsert_days_rewrites_late_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    write = events.upsert_days(out, ["user_id"], "ts")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    make = lambda data: spark.createDataFrame(data, "user_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    write(make([(1, "2024-01-01 10:00:00", 1.0), (1, "2024-01-02 10:00:00", 2.0)]), 0)
    write(make([(1, "2024-01-01 11:00:00", 5.0), (1, "2024-01-01 09:00:00", 4.0)]), 1)
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == [2.0, 5.0]


def test_ema_is_a_recursion_over_all_rows(spark):
    """A first value far above the rest, nulls, and more rows than a block."""
    from sedgewren.plans import dsl

    start = dt.date(2000, 1, 1)
    series = {0: [1e9] + [0.0] * 40, 1: [None, 2.0, None, 3.0, 5.0], 2: [float(i % 7) for i in range(2000)], 3: [None, None]}
    rows = [(c, start + dt.timedelta(i), v) for c, s in series.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "code int, trade_date date, x double")
    got = {(r.code, r.trade_date): r for r in dsl.evaluate(df, {"e": "ema(x, 2)", "one": "ema(x, 1)", "m": "macd(x, 3, 6)"}).collect()}
    for c, s in series.items():
        e2 = e3 = e6 = last = None
        for i, v in enumerate(s):
            if v is not None:
                step = lambda e, n: v if e is None else e + 2 / (n + 1) * (v - e)  # noqa: B023, E731
                e2, e3, e6, last = step(e2, 2), step(e3, 3), step(e6, 6), v
            r = got[c, start + dt.timedelta(i)]
            if e2 is None:
                assert r.e is None and r.one is None and r.m is None
            else:
                assert abs(r.e - e2) <= 1e-9 * abs(e2) and r.one == last and abs(r.m - (e3 - e6)) <= 1e-9 * max(abs(e3), abs(e6), 1e-3)
    assert abs(got[0, start + dt.timedelta(20)].e - 1e9 / 3**20) < 1e-9


def test_interval_lookup_keeps_repeated_points(spark):
    d = dt.date.fromisoformat
    points = spark.createDataFrame([(1, d("2020-01-05")), (1, d("2020-01-05")), (1, d("2019-01-01")), (None, d("2020-01-05")), (2, None)], "code int, trade_date date")
    spans = spark.createDataFrame([(1, d("2010-01-01"), None, "old"), (1, d("2020-01-01"), d("2020-02-01"), "new"), (1, d("2020-01-01"), d("2019-01-01"), "none")], "code int, s date, e date, name string")
    got = panel.interval_lookup(points, spans, "code", "trade_date", "s", "e", ["name"]).collect()
    assert sorted(str(r.name) for r in got) == ["None", "None", "new", "new", "old"]
