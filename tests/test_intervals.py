"""As-of joins by ranges, spans against spans, sweeps and receipts against plain loops."""

import random
from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sedgewren.operators import panel
from sedgewren.sources import receipts

DAY = date(2020, 1, 1)


def day(n):
    return None if n is None else DAY + timedelta(days=n)


@pytest.mark.parametrize("key_rows", [10**6, 50])
def test_asof_of_a_hot_key(spark, key_rows):
    rng = random.Random(1)
    key = lambda: rng.choice([0] * 9 + [1, 2, None])
    right = [(key(), day(rng.choice([None, *range(400)])), rng.randint(0, 99)) for _ in range(700)]
    left = [(i, key(), day(rng.choice([None, *range(-5, 420)]))) for i in range(1500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = panel.asof_join(spark.createDataFrame(left, "i long, k long, t date"), spark.createDataFrame(right, "k long, known date, v long"), "k", "t", "known", ["v"], key_rows)
        got = {r.i: (r.known, r.v) for r in out.collect()}
        largest = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, k, t in left:
        fit = [(d, v) for kk, d, v in right if k is not None and t is not None and kk == k and d is not None and d <= t]
        assert got[i] == (max(fit) if fit else (None, None))
    assert len(got) == len(left)
    if key_rows == 50:  # the hot key's rows lie in several tasks
        assert largest < 0.6 * len(left)


def spans(rng, n, names):
    made = []
    for i in range(n):
        a = rng.choice([None, *range(300)])
        made.append((i, rng.choice("xyz"), day(a), rng.choice([None, day((a or 0) + rng.choice([-3, 0, 1, 20, 200]))])))
    return made, f"{names[0]} long, g string, {names[1]} date, {names[2]} date"


@pytest.mark.parametrize("by", [[], ["g"]])
def test_overlaps(spark, by):
    rng = random.Random(2)
    (a, sa), (b, sb) = spans(rng, 60, ("i", "s", "e")), spans(rng, 50, ("j", "f", "u"))
    left, right = spark.createDataFrame(a, sa), spark.createDataFrame(b, sb if by else sb.replace("g string", "h string"))
    out = panel.overlaps(left, right, ("s", "e"), ("f", "u"), cell=30, by=by)
    got = sorted((r.i, r.j) for r in out.collect())
    far = day(10**4)
    fine = lambda x: x[2] is not None and (x[3] is None or x[3] >= x[2])
    want = sorted((x[0], y[0]) for x in a for y in b if fine(x) and fine(y) and x[2] <= (y[3] or far) and y[2] <= (x[3] or far) and (not by or x[1] == y[1]))
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_concurrency(spark):
    rng = random.Random(3)
    made, schema = spans(rng, 200, ("i", "s", "e"))
    days = [day(k) for k in range(0, 330, 3)]
    out = panel.concurrency(spark.createDataFrame(made, schema), "s", "e", spark.createDataFrame([(d,) for d in days], "trade_date date"))
    fine = [(s, e) for _, _, s, e in made if s is not None and (e is None or e >= s)]
    assert {r.trade_date: r.alive for r in out.collect()} == {d: sum(s <= d and (e is None or e >= d) for s, e in fine) for d in days}


def files(path):
    return {x: x.stat().st_mtime_ns for x in path.glob("p=*/*.parquet")}


def test_receipts_skip_what_did_not_change(spark, tmp_path):
    data = [(p, k, f"{p}{k}") for p in "abc" for k in range(30)]
    frame = lambda d: spark.createDataFrame(d, "p string, k long, v string")
    path = f"{tmp_path}/t"
    run = lambda d, build=lambda x: x: {r.part: r.action for r in receipts.consolidate(frame(d), path, "p", "k", build).collect()}
    assert run(data) == dict.fromkeys("abc", "built")
    first = files(tmp_path / "t")
    assert run(list(reversed(data))) == dict.fromkeys("abc", "kept") and files(tmp_path / "t") == first
    data[40] = ("b", 10, None)
    assert run(data) == {"a": "kept", "b": "rebuilt", "c": "kept"}
    second = files(tmp_path / "t")
    assert {x.parent.name for x in set(first) ^ set(second)} == {"p=b"} and all(second[x] == t for x, t in first.items() if x.parent.name != "p=b")
    data[40] = ("b", 10, "?")  # a null and a mark are different rows
    assert run(data)["b"] == "rebuilt"
    for x in (tmp_path / "t").glob("p=c/*.parquet"):  # someone changed what was written
        frame([("c", 99, "no")]).drop("p").write.mode("append").parquet(str(x.parent))
        break
    assert run(data) == {"a": "kept", "b": "kept", "c": "rebuilt"}
    assert run([r for r in data if r[0] != "a"]) == {"a": "removed", "b": "kept", "c": "kept"}
    assert run([r for r in data if r[0] != "a"]) == {"b": "kept", "c": "kept"}
    assert run([*data, ("d", 1, "new")]) == {"a": "built", "b": "kept", "c": "kept", "d": "built"}
    assert rows(spark.read.parquet(path).select("p", "k", "v")) == rows(frame([*data, ("d", 1, "new")]))


def test_a_run_that_died_is_built_again(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "p string, k long, v string")
    path = f"{tmp_path}/t"
    receipts.consolidate(df, path, "p", "k")
    real = receipts.prints
    changed = df.withColumn("v", F.lit("z"))
    try:
        receipts.prints = lambda d, by, key, side: (_ for _ in ()).throw(RuntimeError("died")) if side == "out" and d.where("v = 'z'").count() else real(d, by, key, side)
        with pytest.raises(RuntimeError):
            receipts.consolidate(changed, path, "p", "k")
    finally:
        receipts.prints = real
    assert {r.action for r in receipts.consolidate(changed, path, "p", "k").collect()} == {"rebuilt"}
    assert {r.action for r in receipts.consolidate(changed, path, "p", "k").collect()} == {"kept"}
