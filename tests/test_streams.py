"""Keyed state and sinks of streams against plain loops: late and repeated events, restarts, silent keys, replays."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sedgewren.streaming import events, keyed

START = datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, counter long"


def plain(samples, late, enter=2, leave=3):
    """Each user's state at the end, from all samples."""
    by, newest = {}, max(t for _, t, _ in samples)
    for u, t, c in samples:
        by.setdefault(u, {})[t] = max(c, by.setdefault(u, {}).get(t, c))
    out = {}
    for u, of in by.items():
        times = sorted(of)
        last = times[-1]
        since = lambda span: of[last] - next((of[t] for t in reversed(times) if t <= last - span), 0)
        week = [of[t] for t in times if t > last - timedelta(days=7)]
        hot, ups, others = False, 0, 0
        for a, b in zip(week, week[1:]):
            ups, others = (ups + 1, 0) if b > a else (0, others + 1)
            hot = True if ups >= enter else False if others >= leave else hot
        idle = last + timedelta(days=7) <= newest - late
        out[u] = (of[last], 0 if idle else since(timedelta(days=1)), 0 if idle else since(timedelta(days=7)), hot and not idle, idle)
    return out


def samples(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append((rng.randrange(8), START + timedelta(minutes=i * 40 + rng.randrange(40)), rng.randrange(-20, 90) + i // 4))
    out += [(50, START + timedelta(hours=1), 5), (51, START + timedelta(hours=2), 5), (51, START + timedelta(hours=2), 9)]  # silent from then on
    return out


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 4)])
def test_growth_with_late_and_repeated_events_and_restarts(spark, tmp_path, seed, parts):
    rng, made = random.Random(seed), samples(seed, 700)
    made.sort(key=lambda r: r[1])
    size = -(-len(made) // parts)
    chunks = [made[i : i + size] for i in range(0, len(made), size)]
    for a, b in zip(chunks, chunks[1:]):  # some come a batch late, some twice
        for r in rng.sample(a[-40:], 15):
            a.remove(r)
            b.append(r)
        b += rng.sample(a[-60:], 10)
    for i, chunk in enumerate(chunks):
        rng.shuffle(chunk)
        spark.createDataFrame([*chunk, (None, chunk[0][1], 1), (1, None, 1), (1, chunk[0][1], None)], SCHEMA).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = keyed.counter_growth(events.read_stream(spark, f"{tmp_path}/in", files=100), F.col("counter"), "2 days")
        keyed.run_available(stream, keyed.batches(f"{tmp_path}/out"), f"{tmp_path}/state", "update")
    got = {r.user_id: (r.counter, r.day_delta, r.week_delta, r.hot, r.idle) for r in keyed.latest(spark, f"{tmp_path}/out", "user_id").collect()}
    assert got == plain(made, timedelta(days=2)) and got[50][-1] and got[51][0] == 9
    before = rows(spark.read.parquet(f"{tmp_path}/out"))
    keyed.run_available(keyed.counter_growth(events.read_stream(spark, f"{tmp_path}/in", files=100), F.col("counter"), "2 days"), keyed.batches(f"{tmp_path}/out"), f"{tmp_path}/state", "update")
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == before  # nothing new, nothing said


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    write = keyed.batches(f"{tmp_path}/t")
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, "z")], "k long, v string")
    write(a, 0)
    write(b, 1)
    before = rows(spark.read.parquet(f"{tmp_path}/t"))
    write(a, 0)
    write(b, 1)
    assert rows(spark.read.parquet(f"{tmp_path}/t")) == before
    assert {(r.k, r.v) for r in keyed.latest(spark, f"{tmp_path}/t", "k").collect()} == {(1, "x"), (2, "z")}


def test_streams_joined_within(spark, tmp_path):
    rng = random.Random(3)
    a = [(rng.randrange(30), START + timedelta(hours=rng.randrange(500)), i) for i in range(120)]
    b = [(rng.randrange(30), START + timedelta(hours=rng.randrange(600)), i) for i in range(150)]
    spark.createDataFrame(a, "k long, s timestamp, i long").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame(b, "l long, t timestamp, j long").write.parquet(f"{tmp_path}/b")
    for run in range(2):  # the second run is a replay from the start into the same sink
        pairs = keyed.joined_within(events.read_stream(spark, f"{tmp_path}/a", 9), events.read_stream(spark, f"{tmp_path}/b", 9), ("k", "l"), ("s", "t"), "3 DAYS")
        keyed.run_available(pairs, keyed.batches(f"{tmp_path}/out"), f"{tmp_path}/state{run}", "append")
        got = sorted((r.i, r.j) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        assert got == sorted((i, j) for k, s, i in a for m, t, j in b if k == m and s <= t <= s + timedelta(days=3))
