"""Keyed state with timers, an interval join of streams, and a sink in which a replayed batch changes nothing.

A counter's growth over the last day and week is kept per key: the samples of a week and the last one before it. Late and repeated samples
fall into their place, so the state depends on the samples that were seen and not on their order. An event-time timer clears a key that
has been silent for a week.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY, WEEK = 86_400_000_000, 7 * 86_400_000_000  # microseconds, in which times are kept
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: For a join that only matches: no batch of its own to forget rows (the next one with data does), and no read before each write to count keys.
PLAIN = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}
GROWTH = "user_id long, last long, counter long, day_delta long, week_delta long, hot boolean, idle boolean"
STATE = "base_at long, base long"
SAMPLES = "at array<long>, counter array<long>"


def growth(samples: list[tuple[int, int]], base: tuple[int, int] | None, enter: int, leave: int) -> tuple:
    """last, counter, day_delta, week_delta, hot of sorted samples and the one before them.

    A delta is the last counter less the last one at or before the cutoff, or less 0 without one. hot begins with `enter` rises of more
    than nothing in a row and ends with `leave` other steps."""
    last, counter = samples[-1]
    known = ([base] if base else []) + samples

    def since(span: int) -> int:
        earlier = [c for t, c in known if t <= last - span]
        return counter - (earlier[-1] if earlier else 0)

    hot, run, rising = False, 0, None
    for (_, a), (_, b) in zip(samples, samples[1:], strict=False):
        run = run + 1 if (b > a) == rising else 1
        rising = b > a
        if rising and run >= enter:
            hot = True
        elif not rising and run >= leave:
            hot = False
    return last, counter, since(DAY), since(WEEK), hot


class CounterGrowth(StatefulProcessor):
    """A row for a key whenever its samples change, and one when a silent week ends them. Of samples at one time the greatest counts.

    A key's samples are one value: a batch reads and writes them once, not one by one."""

    def __init__(self, enter: int = 2, leave: int = 3) -> None:
        self.enter, self.leave = enter, leave

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", STATE)
        self.samples = handle.getValueState("samples", SAMPLES)

    def _base(self) -> tuple[int, int] | None:
        found = self.base.get()
        return None if found is None else (found[0], found[1])

    def _samples(self) -> list[tuple[int, int]]:
        found = self.samples.get()
        return [] if found is None else sorted(zip(found[0], found[1], strict=True))

    def _row(self, user, samples: list, base, idle: bool) -> pd.DataFrame:
        last, counter, day, week, hot = growth(samples, base, self.enter, self.leave)
        values = (user, last, counter, 0 if idle else day, 0 if idle else week, hot and not idle, idle)
        return pd.DataFrame([values], columns=[f.split()[0] for f in GROWTH.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = dict(self._samples())
        base = self._base()
        for batch in rows:
            for at, counter in zip(batch["at"].tolist(), batch["counter"].tolist(), strict=True):
                if at in held:
                    held[at] = max(held[at], counter)
                elif base is None or at > base[0]:
                    held[at] = counter
                elif at == base[0]:
                    base = (at, max(base[1], counter))
        if not held:  # all of them older than what the state remembers
            if base is not None:
                self.base.update(base)
            return
        last = max(held)
        old = [(t, c) for t, c in held.items() if t <= last - WEEK]
        base = max([*old, *([base] if base else [])], default=None)
        kept = sorted((t, c) for t, c in held.items() if t > last - WEEK)
        self.samples.update(([t for t, _ in kept], [c for _, c in kept]))
        if base is not None:
            self.base.update(base)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(-(-(last + WEEK) // 1000))
        yield self._row(key[0], kept, base, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        samples = self._samples()
        if not samples:
            return
        row = self._row(key[0], samples, self._base(), True)
        self.base.update(samples[-1])
        self.samples.clear()
        yield row

    def close(self) -> None:
        pass


def counter_growth(events: DataFrame, counter: Column, late: str = "10 minutes") -> DataFrame:
    """A stream of GROWTH rows, a key's last one being its state. events: user_id, ts and the counter's columns; null ones are left out."""
    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), counter.cast("long").alias("counter")).dropna()
    kept = rows.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    return kept.groupBy("user_id").transformWithStateInPandas(CounterGrowth(), T._parse_datatype_string(GROWTH), outputMode="Update", timeMode="EventTime")


def joined_within(orders: DataFrame, shipments: DataFrame, key: tuple[str, str], time: tuple[str, str], within: str, late: str = "1 day") -> DataFrame:
    """Rows of two streams with equal keys whose second time lies within `within` after the first; both sides are forgotten once no match
    can come."""
    timed = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp")).withWatermark(c, late)
    a, b = timed(orders, time[0]), timed(shipments, time[1])
    near = (F.col(key[0]) == F.col(key[1])) & (F.col(time[1]) >= F.col(time[0])) & (F.col(time[1]) <= F.col(time[0]) + F.expr(f"INTERVAL {within}"))
    return a.join(b, near)


def batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function whose ledger is the table itself: a batch is the partition with its number, written as a whole or not at all.
    A batch that is replayed, whether it had been finished or not, writes the same partition again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Each key's row of its last batch."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("v")).select(key, "v.*")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str, settings: Mapping[str, str] | None = None) -> None:
    """Reads all that is there, in batches, and ends; goes on from the checkpoint if there is one. settings: more of the session's while it runs."""
    spark, settings = stream.sparkSession, {"spark.sql.streaming.stateStore.providerClass": PROVIDER, **(settings or {})}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
