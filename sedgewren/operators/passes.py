"""All tests of a wide panel's factors in two passes: a part of the codes with all dates, then a date with all codes.

In the first pass a part's rows become one row a date, an array a column; what comes from a code's other dates (later labels, labels of another
block) and what is drawn by code is added there. The second pass takes a date's arrays of all parts: values are sorted once a date, and every
test ranks a subset along that order. So a value is shuffled once, in its array, whatever the number of tests, trials, lags and seeds. The groups of
a backtest go back to the parts by code as bytes beside the prices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import date
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .backtest import FLAT, earned, moves
from .panel import CODE, DATE
from .sections import correlation, places
from .validation import AMPLITUDE, KEPT, digests, drawn, share

FOUND = f"kind string, trial int, factor string, seed int, {DATE} date, ic double"


def packed(rows: DataFrame, columns: Sequence[str], days: Sequence[date], parts: int, moved: Mapping[str, tuple[str, Sequence[int]]] | None = None, draws: Sequence[tuple[str, float]] = ()) -> DataFrame:
    """part, cal_idx, trade_date, code, columns, moved, flags: a row a day of the calendar and part, with arrays of its codes' cells; days without a
    code have empty arrays. rows: code, cal_idx, columns, a row a code and day.

    moved: a new column by the column that it comes from and for each day the position of that day it comes from (-1: none). flags: bit i is
    set where the draw of the i-th text and the code is below its limit."""
    moved, kind = dict(moved or {}), rows.schema[CODE].dataType.simpleString()
    of = {c: rows.schema[c].dataType.simpleString() for c in columns} | {n: rows.schema[c].dataType.simpleString() for n, (c, _) in moved.items()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        t = pa.Table.from_batches(found).combine_chunks()
        codes = t.column(CODE).combine_chunks().dictionary_encode()
        at, day = codes.indices.to_numpy(zero_copy_only=False), t.column("cal_idx").to_numpy()
        order = np.argsort(day, kind="stable")
        offsets = pa.array(np.searchsorted(day[order], np.arange(len(days) + 1)), pa.int32())
        lists = lambda x: pa.ListArray.from_arrays(offsets, x.take(pa.array(order)))
        one = lambda c: t.column(c).combine_chunks()
        out = {"part": pa.array(np.full(len(days), at_part()), pa.int32()), "cal_idx": pa.array(np.arange(len(days)), pa.int32()), DATE: pa.array(days, pa.date32()), CODE: lists(one(CODE))}
        out |= {c: lists(one(c)) for c in columns}
        row = np.full((len(codes.dictionary), len(days)), -1)
        row[at, day] = np.arange(len(day))
        for name, (c, come) in moved.items():
            come = np.asarray(come)[day]
            source = np.where(come >= 0, row[at, np.maximum(come, 0)], -1)
            out[name] = lists(one(c).take(pa.array(source, mask=source < 0)))
        flags, names = np.zeros(len(codes.dictionary), np.int64), codes.dictionary.cast(pa.string()).to_pylist()
        for i, (text, limit) in enumerate(draws):
            flags |= (share(digests(names, f"{text}|", "")) < limit).astype(np.int64) << i
        out["flags"] = lists(pa.array(flags[at]))
        yield from pa.table(out).to_batches()

    cells = "".join(f", `{c}` array<{k}>" for c, k in of.items())
    known = rows.where(F.col(CODE).isNotNull()).select(CODE, F.col("cal_idx").cast("int").alias("cal_idx"), *columns)
    return known.repartition(parts, CODE).mapInArrow(pack, f"part int, cal_idx int, {DATE} date, {CODE} array<{kind}>{cells}, flags array<bigint>")


def at_part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def block_moves(based: Sequence[int], n_days: int, trials: int, seed: int, block: int) -> list[list[int]]:
    """For each trial and day the position of the day whose labels are tried on it, -1 for none: blocks of the days `based` change places."""
    out = []
    for t in range(trials):
        blocks = range(-(-len(based) // block))
        to = {b: i for i, b in enumerate(sorted(blocks, key=lambda b: md5(f"{seed}|block|{t}|{b}".encode()).hexdigest()))}
        come = [-1] * n_days
        for spot, d in enumerate(based):
            source = to[spot // block] * block + spot % block
            come[d] = based[source] if source < len(based) else -1
        out.append(come)
    return out


def swapped(codes: DataFrame, trials: int, seed: int) -> DataFrame:
    """code, other0, other1 ...: whose labels a code gets in each trial of a placebo. codes: code."""
    numbered = codes.select(CODE).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    placed = lambda salt: F.row_number().over(Window.partitionBy("trial").orderBy(drawn(seed, F.lit(salt), "trial", CODE)))
    other = numbered.select("trial", F.col(CODE).alias("other"), placed("other").alias("place"))
    both = numbered.select("trial", CODE, placed("own").alias("place")).join(other, ["trial", "place"])
    return both.groupBy(CODE).agg(*[F.max(F.when(F.col("trial") == t, F.col("other"))).alias(f"other{t}") for t in range(trials)])


class Column:
    """A column of a date in the order of its codes, sorted once."""

    def __init__(self, x: pa.Array) -> None:
        self.known, self.x = ~x.is_null().to_numpy(zero_copy_only=False), x.cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.order = np.argsort(self.x, kind="stable")

    def places(self, m: np.ndarray) -> np.ndarray:
        """`sections.places` of the rows m, in the order of the codes."""
        o = self.order[m[self.order]]
        s = self.x[o]
        first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))])) if len(s) else np.zeros(0, int)
        n = np.diff(np.append(first, len(s)))
        out = np.zeros(len(self.x))
        out[o] = np.repeat(first + (n + 1) / 2, n)
        return out[m]


class Section:
    """A date's rows of all parts, in the order of the codes."""

    def __init__(self, rows: pa.Table) -> None:
        self.rows, flat = rows, self._flat(rows, CODE)
        at = pc.sort_indices(flat)
        self.codes, self.at, self._columns = flat.take(at), at, {}
        self.flags = self._flat(rows, "flags").take(at).to_numpy(zero_copy_only=False)

    @staticmethod
    def _flat(rows: pa.Table, c: str) -> pa.Array:
        return pa.chunked_array([x.flatten() for x in rows.column(c).chunks], rows.schema.field(c).type.value_type).combine_chunks()

    def raw(self, c: str) -> pa.Array:
        return self._flat(self.rows, c).take(self.at)

    def column(self, c: str) -> Column:
        if c not in self._columns:
            self._columns[c] = Column(self.raw(c))
        return self._columns[c]

    def drawn(self, i: int) -> np.ndarray:
        return (self.flags >> i & 1).astype(bool)

    def ic(self, x: Column, y: Column, least: int, of: np.ndarray | None = None) -> list:
        """Rank correlation over the codes that have both: a list of one, or empty without any."""
        m = x.known & y.known if of is None else x.known & y.known & of
        return [correlation(x.places(m), y.places(m), least)] if m.any() else []


def residual(regressors: Sequence[np.ndarray], y: np.ndarray) -> np.ndarray:
    """`backtest.residuals` of one date's rows."""
    z = np.vstack([*regressors, y])
    k, mean = len(regressors), z.mean(axis=1, keepdims=True)
    centred = z - mean
    g, b = centred @ centred.T / z.shape[1], np.zeros(k)
    for p in range(k):
        if abs(g[p, p]) > FLAT:
            for i in range(p + 1, k):
                g[i, i:] -= g[p, i] / g[p, p] * g[p, i:]
    for p in reversed(range(k)):
        b[p] = (g[p, k] - g[p, p + 1 : k] @ b[p + 1 :]) / g[p, p] if abs(g[p, p]) > FLAT else 0.0
    return centred[k] - b @ centred[:k]


def grouped(s: Section, factors: Sequence[str], regressors: Sequence[str], masks: Sequence[np.ndarray | None], n_groups: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups from 1 of each factor and mask (0: in none) by codes, and the sizes of the groups: `backtest.cohorts` of the residuals."""
    x = [s.column(c) for c in regressors]
    fit = np.logical_and.reduce([c.known & ~np.isnan(c.x) for c in x])
    groups, sizes = [], []
    for f in factors:
        c = s.column(f)
        base = fit & c.known & ~np.isnan(c.x)
        for mask in masks:
            m = base if mask is None else base & mask
            grp, n = np.zeros(len(m), np.int8), int(m.sum())
            if n:
                z = residual([r.x[m] for r in x], c.x[m])
                z = np.sign(z) * np.floor(np.abs(z) * 10.0**digits + 0.5) / 10.0**digits
                place = np.empty(n, np.int64)
                place[np.argsort(z, kind="stable")] = np.arange(n)  # equal ones by code
                grp[m] = place * n_groups // n + 1
            groups.append(grp)
            sizes.append(np.bincount(grp, minlength=n_groups + 1)[1:])
    return np.array(groups), np.array(sizes)


def by_date(parts: DataFrame, tests: Callable[[Section, date], tuple[list, tuple[np.ndarray, np.ndarray] | None]], price: str | None = None) -> DataFrame:
    """What `tests` finds of each date: FOUND rows, and with groups a row a part with code, price, grp and size as arrays (kinds one after another).
    tests gives rows of kind, trial, factor, seed, ic, and groups and sizes or None."""
    kind = parts.schema[CODE].dataType.elementType.simpleString()

    def daily(rows: pa.Table) -> pa.Table:
        s, day = Section(rows), rows.column(DATE)[0].as_py()
        found, groups = tests(s, day)
        n, m = len(found), rows.num_rows if groups is not None else 0
        names, trials, factors, seeds, ics = zip(*found) if found else ((),) * 5
        out = {"kind": pa.array([*names, *[None] * m], pa.string()), "trial": pa.array([*trials, *[None] * m], pa.int32()), "factor": pa.array([*factors, *[None] * m], pa.string()), "seed": pa.array([*seeds, *[None] * m], pa.int32()), DATE: pa.array([day] * (n + m), pa.date32()), "ic": pa.array([*ics, *[None] * m], pa.float64())}
        code, prices = rows.column(CODE), None if price is None else rows.column(price)
        grp, size = pa.nulls(m, pa.list_(pa.int8())), pa.nulls(m, pa.list_(pa.int32()))
        if m:
            lengths = pc.list_value_length(code).to_numpy()
            back = np.empty(len(s.codes), np.int64)
            back[s.at.to_numpy(zero_copy_only=False)] = np.arange(len(s.codes))  # from the order of the codes to that of the parts
            cuts = np.split(groups[0][:, back], np.cumsum(lengths)[:-1], axis=1)
            grp = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths) * len(groups[0])]), pa.int32()), pa.array(np.concatenate([c.ravel() for c in cuts]), pa.int8()))
            flat = groups[1].ravel()
            size = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * len(flat), pa.int32()), pa.array(np.tile(flat, m), pa.int32()))
        longer = lambda x: pa.chunked_array([pa.nulls(n, x.type), *(x.chunks if isinstance(x, pa.ChunkedArray) else [x])], x.type) if m else pa.nulls(n, x.type)
        out |= {"part": longer(rows.column("part")), "cal_idx": longer(rows.column("cal_idx")), CODE: longer(code), "price": longer(prices) if prices is not None else pa.nulls(n, pa.list_(pa.float64())), "grp": longer(grp), "size": longer(size)}
        return pa.table(out)

    return parts.groupBy("cal_idx").applyInArrow(daily, f"{FOUND}, part int, cal_idx int, {CODE} array<{kind}>, price array<double>, grp array<tinyint>, size array<int>")


def held_days(found: DataFrame, days: DataFrame, names: Sequence[Mapping], n_groups: int, hold: int, cost: float) -> DataFrame:
    """`backtest.group_days` of the groups that `by_date` found: the columns of names (one for each of the kinds), trade_date, cal_idx, grp, gross,
    turnover, net. days: cal_idx, trade_date."""
    n_days, kinds = days.count(), len(names)

    def sums(rows: pa.Table) -> pa.Table:
        flat = lambda c: Section._flat(rows, c)
        codes = flat(CODE).dictionary_encode()
        at, n, lengths = codes.indices.to_numpy(zero_copy_only=False), len(codes.dictionary), pc.list_value_length(rows.column(CODE)).to_numpy()
        when = rows.column("cal_idx").to_numpy()
        day, ends = np.repeat(when, lengths), np.cumsum(lengths)
        price, p, there = flat("price"), np.zeros((n, n_days)), np.zeros((n, n_days), bool)
        p[at, day], there[at, day] = price.to_numpy(zero_copy_only=False), ~price.is_null().to_numpy(zero_copy_only=False)
        earns = earned(p, there)
        grp = flat("grp").to_numpy(zero_copy_only=False)
        grp = np.concatenate([grp[kinds * (e - k) : kinds * e].reshape(kinds, k) for e, k in zip(ends, lengths)], axis=1)
        size = np.zeros((n_days, kinds, n_groups), np.int64)
        size[when] = flat("size").to_numpy(zero_copy_only=False).reshape(-1, kinds, n_groups)
        cohorts = sum((np.pad(size > 0, ((j, 0), (0, 0), (0, 0)))[:n_days] for j in range(1, hold + 1)), np.zeros(size.shape, np.int64))
        out = []
        for i in range(kinds):
            for g in range(n_groups):
                mine = np.flatnonzero(grp[i] == g + 1)
                gross, turn = moves(earns, at[mine], day[mine], 1.0 / size[day[mine], i, g], cohorts[:, i, g], hold)
                on = np.flatnonzero(cohorts[:, i, g])
                out.append((np.full(len(on), i), np.full(len(on), g + 1), on, gross[on], turn[on]))
        kind, g, on, gross, turn = (np.concatenate(x) for x in zip(*out))
        return pa.table({"kind": pa.array(kind, pa.int32()), "grp": pa.array(g, pa.int32()), "cal_idx": pa.array(on, pa.int32()), "gross": pa.array(gross, pa.float64()), "turnover": pa.array(turn, pa.float64())})

    rows = found.where("part IS NOT NULL").select("part", "cal_idx", CODE, "price", "grp", "size")
    summed = rows.groupBy("part").applyInArrow(sums, "kind int, grp int, cal_idx int, gross double, turnover double").groupBy("kind", "grp", "cal_idx").agg(F.sum("gross").alias("gross"), F.sum("turnover").alias("turnover"))
    by = [F.element_at(F.array(*[F.lit(x[c]) for x in names]), F.col("kind") + 1).alias(c) for c in names[0]]
    out = summed.join(F.broadcast(days), "cal_idx")
    return out.select(*by, DATE, "cal_idx", "grp", "gross", "turnover", (F.col("gross") - cost * F.col("turnover")).alias("net"))


def trials_of(s: Section, day: date, factors: Sequence[str], label: str, shuffled: Sequence[str], first: int, trials: int, seed: int, least: int) -> list:
    """Rows of `validation.trial_correlations` of a date, without the factors' own; flags from bit `first` draw the universes."""
    rows, names, y = [], s.codes.cast(pa.string()).to_pylist(), s.column(label)
    draw = lambda salt, t: digests(names, f"{seed}|{salt}|{t}|", f"|{day}")
    base = [(f, s.column(f), s.column(f).known & y.known) for f in factors]
    base = [(f, x, m, x.places(m), y.places(m)) for f, x, m in base]
    for t in range(trials):
        lefts, rights = (np.lexsort((d[:, 1], d[:, 0])) for d in (draw("value", t), draw("label", t)))
        noise, moved, chosen = AMPLITUDE * (2 * share(draw("noise", t)) - 1), s.column(shuffled[t]), s.drawn(first + t)
        for f, x, m, a, b in base:
            rows += [("block_shuffle", t, f, None, ic) for ic in s.ic(x, moved, least, m)] + [("universe", t, f, None, ic) for ic in s.ic(x, y, least, chosen)]
            if m.any():
                wide, long = np.zeros(len(m)), np.zeros(len(m))
                wide[m], long[m] = a, b
                rows.append(("permutation", t, f, None, correlation(wide[lefts[m[lefts]]], long[rights[m[rights]]], least)))
                rows.append(("noise", t, f, None, correlation(places(a / m.sum() + noise[m]), b, least)))
    return rows


def placebo_of(s: Section, factors: Sequence[str], label: str, others: Sequence[str], least: int) -> list:
    """Rows of the correlations with other codes' labels of a date."""
    rows, y = [], s.column(label)
    own = s.raw(label)
    for t, c in enumerate(others):
        theirs = Column(own.take(pc.index_in(s.raw(c), value_set=s.codes)))
        rows += [("placebo", t, f, None, ic) for f in factors for ic in s.ic(s.column(f), theirs, least, y.known)]
    return rows
