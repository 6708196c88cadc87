"""Column functions of the factor language: cross-sectional, elementwise and time-series.

A panel has `code` and `trade_date`. Time-series functions count a code's own rows and are null until a full window of rows exists;
aggregates skip nulls within it. Division by zero and logarithms of non-positive numbers are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

CODE, DATE = "code", "trade_date"
#: Standard deviations at or below this count as zero.
FLAT = 1e-12
#: Rows beyond this many lengths of an ema weigh less than e^-20 in it: its look-back for reports. The ema itself reads all rows.
EMA_REACH = 10
#: Decimal orders that an ema's weights may span within one block of rows.
EMA_ORDERS = 250


def across(*groups) -> Window:
    return Window.partitionBy(DATE, *groups)


def along(n: int | None = None) -> Window:
    w = Window.partitionBy(CODE).orderBy(DATE)
    return w.rowsBetween(Window.unboundedPreceding if n is None else -(n - 1), 0)


def ordered() -> Window:
    return Window.partitionBy(CODE).orderBy(DATE)


def full(n: int, value: Column) -> Column:
    return F.when(F.count(F.lit(1)).over(along(n)) == n, value)


# Cross-sectional.


def rank(x: Column, *groups) -> Column:
    """Percentile in (0, 1] with average ties; nulls are left out."""
    place = F.rank().over(across(*groups).orderBy(x.asc_nulls_last()))
    peers = F.count(x).over(across(*groups, x))
    return F.when(x.isNotNull(), (place + (peers - 1) / 2) / F.count(x).over(across(*groups)))


def zscore(x: Column, *groups) -> Column:
    sd = F.stddev_samp(x).over(across(*groups))
    return F.when(sd > FLAT, (x - F.avg(x).over(across(*groups))) / sd)


def scale(x: Column) -> Column:
    return F.try_divide(x, F.sum(F.abs(x)).over(across()))


def indneutralize(x: Column, group: Column) -> Column:
    return x - F.avg(x).over(across(group))


# Elementwise.


def sign_power(x: Column, e: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(e)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def power(x: Column, e: Column) -> Column:
    return F.nanvl(F.pow(x, e), F.lit(None).cast("double"))


def greater(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y))


def lesser(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), F.least(x, y))


def where(c: Column, a: Column, b: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), a).otherwise(b)


def divide(x: Column, y: Column) -> Column:
    return F.try_divide(x.cast("double"), y.cast("double"))


# Time-series.


def ts_mean(x: Column, n: int) -> Column:
    return full(n, F.avg(x).over(along(n)))


def ts_std(x: Column, n: int) -> Column:
    return full(n, F.stddev_samp(x).over(along(n)))


def ts_max(x: Column, n: int) -> Column:
    return full(n, F.max(x).over(along(n)))


def ts_min(x: Column, n: int) -> Column:
    return full(n, F.min(x).over(along(n)))


def ts_sum(x: Column, n: int) -> Column:
    return full(n, F.sum(x).over(along(n)))


def ts_shift(x: Column, n: int) -> Column:
    return F.lag(x, n).over(ordered())


def ts_delta(x: Column, n: int) -> Column:
    return x - ts_shift(x, n)


def ts_rank(x: Column, n: int) -> Column:
    """Percentile of the current value among the window's values, average ties."""
    seen = F.collect_list(x).over(along(n))
    below, equal = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
    return full(n, F.when(x.isNotNull(), (below + (equal + 1) / 2) / F.size(seen)))


def _since(x: Column, n: int, best) -> Column:
    """Rows since the window's best value, the most recent of equal ones."""
    newest_first = F.reverse(F.collect_list(F.struct(x.alias("v"))).over(along(n)))["v"]
    return full(n, (F.array_position(newest_first, best(newest_first)) - 1).cast("int"))


def ts_argmax(x: Column, n: int) -> Column:
    return _since(x, n, F.array_max)


def ts_argmin(x: Column, n: int) -> Column:
    return _since(x, n, F.array_min)


def ts_corr(x: Column, y: Column, n: int) -> Column:
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sa, sb = F.stddev_samp(a).over(along(n)), F.stddev_samp(b).over(along(n))
    # Not the built-in corr: it fails where a side is constant.
    return full(n, F.when((sa > FLAT) & (sb > FLAT), F.try_divide(F.covar_samp(a, b).over(along(n)), sa * sb)))


def ts_cov(x: Column, y: Column, n: int) -> Column:
    return full(n, F.covar_samp(x, y).over(along(n)))


def ts_av_diff(x: Column, n: int) -> Column:
    return x - ts_mean(x, n)


def ts_zscore(x: Column, n: int) -> Column:
    sd = ts_std(x, n)
    return F.when(sd > FLAT, (x - ts_mean(x, n)) / sd)


def decay_linear(x: Column, n: int) -> Column:
    """Weights n to 1, the newest the largest; null if any value is."""
    total = x * n
    for k in range(1, n):
        total = total + F.lag(x, k).over(ordered()) * (n - k)
    return total / (n * (n + 1) / 2)


def ema(x: Column, n: int, staged: Callable[[str, Column], Column]) -> Column:
    """Recursive mean with weight 2 / (n + 1) over all rows so far, from the first value on; nulls are skipped.

    The recursion is a running sum of values over powers of its decay. The sum begins anew with each block of so many rows that the
    powers stay in range, and a block adds what the one before ended with; what is older than that weighs less than 10^-EMA_ORDERS.
    `staged` makes an intermediate column that later ones may use in their windows."""
    if n == 1:
        return F.last(x, ignorenulls=True).over(along())
    alpha = 2.0 / (n + 1)
    decay = 1 - alpha
    rows = int(EMA_ORDERS * math.log(10) / -math.log(decay))
    seen = staged("seen", F.count(x).over(along()))
    block, place = F.floor((seen - 1) / rows), F.pmod(seen - 1, F.lit(rows))
    weight = F.when(seen == 1, 1.0).otherwise(alpha)
    within = Window.partitionBy(CODE, block).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    sofar = staged("sofar", F.sum(weight * x * F.pow(F.lit(decay), -place)).over(within) * F.pow(F.lit(decay), place))
    ended = staged("ended", F.max_by(sofar, F.col(DATE)).over(Window.partitionBy(CODE).orderBy(block).rangeBetween(-1, -1)))
    return sofar + F.coalesce(ended, F.lit(0.0)) * F.pow(F.lit(decay), place + 1)


def trade_when(c: Column, alpha: Column, hold: Column) -> Column:
    return where(c, alpha, hold)


# Outside the approved palette.


def product(x: Column, n: int) -> Column:
    return full(n, F.product(x).over(along(n)))


def rsi(x: Column, n: int) -> Column:
    """100 times the share of gains in the sum of moves over the last n moves."""
    move = ts_delta(x, 1)
    gain, moves = F.sum(F.greatest(move, F.lit(0.0))).over(along(n)), F.sum(F.abs(move)).over(along(n))
    return F.when(F.count(move).over(along(n)) == n, 100 * F.try_divide(gain, moves))


def obv_step(x: Column, volume: Column) -> Column:
    """volume with the sign of each move; the first row counts nothing."""
    return F.coalesce(F.signum(ts_delta(x, 1)), F.lit(0.0)) * volume


def obv(x: Column, volume: Column) -> Column:
    return F.sum(obv_step(x, volume)).over(along())


def boll(x: Column, n: int, widths: float) -> Column:
    return ts_mean(x, n) + widths * ts_std(x, n)


def atr(high: Column, low: Column, close: Column, n: int) -> Column:
    before = ts_shift(close, 1)
    return full(n, F.avg(F.greatest(high - low, F.abs(high - before), F.abs(low - before))).over(along(n)))
