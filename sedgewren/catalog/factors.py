"""One query per function of the factor language, over the stand-in panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import dsl
from . import views
from .views import cs, full, lag, rank, ts, zscore

#: Query: (expression, SQL of the value, digits). SQL sees panel columns and region; x1 is `step`, an intermediate column.
CASES: dict[str, tuple[str, str, int]] = {
    "d01_rank": ("rank(close)", rank("close"), 6),
    "d02_zscore": ("zscore(volume)", zscore("volume"), 6),
    "d03_group_rank": ("group_rank(close, region)", rank("close", "region"), 6),
    "d04_group_zscore": ("group_zscore(volume, region)", zscore("volume", "region"), 6),
    "d05_scale": ("scale(close - 1500)", f"(close - 1500) / nullif(sum(abs(close - 1500)) {cs()}, 0)", 6),
    "d06_indneutralize": ("indneutralize(close, region)", f"close - avg(close) {cs('region')}", 4),
    "d07_sign": ("sign(close - 1500)", "CAST(sign(close - 1500) AS DOUBLE)", 6),
    "d08_sign_power": ("sign_power(close / 1000 - 1.5, 2)", "sign(close / 1000 - 1.5::DOUBLE) * pow(abs(close / 1000 - 1.5::DOUBLE), 2)", 6),
    "d09_tanh": ("tanh(close / 1000 - 1.5)", "tanh(close / 1000 - 1.5::DOUBLE)", 6),
    "d10_sigmoid": ("sigmoid(close / 1000 - 1.5)", "1 / (1 + exp(-(close / 1000 - 1.5::DOUBLE)))", 6),
    "d11_clip": ("clip(close, 1000, 2000)", "least(greatest(close, 1000.0::DOUBLE), 2000.0::DOUBLE)", 4),
    "d12_log": ("log(close - 1500)", "CASE WHEN close - 1500 > 0 THEN ln(close - 1500) END", 6),
    "d13_abs": ("abs(close - 1500)", "abs(close - 1500)", 4),
    "d14_sqrt": ("sqrt(close - 1500)", "CASE WHEN close - 1500 >= 0 THEN sqrt(close - 1500) END", 6),
    "d15_exp": ("exp(close / 1000)", "exp(close / 1000)", 6),
    "d16_power": ("power(close / 1000, 1.5)", "pow(close / 1000, 1.5::DOUBLE)", 6),
    "d17_max": ("max(close, volume * 50)", "greatest(close, volume * 50)", 4),
    "d18_min": ("min(close, volume * 50)", "least(close, volume * 50)", 4),
    "d19_where": ("where(close > 1500, high, low)", "CASE WHEN close > 1500 THEN high ELSE low END", 4),
    "d20_and": ("where(close > 1500 and volume > 20, 1, 0)", "CASE WHEN close > 1500 AND volume > 20 THEN 1.0::DOUBLE ELSE 0 END", 6),
    "d21_or": ("where(close > 1500 or volume > 20, 1, 0)", "CASE WHEN close > 1500 OR volume > 20 THEN 1.0::DOUBLE ELSE 0 END", 6),
    "d22_arithmetic": ("-(close - low) / (high - low) + (2 if volume > 20 else volume ^ 0.5)", "-(close - low) / nullif(high - low, 0) + CASE WHEN volume > 20 THEN 2.0::DOUBLE ELSE pow(volume, 0.5::DOUBLE) END", 6),
    "d23_ts_mean": ("ts_mean(close, 5)", full(5, f"avg(close) {ts(5)}"), 4),
    "d24_ts_std": ("ts_std(volume, 10)", full(10, f"stddev_samp(volume) {ts(10)}"), 5),
    "d25_ts_max": ("ts_max(close, 10)", full(10, f"max(close) {ts(10)}"), 4),
    "d26_ts_min": ("ts_min(close, 10)", full(10, f"min(close) {ts(10)}"), 4),
    "d27_ts_sum": ("ts_sum(volume, 10)", full(10, f"sum(volume) {ts(10)}"), 4),
    "d28_ts_shift": ("ts_shift(close, 3)", lag("close", 3), 4),
    "d29_ts_delta": ("ts_delta(close, 3)", f"close - {lag('close', 3)}", 4),
    "d30_ts_rank": (
        "ts_rank(close, 10)",
        full(10, f"(len(list_filter(list(close) {ts(10)}, lambda v: v < close)) + (len(list_filter(list(close) {ts(10)}, lambda v: v = close)) + 1) / 2.0::DOUBLE) / count(close) {ts(10)}"),
        6,
    ),
    "d31_ts_argmax": ("ts_argmax(close, 10)", full(10, f"list_position(list_reverse(list(close) {ts(10)}), max(close) {ts(10)}) - 1"), 0),
    "d32_ts_argmin": ("ts_argmin(close, 10)", full(10, f"list_position(list_reverse(list(close) {ts(10)}), min(close) {ts(10)}) - 1"), 0),
    "d33_ts_corr": (
        "ts_corr(close, volume, 10)",
        full(10, f"CASE WHEN stddev_samp(close) {ts(10)} > 1e-12 AND stddev_samp(volume) {ts(10)} > 1e-12 THEN corr(close, volume) {ts(10)} END"),
        5,
    ),
    "d34_ts_cov": ("ts_cov(close, volume, 10)", full(10, f"covar_samp(close, volume) {ts(10)}"), 3),
    "d35_ts_av_diff": ("ts_av_diff(close, 5)", f"close - {full(5, f'avg(close) {ts(5)}')}", 4),
    "d36_ts_zscore": ("ts_zscore(volume, 10)", f"CASE WHEN {full(10, f'stddev_samp(volume) {ts(10)}')} > 1e-12 THEN (volume - avg(volume) {ts(10)}) / stddev_samp(volume) {ts(10)} END", 5),
    "d37_decay_linear": ("decay_linear(close, 4)", f"(close * 4 + {lag('close', 1)} * 3 + {lag('close', 2)} * 2 + {lag('close', 3)}) / 10", 4),
    "d38_wma": ("wma(volume, 3)", f"(volume * 3 + {lag('volume', 1)} * 2 + {lag('volume', 2)}) / 6", 5),
    "d39_sma": ("sma(volume, 5)", full(5, f"avg(volume) {ts(5)}"), 5),
    "d40_ema": ("ema(volume, 3)", f"list_reduce(list(volume) {ts()}, lambda a, v: a + 0.5::DOUBLE * (v - a))", 5),
    "d41_trade_when": ("trade_when(volume > 20, close, -1)", "CASE WHEN volume > 20 THEN close ELSE -1.0::DOUBLE END", 4),
    "d42_product": ("product(close / 1000, 3)", full(3, f"product(close / 1000) {ts(3)}"), 5),
    "d46_boll_mid": ("boll_mid(close, 20)", full(20, f"avg(close) {ts(20)}"), 4),
    "d47_boll_upper": ("boll_upper(close, 20)", full(20, f"avg(close) {ts(20)} + 2 * stddev_samp(close) {ts(20)}"), 4),
    "d48_boll_lower": ("boll_lower(close, 20, 1.5)", full(20, f"avg(close) {ts(20)} - 1.5::DOUBLE * stddev_samp(close) {ts(20)}"), 4),
    "d50_adv": ("volume / adv5", f"volume / {full(5, f'avg(volume) {ts(5)}')}", 5),
    "d51_returns": ("returns", f"close / {lag('close', 1)} - 1", 6),
    "d52_calendar_fields": ("day + weekday * 100 + month * 1000", "day(trade_date) + (isodow(trade_date) - 1) * 100 + month(trade_date) * 1000", 0),
}

#: Queries whose SQL stages an intermediate column: (expression, SQL of step, SQL of the value, digits).
STAGED: dict[str, tuple[str, str, str, int]] = {
    "rank_momentum": ("rank(ts_mean(volume, 5))", full(5, f"avg(volume) {ts(5)}"), rank("step"), 6),
    "d43_rsi": (
        "rsi(close, 6)",
        f"close - {lag('close', 1)}",
        f"CASE WHEN count(step) {ts(6)} = 6 THEN 100 * (sum(greatest(step, 0)) {ts(6)} / nullif(sum(abs(step)) {ts(6)}, 0)) END",
        5,
    ),
    "d44_macd": (
        "macd(volume, 3, 6)",
        f"list_reduce(list(volume) {ts()}, lambda a, v: a + 0.5::DOUBLE * (v - a))",
        f"step - list_reduce(list(volume) {ts()}, lambda a, v: a + (2.0::DOUBLE / 7) * (v - a))",
        5,
    ),
    "d45_obv": ("obv(close, volume)", f"coalesce(sign(close - {lag('close', 1)}), 0) * volume", f"sum(step) {ts()}", 4),
    "d49_atr": (
        "atr(high, low, close, 5)",
        lag("close", 1),
        full(5, f"avg(greatest(high - low, coalesce(abs(high - step), 0), coalesce(abs(low - step), 0))) {ts(5)}"),
        4,
    ),
    "d53_nested": ("zscore(ts_av_diff(volume, 5)) * rank(ts_av_diff(volume, 5))", f"volume - {full(5, f'avg(volume) {ts(5)}')}", f"({zscore('step')}) * ({rank('step')})", 4),
}


def query(expression: str, digits: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grouped = "region" in dsl.fields(expression)
        source = views.grouped_panel(spark, sf_dir) if grouped else views.panel(spark, sf_dir)
        return dsl.evaluate(source, {"value": expression}).withColumn("value", F.round(F.col("value").cast("double"), digits))

    return run


QUERIES = {n: query(e, d) for n, (e, _, d) in CASES.items()} | {n: query(e, d) for n, (e, _, _, d) in STAGED.items()}
ORACLES = {n: f"WITH {views.GROUPED} SELECT code, trade_date, round(CAST({sql} AS DOUBLE), {d}) AS value FROM grouped" for n, (_, sql, d) in CASES.items()} | {
    n: f"WITH {views.GROUPED}, staged AS (SELECT *, {step} AS step FROM grouped) SELECT code, trade_date, round(CAST({sql} AS DOUBLE), {d}) AS value FROM staged"
    for n, (_, step, sql, d) in STAGED.items()
}


def many_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve expressions over one scan: windows of equal partitioning share their exchange."""
    texts = {n: CASES[n][0] for n in ("d01_rank", "d02_zscore", "d23_ts_mean", "d24_ts_std", "d25_ts_max", "d29_ts_delta", "d33_ts_corr", "d36_ts_zscore", "d37_decay_linear", "d50_adv", "d51_returns")}
    out = dsl.evaluate(views.panel(spark, sf_dir), texts | {"momentum": STAGED["rank_momentum"][0]})
    return out.select("code", "trade_date", *[F.round(c, 3).alias(c) for c in out.columns[2:]])


QUERIES["many_factors"] = many_factors
ORACLES["many_factors"] = (
    f"WITH {views.GROUPED}, staged AS (SELECT *, {STAGED['rank_momentum'][1]} AS step FROM grouped) SELECT code, trade_date, "
    + ", ".join(
        f"round(CAST({CASES[n][1]} AS DOUBLE), 3) AS {n}"
        for n in ("d01_rank", "d02_zscore", "d23_ts_mean", "d24_ts_std", "d25_ts_max", "d29_ts_delta", "d33_ts_corr", "d36_ts_zscore", "d37_decay_linear", "d50_adv", "d51_returns")
    )
    + f", round(CAST({STAGED['rank_momentum'][2]} AS DOUBLE), 3) AS momentum FROM staged"
)
