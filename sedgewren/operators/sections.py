"""Rank correlations of many factors with many labels, a date's cross-section at a time.

A task takes one date: its codes by factors and by variants of the label, two matrices. A value is shuffled once and a label once a
variant, whatever the number of pairs; ranks and correlations of all pairs are found there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAT = 1e-10
CODE, DATE = "code", "trade_date"


def places(x: np.ndarray) -> np.ndarray:
    """Places from 1, equal values at their mean place; NaN is the largest value."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def correlation(a: np.ndarray, b: np.ndarray, least: int) -> float | None:
    """Null with fewer pairs than `least` or a constant side."""
    if len(a) < least:
        return None
    a, b = a - a.mean(), b - b.mean()
    sa, sb = np.sqrt(np.mean(a * a)), np.sqrt(np.mean(b * b))
    return float(np.mean(a * b) / (sa * sb)) if sa > FLAT and sb > FLAT else None


def grid(names: pa.ChunkedArray, at: np.ndarray, values: pa.ChunkedArray, width: int) -> tuple[list, np.ndarray, np.ndarray]:
    """The distinct names, a row each with the values at `at`, and where it has one."""
    of = pa.chunked_array(names.chunks, names.type).combine_chunks().dictionary_encode()
    row = of.indices.to_numpy(zero_copy_only=False)
    x, known = np.zeros((len(of.dictionary), width)), np.zeros((len(of.dictionary), width), bool)
    x[row, at], known[row, at] = values.to_numpy(), True
    return of.dictionary.to_pylist(), x, known


def matrices(left: pa.Table, right: pa.Table):
    """The codes of a date, and grids of its factors' values and of its variants' labels over them."""
    codes = pa.chunked_array(left.column(CODE).chunks + right.column(CODE).chunks, left.schema.field(CODE).type).combine_chunks().dictionary_encode()
    at, n = codes.indices.to_numpy(zero_copy_only=False), len(codes.dictionary)
    return codes.dictionary, grid(left.column("factor"), at[: left.num_rows], left.column("value"), n), grid(right.column("variant"), at[left.num_rows :], right.column("y"), n)


def of_date(values: DataFrame, said: DataFrame):
    """values and said grouped by date together. said: code, trade_date, variant, y."""
    x = values.where("value IS NOT NULL").select(F.col(DATE).alias(DATE), F.col(CODE).alias(CODE), "factor", F.col("value").cast("double").alias("value"))
    y = said.where("y IS NOT NULL").select(F.col(DATE).alias(DATE), F.col(CODE).cast(values.schema[CODE].dataType).alias(CODE), "variant", F.col("y").cast("double").alias("y"))
    return x.where(F.col(CODE).isNotNull()).groupBy(DATE).cogroup(y.where(F.col(CODE).isNotNull()).groupBy(DATE))


def variant_correlations(values: DataFrame, said: DataFrame, least: int) -> DataFrame:
    """factor, variant, trade_date, ic: rank correlation of each factor with each variant of the label over the codes that have both; null with
    fewer than `least` or a constant side, no row without any. values: code, trade_date, factor, value; said: code, trade_date, variant, y."""
    kind = said.schema["variant"].dataType.simpleString()

    def daily(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            _, (factors, x, in_x), (variants, y, in_y) = matrices(left, right)
            for i, f in enumerate(factors):
                for j, v in enumerate(variants):
                    m = in_x[i] & in_y[j]
                    if m.any():
                        rows.append((f, v, key[0].as_py(), correlation(places(x[i, m]), places(y[j, m]), least)))
        f, v, day, ic = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"factor": pa.array(f, left.schema.field("factor").type), "variant": pa.array(v, right.schema.field("variant").type), DATE: pa.array(day, pa.date32()), "ic": pa.array(ic, pa.float64())})

    return of_date(values, said).applyInArrow(daily, f"factor string, variant {kind}, {DATE} date, ic double")


def percentiles(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the percentile in (0, 1] of each of `columns` (new name: column) within its date, average ties, nulls left out; all of them in
    one pass, where a window function each would sort the rows again."""
    extra = "".join(f", `{n}` double" for n in columns)

    def ranked(rows: pa.Table) -> pa.Table:
        for n, c in columns.items():
            known = ~rows.column(c).is_null().to_numpy()
            x = rows.column(c).cast(pa.float64()).to_numpy()
            of = np.zeros(len(x))
            of[known] = places(x[known]) / max(known.sum(), 1)
            rows = rows.append_column(n, pa.array(of, pa.float64(), mask=~known))
        return rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(DATE).applyInArrow(ranked, schema + extra)
