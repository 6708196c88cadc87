"""Dependency of all pairs of a library's factors, from the long store, in blocks.

values: code, trade_date, factor, value. Factors are dealt to blocks of BLOCK; a task takes one date and one pair of blocks, two matrices of
codes by at most BLOCK factors, and finds all their correlations by products of matrices. A date's values of a block are packed to one row first,
which is sent once for each block that its own meets, so the shuffle grows with the number of blocks, not of factors, and a task's memory with a
date's codes. A wide panel's factors (`passes.packed`) are columns already: a task takes a date with all of them, and pairs of blocks in turn.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .gates import NOVELTY
from .panel import CODE, DATE
from .passes import Section
from .ranking import dense_names
from .sections import places

FLAT = 1e-10
BLOCK = 32
#: The largest of these is a pair's dependency; fixed.
DEPENDENCY = ("p90_rank", "p90_pearson", "mean_rank", "mean_pearson")


def correlations(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of the columns of x with those of y over rows where both are set (null with fewer than `least` or a constant side), and
    the numbers of such rows."""
    in_x, in_y = ~np.isnan(x), ~np.isnan(y)
    centred = lambda a, known: np.where(known, a - np.where(known.any(axis=0), np.nansum(np.where(known, a, 0.0), axis=0) / np.maximum(known.sum(axis=0), 1), 0.0), 0.0)
    x, y, m, k = centred(x, in_x), centred(y, in_y), in_x.astype(float), in_y.astype(float)
    n = m.T @ k
    size = np.maximum(n, 1)
    sx, sy = x.T @ k / size, m.T @ y / size
    vx, vy = np.maximum((x * x).T @ k / size - sx**2, 0), np.maximum(m.T @ (y * y) / size - sy**2, 0)
    ok = (n >= least) & (np.sqrt(vx) > FLAT) & (np.sqrt(vy) > FLAT)
    return np.where(ok, (x.T @ y / size - sx * sy) / np.where(ok, np.sqrt(vx * vy), 1.0), np.nan), n


def pair_days(values: DataFrame, least: int = 10, block: int = BLOCK) -> DataFrame:
    """a, b, trade_date, common, pearson, rank of every pair of factors (a before b) and date with at least `least` common codes. Ranks are
    within each factor's own codes of the date, equal values at their mean place."""
    known = values.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col(CODE).isNotNull()).select(CODE, DATE, "factor", F.col("value").cast("double").alias("v"))
    names = graph.shared_checkpoint(dense_names(known.select("factor").distinct(), 0))  # a row a factor
    n_blocks = max(1, -(-names.count() // block))
    owned = known.join(names, "factor").select(DATE, CODE, "factor", "v", F.expr(f"name div {block}").alias("own"))
    kind = values.schema[CODE].dataType.simpleString()

    def packed(keys: tuple, rows: pa.Table) -> pa.Table:
        codes = rows.column(CODE).combine_chunks().dictionary_encode()
        factors = rows.column("factor").combine_chunks().dictionary_encode()
        m = np.full((len(factors.dictionary), len(codes.dictionary)), np.nan)
        m[factors.indices.to_numpy(zero_copy_only=False), codes.indices.to_numpy(zero_copy_only=False)] = rows.column("v").to_numpy()
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.table({DATE: pa.array([keys[0].as_py()], pa.date32()), "own": pa.array([keys[1].as_py()], pa.int64()), "codes": one(codes.dictionary), "factors": one(factors.dictionary), "cells": one(pa.array(m.ravel()))})

    # A row a date and block: its codes, its factors and the values of both. It goes to every pair of blocks that its own is in.
    blocks = owned.groupBy(DATE, "own").applyInArrow(packed, f"{DATE} date, own long, codes array<{kind}>, factors array<string>, cells array<double>")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    dealt = blocks.select("*", other.alias("other")).select(DATE, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "codes", "factors", "cells")
    schema = "a string, b string, trade_date date, common long, pearson double, rank double"

    def daily(keys: tuple, rows: pa.Table) -> pa.Table:
        day, i, j = (k.as_py() for k in keys)
        row = {o: n for n, o in enumerate(rows.column("own").to_pylist())}
        part = lambda b, c: rows.column(c).slice(row[b], 1).combine_chunks().flatten()
        found = {b: part(b, "codes") for b in {i, j} & set(row)}
        of = pa.chunked_array(list(found.values())).combine_chunks().dictionary_encode()
        at = dict(zip(found, np.split(of.indices.to_numpy(zero_copy_only=False), np.cumsum([len(c) for c in found.values()])[:-1])))

        def matrices(b: int):
            if b not in row:
                return np.array([], str), [np.zeros((len(of.dictionary), 0))] * 2
            factors, n = np.array(part(b, "factors").to_pylist(), str), len(found[b])
            of_block, both = part(b, "cells").to_numpy().reshape(len(factors), n), [np.full((len(of.dictionary), len(factors)), np.nan) for _ in range(2)]
            for k, x in enumerate(of_block):
                there = ~np.isnan(x)
                both[0][at[b][there], k], both[1][at[b][there], k] = x[there], places(x[there])
            return factors, both

        (left, x), (right, y) = matrices(i), matrices(j)
        pearson, n = correlations(x[0], y[0], least)
        rank, _ = correlations(x[1], y[1], least)
        pick = n >= least
        if i == j:
            pick &= np.triu(np.ones(pick.shape, bool), 1)
        p, q = np.nonzero(pick)
        a, b = np.where(left[p] < right[q], left[p], right[q]), np.where(left[p] < right[q], right[q], left[p])
        null = lambda z: pa.array(z, mask=np.isnan(z))
        return pa.table({"a": pa.array(a.tolist(), pa.string()), "b": pa.array(b.tolist(), pa.string()), "trade_date": pa.array([day] * len(p), pa.date32()), "common": n[p, q].astype(np.int64), "pearson": null(pearson[p, q]), "rank": null(rank[p, q])})

    return dealt.groupBy(DATE, "i", "j").applyInArrow(daily, schema)


def section_days(parts: DataFrame, factors: Sequence[str], least: int = 10, block: int = BLOCK, label: str | None = None, labelled: Sequence[str] = ()) -> DataFrame:
    """`pair_days` of columns that `passes.packed` made. With a label also rows without b for the factors `labelled`: rank is the rank correlation
    with it."""
    blocks = [list(factors[i : i + block]) for i in range(0, len(factors), block)]

    def daily(rows: pa.Table) -> pa.Table:
        s, day, out = Section(rows), rows.column(DATE)[0].as_py(), []

        def matrices(names: list) -> list[np.ndarray]:
            both = [np.full((len(s.codes), len(names)), np.nan) for _ in range(2)]
            for k, f in enumerate(names):
                c = s.column(f)
                there = c.known & ~np.isnan(c.x)
                both[0][there, k], both[1][there, k] = c.x[there], c.places(there)
            return both

        for i, left in enumerate(blocks):
            x = matrices(left)
            for right in blocks[i:]:
                y = x if right is left else matrices(right)
                (pearson, n), (rank, _) = correlations(x[0], y[0], least), correlations(x[1], y[1], least)
                for p, q in zip(*np.nonzero(n >= least)):
                    if right is not left or p < q:
                        out.append((min(left[p], right[q]), max(left[p], right[q]), int(n[p, q]), *(None if np.isnan(z[p, q]) else float(z[p, q]) for z in (pearson, rank))))
        out += [(f, None, None, None, ic) for f in labelled if label for ic in s.ic(s.column(f), s.column(label), least)]
        a, b, common, pearson, rank = zip(*out) if out else ((),) * 5
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "trade_date": pa.array([day] * len(a), pa.date32()), "common": pa.array(common, pa.int64()), "pearson": pa.array(pearson, pa.float64()), "rank": pa.array(rank, pa.float64())})

    return parts.groupBy("cal_idx").applyInArrow(daily, "a string, b string, trade_date date, common long, pearson double, rank double")


def pairs(values: DataFrame, least: int = 10, rows: int = 300, block: int = BLOCK) -> DataFrame:
    """a, b, mean, 90th percentile and maximum of both absolute daily correlations, days, common (mean codes) and dependency, for pairs with at
    least `rows` common rows in all."""
    return pair_statistics(pair_days(values, least, block), rows)


def pair_statistics(days: DataFrame, rows: int) -> DataFrame:
    """`pairs` of the rows of `pair_days`."""
    p, r = F.abs("pearson"), F.abs("rank")
    of = days.groupBy("a", "b").agg(
        F.avg(p).alias("mean_pearson"), F.percentile(p, F.lit(0.9)).alias("p90_pearson"), F.max(p).alias("max_pearson"),
        F.avg(r).alias("mean_rank"), F.percentile(r, F.lit(0.9)).alias("p90_rank"), F.max(r).alias("max_rank"),
        F.greatest(F.count("pearson"), F.count("rank")).alias("days"), F.avg("common").alias("common"), F.sum("common").alias("rows"),
    )
    of = of.where((F.col("days") > 0) & (F.col("rows") >= rows)).drop("rows")
    return of.withColumn("dependency", F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in DEPENDENCY]))


def conflicting(of: DataFrame) -> DataFrame:
    """a, b of pairs of which any statistic reaches its novelty threshold."""
    reaches = F.lit(False)
    for c, least in {"mean_pearson": "pearson", "mean_rank": "rank", "p90_pearson": "p90_pearson", "p90_rank": "p90_rank"}.items():
        reaches = reaches | F.coalesce(F.col(c) >= NOVELTY[least], F.lit(False))
    return of.where(reaches).select("a", "b")


def accepted(values: DataFrame, scores: DataFrame, least: int = 10, rows: int = 300, block: int = BLOCK) -> DataFrame:
    """node: candidates that are novel when taken best first, against all other factors and the candidates accepted before them.

    scores: factor, score of the candidates; factors that have values but no score are the library, which nothing may depend on."""
    return accepted_of(pairs(values, least, rows, block), scores)


def accepted_of(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """`accepted` of the statistics of pairs."""
    of = graph.shared_checkpoint(conflicting(pairs))
    both = of.unionByName(of.select(F.col("b").alias("a"), F.col("a").alias("b")))
    names = scores.select(F.col("factor").alias("b"))
    taken = both.join(names, "b", "left_anti").select(F.col("a").alias("factor")).distinct()
    candidates = scores.join(taken, "factor", "left_anti").select(F.col("factor").alias("node"), "score")
    return graph.novel(candidates, of)
