"""Gradient boosting for regression over a feature matrix, level by level.

Features become bins once, by edges that are quantiles of all rows. A level of a tree is one pass: each row adds its gradient to a
histogram cell of its node for every feature, cells are summed before they are shuffled, and each node's best split is found by running
sums over its cells. What reaches the driver is a level's splits, at most 2 to the power of the depth rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import shared_checkpoint


#: Trees whose steps are computed again from the bins before the rest is kept.
KEPT = 8


@dataclass(frozen=True)
class Split:
    """A node's rule: rows whose bin of the feature is at most `bin` go left (node 2n), others and those without a value right (2n + 1)."""

    tree: int
    node: int
    feature: int
    bin: int
    gain: float


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    base: float
    splits: tuple[Split, ...]
    leaves: dict[tuple[int, int], float]  # of (tree, node)


def quantile_edges(df: DataFrame, features: list[str], bins: int) -> tuple[tuple[float, ...], ...]:
    """Distinct upper edges of each feature's bins but the last, by quantiles of its values; `bins` numbers a feature."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 100_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return tuple(tuple(sorted(set(row[f"q{i}"] or ()))) for i in range(len(features)))


def binned(value: Column, edges: tuple[float, ...]) -> Column:
    """The number of edges below the value; one more than all of them for null."""
    edge = F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>")
    return F.when(value.isNull() | F.isnan(value), len(edges) + 1).otherwise(F.size(F.filter(edge, lambda e: e < value)))


def _best(cells: DataFrame, least: int, smoothing: float) -> DataFrame:
    """node, feature, bin, gain of each node's best split, by gain, then feature, then bin. cells: node, feature, bin, n, g."""
    along = Window.partitionBy("node", "feature").orderBy("bin")
    every = Window.partitionBy("node", "feature")
    n, g = F.sum("n").over(every), F.sum("g").over(every)
    left_n, left_g = F.sum("n").over(along), F.sum("g").over(along)
    score = lambda s, c: s * s / (c + smoothing)
    gain = score(left_g, left_n) + score(g - left_g, n - left_n) - score(g, n)
    scored = cells.select("node", "feature", "bin", left_n.alias("left"), (n - left_n).alias("right"), gain.alias("gain")).where((F.col("left") >= least) & (F.col("right") >= least))
    best = scored.groupBy("node").agg(F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"))).alias("b"))
    return best.where("b.gain > 0").select("node", (-F.col("b.feature")).alias("feature"), (-F.col("b.bin")).alias("bin"), F.col("b.gain").alias("gain"))


def _moved(node: Column, splits: list[Split], column) -> Column:
    out = node
    for s in splits:
        out = F.when(node == s.node, F.when(column(s.feature) <= s.bin, 2 * s.node).otherwise(2 * s.node + 1)).otherwise(out)
    return out


def train(df: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 3, rate: float = 0.1, bins: int = 32, least: int = 20, smoothing: float = 1.0) -> Model:
    """A model of squared error. Rows without a label are left out; no row is sampled, so the same rows give the same model.

    Labels and bins are kept once; what is left to a tree follows from them and the trees before it, and is kept again after KEPT trees."""
    edges = quantile_edges(df.where(F.col(label).isNotNull()), features, bins)
    column = lambda i: F.col(f"b{i}")
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *[binned(F.col(f).cast("double"), e).cast("int").alias(f"b{i}") for i, (f, e) in enumerate(zip(features, edges, strict=True))])
    rows = shared_checkpoint(rows)
    base = rows.agg(F.avg("y")).first()[0] or 0.0
    work = rows.withColumn("r", F.col("y") - base).drop("y")
    all_splits, leaves = [], {}
    for t in range(trees):
        at = work.withColumn("node", F.lit(1))
        tree: list[Split] = []
        for _ in range(depth):
            cell = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), column(i).alias("bin")) for i in range(len(features))]))
            cells = at.select("node", "r", cell.alias("c")).groupBy("node", "c.feature", "c.bin").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("g"))
            found = [Split(t, r["node"], r["feature"], r["bin"], r["gain"]) for r in _best(cells, least, smoothing).orderBy("node").collect()]
            found = [s for s in found if not any(x.node == s.node for x in tree)]
            if not found:
                break
            tree += found
            at = at.withColumn("node", _moved(F.col("node"), found, column))
        values = {r["node"]: rate * r["g"] / (r["n"] + smoothing) for r in at.groupBy("node").agg(F.sum("r").alias("g"), F.count(F.lit(1)).alias("n")).collect()}  # at most 2^depth
        leaves |= {(t, node): v for node, v in values.items()}
        all_splits += tree
        step = F.lit(0.0)
        for node, v in values.items():
            step = F.when(F.col("node") == node, v).otherwise(step)
        work = at.withColumn("r", F.col("r") - step).drop("node")
        if t % KEPT == KEPT - 1 and t + 1 < trees:
            work = shared_checkpoint(work)
    return Model(tuple(features), edges, base, tuple(all_splits), leaves)


def predict(df: DataFrame, model: Model, name: str = "prediction") -> DataFrame:
    """df with the model's value; rows without a feature's value go right where it is asked for."""
    names = {i: f"__bin{i}" for i in range(len(model.features))}
    made = df.withColumns({names[i]: binned(F.col(f).cast("double"), e) for i, (f, e) in enumerate(zip(model.features, model.edges, strict=True))})
    total = F.lit(model.base)
    for t in sorted({t for t, _ in model.leaves}):
        of = {s.node: s for s in model.splits if s.tree == t}

        def value(node: int, t=t, of=of) -> Column:
            if node in of:
                return F.when(F.col(names[of[node].feature]) <= of[node].bin, value(2 * node)).otherwise(value(2 * node + 1))
            return F.lit(model.leaves.get((t, node), 0.0))

        total = total + value(1)
    return made.withColumn(name, total).drop(*names.values())
