"""Boosting against a plain loop over rows, cells and nodes, and on data with a known shape."""

import numpy as np
from pyspark.sql import functions as F

from sedgewren.operators import boosting


def plain(x, y, edges, trees, depth, rate, least, smoothing):
    """Splits and leaves by loops."""
    bins = np.array([[len(e) + 1 if v is None or np.isnan(v) else sum(q < v for q in e) for v, e in zip(row, edges)] for row in x])
    r, splits, leaves = y - y.mean(), [], {}
    for t in range(trees):
        node, tree = np.ones(len(y), int), {}
        for _ in range(depth):
            found = {}
            for n in sorted(set(node.tolist()) - set(tree)):
                own, best = node == n, None
                for f in range(bins.shape[1]):
                    for b in sorted(set(bins[own, f].tolist())):
                        left = own & (bins[:, f] <= b)
                        right = own & ~left
                        if left.sum() >= least and right.sum() >= least:
                            score = lambda m: r[m].sum() ** 2 / (m.sum() + smoothing)
                            gain = round(score(left) + score(right) - score(own), 9)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, f, b)
                if best:
                    found[n] = best
            if not found:
                break
            tree |= found
            for n, (gain, f, b) in found.items():
                own = node == n
                node = np.where(own, np.where(bins[:, f] <= b, 2 * n, 2 * n + 1), node)
                splits.append((t, n, f, b))
        for n in set(node.tolist()):
            own = node == n
            leaves[t, n] = rate * r[own].sum() / (own.sum() + smoothing)
        r = r - np.array([leaves[t, n] for n in node])
    return splits, leaves


def test_equals_the_plain_loop(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + np.where((x[:, 1] > 0) & (x[:, 0] <= 0.3), 1.5, 0) + rng.normal(size=600) * 0.2
    x[rng.random(size=x.shape) < 0.05] = np.nan
    data = [(*[None if np.isnan(v) else float(v) for v in row], float(t)) for row, t in zip(x, y)]
    df = spark.createDataFrame([*data, (1.0, 1.0, 1.0, None)], "a double, b double, c double, y double").repartition(5)
    model = boosting.train(df, ["a", "b", "c"], "y", trees=3, depth=3, rate=0.3, bins=8, least=20)
    splits, leaves = plain(x, y, model.edges, 3, 3, 0.3, 20, 1.0)
    assert [(s.tree, s.node, s.feature, s.bin) for s in model.splits] == splits and model.splits[0].feature == 0
    assert set(model.leaves) == set(leaves) and all(abs(model.leaves[k] - leaves[k]) < 1e-9 for k in leaves)
    error = lambda m: boosting.predict(df.where("y IS NOT NULL"), m).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2.0))).first()[0]
    longer = boosting.train(df, ["a", "b", "c"], "y", trees=6, depth=3, rate=0.3, bins=8, least=20)
    assert longer.splits[: len(model.splits)] == model.splits and error(longer) < error(model) < y.var()


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (None, 2.0)], "a double, y double")
    model = boosting.train(df, ["a"], "y", trees=2, least=1)
    assert not model.splits and [r.prediction for r in boosting.predict(df, model).collect()] == [2.0] * 3
    assert boosting.train(df.limit(0), ["a"], "y", trees=1).base == 0.0
