"""Mixing sources to target weights: hierarchical budgeting over a tree such as domain, language, source.

Tokens are counted per leaf. The budget flows down the tree: siblings share their parent's budget by weight, and what a sibling
can't supply (its tokens times the most epochs) is shared among the others by weight, so a shortage leaves a parent only when all
its children are exhausted. Each leaf then takes whole seeded epochs and a token-prefix of one more, in the order of
MD5(seed:epoch:id). A leaf's prefix is found by two rounds of 256 grouped buckets and a window over what one 65,536th of the leaf
holds, so no task gets a whole leaf. DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Defaults of `mix`: a document is used at most MAX_EPOCHS times; the budget is this share of the tokens at hand.
SEED, MAX_EPOCHS, BUDGET_SHARE = 7, 3, 0.5
#: Weight among siblings, by level and name; others have 1.
WEIGHTS: Mapping[str, Mapping[str, int]] = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
#: The nodes' key columns while budgets are computed.
NODE = "node_"
#: Budgets are doubles; one that should be a whole number may fall short of it by a rounding error.
ROUNDING = 1e-6


def words(text: Column) -> Column:
    """Number of words, maximal runs without ASCII white space; null: 0."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, "[ \t-\r]+"))).cast("long")


def weight_of(level: str, name: Column, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(None).cast("int")
    for value, w in weights.get(level, {}).items():
        out = F.when(name == value, F.lit(int(w))).otherwise(out)
    return F.coalesce(out, F.lit(1)).cast("double")


def shared_out(nodes: DataFrame, parents: list[str], me: str) -> DataFrame:
    """Adds `budget` to siblings that have parent_budget, weight and capacity: the smaller of capacity and level * weight, with one
    level per family such that the budgets sum to the parent's (or every capacity is used)."""
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    by_need = family.orderBy(F.col("capacity") / F.col("weight"), F.col(me))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(0, Window.unboundedFollowing)
    out = nodes.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0.0))).withColumn("left_weight", F.sum("weight").over(onward))
    out = out.withColumn("full", F.col("parent_budget") - F.col("used") >= F.col("left_weight") * (F.col("capacity") / F.col("weight")))
    out = out.withColumn("full_capacity", F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(family), F.lit(0.0)))
    out = out.withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(family))
    level = (F.col("parent_budget") - F.col("full_capacity")) / F.col("open_weight")
    return out.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(level * F.col("weight"))).drop(
        "used", "left_weight", "full", "full_capacity", "open_weight"
    )


def budgets(leaves: DataFrame, levels: list[str], weights, max_epochs: int, budget_tokens: int | None, budget_share: float) -> DataFrame:
    """Leaves (columns node_0.., tokens) with `target`, the whole tokens budgeted to each."""
    keys = [f"{NODE}{i}" for i in range(len(levels))]
    at_hand = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]  # one number
    root = float(min(budget_tokens if budget_tokens is not None else math.floor(at_hand * budget_share), at_hand * max_epochs))
    above = None
    for i, level in enumerate(levels):
        nodes = leaves.groupBy(*keys[: i + 1]).agg((F.sum("tokens") * F.lit(float(max_epochs))).alias("capacity")).where("capacity > 0")
        nodes = nodes.withColumn("weight", weight_of(level, F.col(keys[i]), weights))
        if above is None:
            nodes = nodes.withColumn("parent_budget", F.lit(root))
        else:
            nodes = nodes.join(above.withColumnRenamed("budget", "parent_budget"), keys[:i])
        above = shared_out(nodes, keys[:i], keys[i]).select(*keys[: i + 1], "budget")
    return leaves.join(above, keys, "left").select(*keys, "tokens", F.floor(F.coalesce("budget", F.lit(0.0)) + ROUNDING).cast("long").alias("target"))


def prefix_cuts(rows: DataFrame, keys: list[str], key: Column, target: Column) -> DataFrame:
    """Per leaf the greatest order key within the token-prefix (null: nothing). rows: the leaf's keys, ident, n_tokens, and what
    `target` and `key` use. Rows with one order key stand or fall together."""
    cols = [*keys, "want", "order_key", "n_tokens"]
    rest = rows.select(*keys, target.alias("want"), key.alias("order_key"), "n_tokens")
    for first in (1, 3):
        bucket = F.substring("order_key", first, 2)
        sums = rest.groupBy(*keys, "want", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        # At most 256 buckets in a leaf. The prefix ends in the first bucket that would exceed what is wanted.
        edge = sums.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") > F.col("want"))
        edge = edge.groupBy(*keys).agg(F.min(F.struct("bucket", (F.col("want") - F.col("upto") + F.col("n")).alias("still"))).alias("edge"))
        edge = cut(edge.select(*keys, F.col("edge.bucket").alias("edge_bucket"), F.col("edge.still").alias("still")))
        rest = rest.join(small(edge), keys).where(bucket == F.col("edge_bucket")).drop("want", "edge_bucket").withColumnRenamed("still", "want").select(*cols)
        rows_edge = edge.select(*keys, F.col("edge_bucket").alias(f"bucket_{first}"))
        found = rows_edge if first == 1 else found.join(rows_edge, keys, "left")
    sums = rest.groupBy(*keys, "want", "order_key").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy(*keys).orderBy("order_key").rowsBetween(Window.unboundedPreceding, 0)
    last = sums.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") <= F.col("want")).groupBy(*keys).agg(F.max("order_key").alias("last_key"))
    # Keys below the edge's own buckets are within the prefix; the cut is exclusive there.
    return found.join(last, keys, "left").select(
        *keys,
        F.coalesce(F.concat("last_key", F.lit("~")), F.concat("bucket_1", F.coalesce("bucket_3", F.lit("")))).alias("cut_key"),
    )


def order_key(ident: Column, seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), ident).cast("binary"))


def mix(
    df: DataFrame,
    levels: Mapping[str, Column],
    id_col: str = "doc_id",
    tokens: Column | None = None,
    text_col: str = "text",
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    budget_tokens: int | None = None,
    budget_share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    carry: list[str] | None = None,
) -> DataFrame:
    """The chosen rows, once per epoch in which they are chosen: the columns of `carry` (all by default), mix_epoch and mix_tokens.

    levels: tree levels from the root, name to column; null and the empty string are one node. A leaf's last row is the one before
    the row that would exceed its budget. Rows without tokens cost nothing and go with their place in the order; ids are compared
    as text and null is the empty text; repeated ids stand or fall together. Budgets beyond max_epochs times the tokens at hand are
    cut to that. Empty tables give empty results.
    """
    names = list(levels)
    keys = [f"{NODE}{i}" for i in range(len(names))]
    out_cols = [c for c in (df.columns if carry is None else carry) if c.lower() not in ("mix_epoch", "mix_tokens")]
    count = words(F.col(text_col)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    node = [F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in zip(keys, levels.values(), strict=True)]
    slim = cut(df.select(*node, ident.alias("ident"), count.alias("n_tokens")))
    leaves = cut(slim.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")))
    plan = budgets(leaves, names, weights, max_epochs, budget_tokens, budget_share)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    plan = cut(plan.withColumn("full_epochs", F.least(whole, F.lit(max_epochs))).withColumn("part_target", F.col("target") - F.col("full_epochs") * F.col("tokens")))
    rows = slim.join(small(plan.select(*keys, "full_epochs", "part_target")), keys).where(F.col("full_epochs") < max_epochs)
    cuts = prefix_cuts(rows, keys, order_key(F.col("ident"), seed, F.col("full_epochs")), F.col("part_target"))
    plan = cut(plan.join(cuts, keys, "left").select(*[F.col(k).alias(f"leaf_{k}") for k in keys], "full_epochs", "cut_key"))
    base = df.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(out_cols)], *node, ident.alias("ident"), count.alias("mix_tokens"))
    joined = base.join(small(plan), [F.col(k) == F.col(f"leaf_{k}") for k in keys])
    in_part = (F.col("full_epochs") < max_epochs) & (order_key(F.col("ident"), seed, F.col("full_epochs")) < F.col("cut_key"))
    epochs = F.col("full_epochs") + F.coalesce(in_part, F.lit(False)).cast("int")
    return (
        joined.withColumn("epochs", epochs)
        .where("epochs > 0")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("mix_epoch"))
        .select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(out_cols)], "mix_epoch", "mix_tokens")
    )
