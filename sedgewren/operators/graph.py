"""Graphs of factors: components, clusters, representatives, identity between clusterings."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sedgewren-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component, by min-label propagation with pointer jumping. nodes: node; edges: a, b."""
    both = shared_checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = shared_checkpoint(nodes.select("node").distinct().withColumn("root", F.col("node")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("next"), "root")
        up = step.select(F.col("node").alias("next"), F.col("next").alias("above"))
        jumped = shared_checkpoint(step.join(up, "next", "left").select("node", F.least("next", F.coalesce("above", "next")).alias("new"), "root"))
        changed = jumped.where("new != root").limit(1).count()
        labels = jumped.select("node", F.col("new").alias("root"))
        if not changed:
            return labels


def representatives(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Per component its size and best member by score, the smallest node of equal ones. scores: node, score."""
    ranked = labels.join(scores, "node").withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy(F.col("score").desc_nulls_last(), "node")))
    size = labels.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return ranked.where("nth = 1").join(size, "root").select("root", F.col("node").alias("representative"), "score", "size")


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k strongest edges. edges: a, b, w."""
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    w = Window.partitionBy("a").orderBy(F.col("w").desc(), "b")
    return both.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def strongest_between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Strongest edge of each pair of different components."""
    x = edges.join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra != rb")
    return x.groupBy(F.least("ra", "rb").alias("r1"), F.greatest("ra", "rb").alias("r2")).agg(F.max("w").alias("w"))


def cluster_overlap(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of clusters (member, cluster) with Jaccard overlap of at least `least`: members meet by an equi-join and are counted."""
    a, b = old.select("member", F.col("cluster").alias("old")), new.select("member", F.col("cluster").alias("new"))
    na, nb = a.groupBy("old").agg(F.count(F.lit(1)).alias("n_old")), b.groupBy("new").agg(F.count(F.lit(1)).alias("n_new"))
    common = a.join(b, "member").groupBy("old", "new").agg(F.count(F.lit(1)).alias("common"))
    scored = common.join(na, "old").join(nb, "new").withColumn("jaccard", F.col("common") / (F.col("n_old") + F.col("n_new") - F.col("common")))
    return scored.where(F.col("jaccard") >= least).select("old", "new", "common", "jaccard")


def novel(candidates: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Nodes that are accepted when candidates are taken best first and none may conflict with an accepted one. candidates: node, score;
    conflicts: a, b (pairs whose dependency reaches its threshold, in any order); equal scores go by node.

    The order is kept without a loop over candidates: a round accepts all whose better neighbours are all refused, and refuses the
    neighbours of those. Rounds are as many as the longest chain of such decisions."""
    order = F.struct((-F.col("score")).alias("score"), "node")
    open_ = shared_checkpoint(candidates.select("node", order.alias("place")).distinct())
    both = conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    edges = both.join(open_.select(F.col("node").alias("a"), F.col("place").alias("at")), "a").join(open_.select(F.col("node").alias("b"), F.col("place").alias("above")), "b")
    edges = shared_checkpoint(edges.where("above < at").select("a", "b"))  # b is better than a
    accepted = None
    while True:
        waiting = edges.select(F.col("a").alias("node")).distinct()
        now = shared_checkpoint(open_.join(waiting, "node", "left_anti").select("node"))
        accepted = now if accepted is None else shared_checkpoint(accepted.unionByName(now))
        refused = edges.join(now.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")).distinct()
        done = shared_checkpoint(now.unionByName(refused))
        open_ = shared_checkpoint(open_.join(done, "node", "left_anti"))
        gone = done.withColumnRenamed("node", "a")
        edges = shared_checkpoint(edges.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti"))
        if open_.isEmpty():
            return accepted


def region_identity(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """What became of clusters: each new one with its event and the old one that it continues. old and new: member, cluster.

    unchanged: an old one with the same members; membership_changed: the only overlap on both sides, Jaccard of `least` or more; merged:
    several old ones; split: one old one that several overlap; reclustered: any other overlap; new: none."""
    a, b = old.select("member", F.col("cluster").alias("o")), new.select("member", F.col("cluster").alias("c"))
    n_old, n_new = a.groupBy("o").agg(F.count(F.lit(1)).alias("n_old")), b.groupBy("c").agg(F.count(F.lit(1)).alias("n_new"))
    both = a.join(b, "member").groupBy("o", "c").agg(F.count(F.lit(1)).alias("k")).join(n_old, "o").join(n_new, "c")
    both = both.withColumn("olds", F.count(F.lit(1)).over(Window.partitionBy("c"))).withColumn("news", F.count(F.lit(1)).over(Window.partitionBy("o")))
    same = (F.col("k") == F.col("n_old")) & (F.col("k") == F.col("n_new"))
    alike = (F.col("olds") == 1) & (F.col("news") == 1) & (F.col("k") / (F.col("n_old") + F.col("n_new") - F.col("k")) >= least)
    event = F.when(same, "unchanged").when(alike, "membership_changed").when(F.col("olds") > 1, "merged").when(F.col("news") > 1, "split").otherwise("reclustered")
    per = both.withColumn("event", event).groupBy("c").agg(F.min("event").alias("some"), F.max(F.when(F.col("event").isin("unchanged", "membership_changed"), F.struct("o", "event"))).alias("kept"))
    out = n_new.select("c").join(per, "c", "left")
    return out.select(F.col("c").alias("cluster"), F.coalesce("kept.event", "some", F.lit("new")).alias("event"), F.col("kept.o").alias("continues"))


def recommended(labels: DataFrame, scores: DataFrame, singles: int = 8, best: int = 12) -> DataFrame:
    """Feature sets: the first one, two and three of each family with several members and the best `singles` of the others, and the best
    `best` of all. labels: node, root; scores: node, score."""
    order = [F.col("score").desc_nulls_last(), F.col("node")]
    df = labels.join(scores, "node").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("root"))).withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy(*order)))
    family, alone = df.where("size > 1"), df.where("size = 1").orderBy(*order).limit(singles).select("node")
    sets = [family.where(F.col("nth") <= k).select("node").unionByName(alone).withColumn("feature_set", F.lit(f"family_top{k}")) for k in (1, 2, 3)]
    top = df.orderBy(*order).limit(best).select("node").withColumn("feature_set", F.lit(f"quality_top{best}"))
    return sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(top)


def complete_linkage(nodes: DataFrame, distances: DataFrame, most: float) -> DataFrame:
    """node and cluster (its smallest node): hierarchical clustering by complete linkage, cut at the distance `most`. nodes: node;
    distances: a, b, d (each pair once); a pair without a distance is never put together.

    Clusters that are each other's nearest merge in one round; complete linkage never brings others nearer by that, so this is the same
    as merging the nearest pair at a time, in rounds over the pair table. Equal distances go by the smaller nodes."""
    labels = shared_checkpoint(nodes.select("node").distinct().withColumn("cluster", F.col("node")))
    pairs = distances.where(F.col("a") != F.col("b")).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("d"), F.lit(1).cast("long").alias("n"))
    pairs = shared_checkpoint(pairs)
    sizes = shared_checkpoint(labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))
    while True:
        sized = pairs.join(sizes.withColumnsRenamed({"cluster": "a", "size": "size_a"}), "a").join(sizes.withColumnsRenamed({"cluster": "b", "size": "size_b"}), "b")
        whole = sized.where((F.col("n") == F.col("size_a") * F.col("size_b")) & (F.col("d") <= most)).select("a", "b", "d")
        ends = whole.select("a", "b", F.col("a").alias("end"), "d").unionByName(whole.select("a", "b", F.col("b").alias("end"), "d"))
        nearest = ends.groupBy("end").agg(F.min(F.struct("d", "a", "b")).alias("p"))
        merging = shared_checkpoint(nearest.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("a", "b"))
        if merging.isEmpty():
            return labels
        to = merging.select(F.col("b").alias("gone"), F.col("a").alias("into"))
        move = lambda df, c: df.join(to.withColumnRenamed("gone", c), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
        labels = shared_checkpoint(move(labels, "cluster").select("node", "cluster"))
        sizes = shared_checkpoint(labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))
        moved = move(move(pairs, "a"), "b").where("a != b")
        pairs = shared_checkpoint(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("d"), F.sum("n").alias("n")))
