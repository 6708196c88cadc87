"""Near copies: texts that share most of their shingles, found by covering SimHash tables and completed by an exact join.

1. Fingerprints of the texts' shingles meet in the covering tables of `simhash`; texts whose fingerprints are at most its radius apart
   are candidates. This finds most copies of large groups with a few short rows a text.
2. No radius of a SimHash stands for a similarity: at 0.8 about 15 % of the bits differ, more in short texts. So all sets of shingles
   also meet by prefixes: in one order, shingles that are common in a sample last, two sets with a similarity of t or more share one
   of the first n - ceil(t * n) + 1 of each (n its size), and where they share their first one, enough are left in both to reach the
   overlap that t needs. A bucket's members are compared with the most typical one of about their size, then, as far as components
   still differ, with each other, large buckets as pairs of blocks.
3. Whatever meets is compared in full, by the sets of both whole texts, and linked at the similarity or more.

So no pair at the similarity or more is missed and none below is linked; the order and the tables change the work, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import WRITTEN, cut, remove, small, written
from .simhash import SEED, components

#: Defaults: words in a shingle and least similarity (shared shingles among all of two texts).
SHINGLE, SIMILARITY = 5, 0.8
#: One text of so many is counted for the order, and so many of the commonest shingles are kept.
SAMPLE, COMMON = 16, 100_000
#: Rows of one shingle, as the sample tells, that are dealt to one task; more are salted.
SALT_ROWS = 100_000
#: Ratio of the largest to the smallest size of a scale.
SCALE = 1.6
#: Members of a bucket that are compared at once.
GROUP = 2048
#: Texts that are compared with one copy of a hub's.
HUB_ROWS = 1024
#: Keeps a product that should be a whole number from being rounded up.
EPS = 1e-9


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the different shingles; words are split and lower-cased in ASCII only. Texts without words share one hash."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = set(map(b" ".join, zip(*(words[i:] for i in range(size))))) if len(words) >= size else {b" ".join(words)}
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(s, SEED) for s in shingles), np.uint64, len(shingles)).view(np.int64))


def common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the commonest shingles of a sample (at most COMMON reach the driver), sorted, and their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), size))], names=["h"])

    hashes = texts.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(work, "h long")
    got = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    hashes, counts = (got.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefixes(texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """h, node, n, pos and salt: the first shingles of each text's set, the set's size, their places in the order, and for shingles with
    many rows a share of them from 1 up."""
    hashes, counts = common(texts, size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [[np.empty(0, np.int64)] * 5]
            for node, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values = shingle_set(text.as_py(), size)
                ranks = np.zeros(len(values), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
                    ranks = np.where(hashes[at] == values, counts[at], 0)
                k = len(values) - math.ceil(similarity * len(values) - EPS) + 1
                first = np.argsort(ranks, kind="stable")[:k]
                salts = ranks[first] * SAMPLE // SALT_ROWS
                salt = np.where(salts > 0, 1 + node % np.maximum(salts, 1), 0)
                parts.append([values[first], np.full(k, node), np.full(k, len(values)), np.arange(k), salt])
            columns = [np.concatenate(x) for x in zip(*parts)]
            kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, kinds, strict=True)], names=["h", "node", "n", "pos", "salt"])

    return texts.select("node", "text").mapInArrow(work, "h long, node long, n int, pos int, salt int")


def shared_prefixes(texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """h, node, n and pos of the prefix shingles that more than one text may have. Most occur once and are never shuffled again."""
    alike = F.count(F.lit(1)).over(Window.partitionBy("h", "salt"))
    return prefixes(texts, similarity, size).withColumn("alike", alike).where("alike > 1 OR salt > 0").select("h", "node", "n", "pos")


def can_reach(a: Column, b: Column, similarity: float) -> Column:
    """Whether two members (n, pos) that share their first shingle here may have the overlap that the similarity needs."""
    need = F.ceil((a["n"] + b["n"]) * F.lit(similarity / (1 + similarity)) - EPS)
    return F.least(a["n"] - a["pos"], b["n"] - b["pos"]) >= need


def met(bucket: np.ndarray, root: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of members of one bucket and different components that may be similar enough. Buckets lie together, sorted by n."""
    found, at, step = [np.empty((0, 2), np.int64)], np.arange(len(bucket)), 0
    while len(at):
        step += 1
        at = at[: np.searchsorted(at, len(bucket) - step)]
        to = at + step
        at = at[(bucket[at] == bucket[to]) & (n[at] >= similarity * n[to] - EPS)]
        to = at + step
        need = np.ceil((n[at] + n[to]) * (similarity / (1 + similarity)) - EPS)
        near = (root[at] != root[to]) & (np.minimum(n[at] - pos[at], n[to] - pos[to]) >= need)
        found.append(np.column_stack([node[at[near]], node[to[near]]]))
    pairs = np.sort(np.concatenate(found), axis=1)
    return np.unique(pairs, axis=0)


def met_in_buckets(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of `met` for members bucket, root, node, n, pos: a partition's buckets lie sorted, the last one is held."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def pairs(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            found = met(*[np.concatenate(x) for x in zip(*parts)], similarity)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            now = [c.to_numpy().astype(np.int64) for c in b.columns]
            if held and held[-1][0][-1] != now[0][0]:
                yield pairs(held)
                held = []
            others = np.flatnonzero(now[0] != now[0][-1])
            last = others[-1] + 1 if len(others) else 0
            if last:
                yield pairs([*held, [x[:last] for x in now]])
                held = []
            held.append([x[last:] for x in now])
        if held:
            yield pairs(held)

    dealt = members.select("bucket", "root", "node", "n", "pos").repartition("bucket").sortWithinPartitions("bucket", "n")
    return dealt.mapInArrow(work, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs a, b whose whole texts are as similar.

    A pair is dealt to the one of its texts with more pairs, its hub. The other text is sent once a pair, the hub's once for HUB_ROWS of
    them, ahead of them: a hub of a million pairs is neither sent a million times nor one task's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, values = None, np.empty(0, np.int64)
        for batch in batches:
            found = []
            for one, other, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = shingle_set(text.as_py(), size)
                if other is None:
                    hub, values = one, own
                    continue
                assert hub == one
                both = len(np.intersect1d(values, own, assume_unique=True))
                if both / (len(values) + len(own) - both) >= similarity:
                    found.append((min(one, other), max(one, other)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    pairs = cut(pairs.distinct())
    degree = cut(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).groupBy("wanted").agg(F.count(F.lit(1)).alias("k")))
    asked = texts.join(small(degree.select("wanted")), F.col("node") == F.col("wanted"), "left_semi")
    of = [degree.select(F.col("wanted").alias(c), F.col("k").alias(f"k_{c}")) for c in "ab"]
    first = F.col("k_a") >= F.col("k_b")
    split = F.pmod(F.xxhash64("other"), F.ceil(F.greatest("k_a", "k_b") / HUB_ROWS)).cast("int")
    dealt = pairs.join(of[0], "a").join(of[1], "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), "k_a", "k_b")
    dealt = cut(dealt.select("hub", split.alias("split"), "other"))
    sent = dealt.join(asked, F.col("node") == F.col("other")).select("hub", "split", "other", "text")
    ahead = dealt.select("hub", "split").distinct().join(asked, F.col("node") == F.col("hub")).select("hub", "split", F.lit(None).cast("long").alias("other"), "text")
    both = sent.unionByName(ahead).repartition("hub", "split").sortWithinPartitions("hub", "split", F.col("other").asc_nulls_first())
    return cut(both.mapInArrow(work, "a long, b long"))


def covered(rows: DataFrame) -> DataFrame:
    """Pairs a, b of nodes that the covering tables link: each text with the first of its fingerprint, and those with each other."""
    owners = cut(rows.groupBy("fp").agg(F.min("node").alias("owner")))
    same = rows.select("fp", "node").join(owners, "fp").where("node != owner").select(F.col("owner").alias("a"), F.col("node").alias("b"))
    edges = cut(simhash.links(owners.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")))
    one, other = (owners.select(F.col("fp").alias(f"of_{c}"), F.col("owner").alias(c)) for c in "ab")
    apart = edges.join(one, F.col("fp_a") == F.col("of_a")).join(other, F.col("fp_b") == F.col("of_b"))
    return same.unionByName(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def starred(shared: DataFrame, similarity: float, shift: float) -> DataFrame:
    """Pairs a, b of each member of a bucket with the most typical one of about its size: the one with the fewest shingles rarer than
    the bucket's. In a group of near copies that is the text that they were made from, or nearly, so one such pair each links most."""
    rows = shared.withColumn("scale", F.floor(F.log(F.col("n").cast("double")) / math.log(SCALE) + shift).cast("int"))
    hubs = rows.groupBy(F.col("h").alias("of"), F.col("scale").alias("at")).agg(F.min(F.struct("pos", "node", "n")).alias("hub"), F.count(F.lit(1)).alias("k"))
    hubs = written(hubs.where("k > 1").drop("k"))
    found = rows.join(hubs, (F.col("h") == F.col("of")) & (F.col("scale") == F.col("at"))).where("node != hub.node")
    found = found.where(can_reach(F.struct("n", "pos"), F.col("hub"), similarity))
    return found.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))


def links(rows: DataFrame, similarity: float, size: int, group: int = GROUP) -> DataFrame:
    """Edges a, b between nodes (columns node, text, fp) whose components are those of all similar pairs."""
    texts = rows.select("node", "text")
    shared = written(shared_prefixes(texts, similarity, size))
    own_tables = len(WRITTEN) - 1  # from here on; each is removed when what was read from it is cut
    # Sizes are dealt to scales in two ways, half a scale apart, so that similar texts are of one scale in one of them.
    pairs = covered(rows).unionByName(starred(shared, similarity, 0.0)).unionByName(starred(shared, similarity, 0.5))
    edges = verified(pairs, texts, similarity, size)
    remove(rows.sparkSession, WRITTEN[own_tables + 1 :])
    roots = cut(components(edges).withColumnRenamed("node", "key"))
    members = written(shared.join(roots, F.col("node") == F.col("key"), "left").select("h", F.coalesce("root", "node").alias("root"), "node", "n", "pos"))
    remove(rows.sparkSession, [WRITTEN[own_tables]])
    mixed = members.groupBy(F.col("h").alias("of")).agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("least"), F.max("root").alias("most"))
    blocks = F.when(F.col("members") > group, F.ceil(F.col("members") / max(1, group // 2))).otherwise(1).cast("int")
    mixed = cut(mixed.where("least < most").select("of", blocks.alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(mixed, F.col("h") == F.col("of")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A hash names the pair of blocks; pairs that share one by chance only cost comparisons.
    keyed = dealt.select(F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "root", "node", "n", "pos")
    more = verified(met_in_buckets(keyed, similarity), texts, similarity, size)
    remove(rows.sparkSession, WRITTEN[own_tables:])
    return edges.unionByName(more)


def near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, carry: list[str] | None = None
) -> DataFrame:
    """The columns of `carry` (all but the text by default), component_id and kept for every row.

    Rows are linked if their sets of shingles have a Jaccard similarity of `similarity` or more, compared in full. component_id is the
    smallest id among rows that can be reached over links, the row itself included; null ids count for nothing, and a component with
    none has null. One row of each component is kept: one with that id, any if none has one. Texts without words (null, empty) are
    linked to each other. Result columns replace input columns of the same name. The rows are written once to the shared folder.
    """
    keep = [c for c in (df.columns if carry is None else carry) if c.lower() not in ("component_id", "kept") and (carry is not None or c != text_col)]
    place = {c: "text" if c == text_col else f"in_{i}" for i, c in enumerate(keep)}
    taken = df.select(
        *[F.col(c).alias(x) for c, x in place.items() if x != "text"], F.col(id_col).alias("ident"), F.monotonically_increasing_id().alias("node"), F.col(text_col).alias("text")
    )
    rows = written(simhash.with_fingerprint(taken, "text", "fp", size))
    roots = cut(components(links(rows.select("node", "text", "fp"), similarity, size)).withColumnRenamed("node", "key"))
    linked = rows.select("node", "ident").join(roots, F.col("node") == F.col("key")).select("key", "root", "ident")
    first = F.min(F.struct(F.col("ident").isNull().alias("no"), "ident", "key")).alias("first")
    named = cut(linked.join(linked.groupBy(F.col("root").alias("of")).agg(first), F.col("root") == F.col("of")).select("key", "first"))
    out = rows.drop("fp").join(small(named), F.col("node") == F.col("key"), "left")
    alone = F.col("key").isNull()
    return out.select(
        *[F.col(x).alias(c) for c, x in place.items()],
        F.when(alone, F.col("ident")).otherwise(F.col("first.ident")).alias("component_id"),
        (alone | (F.col("node") == F.col("first.key"))).alias("kept"),
    )
