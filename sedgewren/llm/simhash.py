"""SimHash near-dedup with covering locality-sensitive hashing.

Texts become 64-bit fingerprints; only distinct fingerprints are compared. With radius r there are 2^(r+1) - 1 tables, each with a
mask: bit i has a non-zero vector v(i) of r+1 bits, and table a keeps the bits with a.v(i) odd. Any r bits span less than the whole
space, so some table a is orthogonal to all of them: two fingerprints that differ in at most r bits agree under that table's mask.
Buckets of up to GROUP fingerprints are searched from member to member and give a spanning forest, never all pairs. Those in larger
buckets meet through every value at r/2 bits from them: two fingerprints at most r apart share such a value, and all that share one
are at most r apart, so each value links them in a star. Both ways are exact. Components then come from alternating large-star and
small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name

BITS, SEED = 64, 42
#: Defaults: words in a shingle and largest number of differing bits.
SHINGLE, RADIUS = 3, 2
#: Buckets with more fingerprints are not gathered.
GROUP = 2048
#: Shingles hashed at a time, so that a very long text needs little memory.
BLOCK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is set if it is in more than half of the shingles' XXH64; a text without words has 0. Unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both act on ASCII only
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + min(BLOCK, n - at) + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)))) if len(part) >= size else [b" ".join(part)]
        hashes = np.fromiter((hashed(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text_col: str, name: str, size: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """The columns of carry and the fingerprint as a long."""
    keep = df.columns if carry is None else carry
    text = free_name(df, "fingerprint_text")
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(name, T.LongType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(x.as_py(), size) for x in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints.view(np.int64))], names=[*b.schema.names[:-1], name])

    return df.select(*keep, F.col(text_col).alias(text)).mapInArrow(fill, schema)


def masks(radius: int) -> list[int]:
    """The covering masks as signed 64-bit integers."""
    # Every mask keeps about half of the bits: the vectors are all non-zero ones in turn, or the columns of a Reed-Muller code.
    if radius > 6:
        raise ValueError("with more than 7 bits a vector, some masks would keep too few of 64 bits")
    vectors = [BITS | i for i in range(BITS)] if radius == 6 else [i % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    made = [sum(1 << i for i, v in enumerate(vectors) if (a & v).bit_count() % 2) for a in range(1, 2 ** (radius + 1))]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in made]


def ball(radius: int) -> list[int]:
    """All signed 64-bit integers with at most `radius` bits set."""
    made = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in made]


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Edges from one member of each component to the others, in memory that grows with the members only."""
    left, edges = fps, []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        open_ = [seed]
        while open_ and len(left):
            near = np.bitwise_count((left ^ open_.pop()).view(np.uint64)) <= radius
            if near.any():
                edges.append(np.column_stack([np.full(near.sum(), seed), left[near]]))
                open_ += left[near].tolist()
                left = left[~near]
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp, no repeats) whose components are those of all pairs at most `radius` apart."""
    if radius % 2:
        raise ValueError("the radius must be even: large buckets meet half-way")
    # A hash names the bucket; buckets that share one by chance only cost a comparison.
    buckets = prints.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius))])).alias("bucket"))
    sizes = cut(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = cut(buckets.join(sizes, "bucket"))
    few = shared.where(F.col("n") <= GROUP).groupBy("bucket").agg(F.collect_list("fp").alias("fps")).select("fps")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest(np.array(x, np.int64), radius) for x in batch.column(0).to_pylist()]
            both = np.concatenate([np.empty((0, 2), np.int64), *found])
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    pairs = few.mapInArrow(search, "a long, b long").distinct()
    many = shared.where(F.col("n") > GROUP).select("fp").distinct()
    around = F.array(*[F.lit(m) for m in ball(radius // 2)])
    met = many.select("fp", F.explode(around).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    least = met.groupBy("middle").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = met.join(least, "middle").where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node with an edge, from edges a, b in any order."""
    work = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        # Large star: each node's greater neighbours go to its smallest one.
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # cut, so that AQE can split a hub's edges in the join
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its smaller neighbours go to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        work = cut(small_star.where("u != v").distinct())
        # All are stars when no root is anyone's leaf and no leaf has two roots.
        state = work.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = work.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return work.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, carry: list[str] | None = None) -> DataFrame:
    """The columns of `carry` (all but the text by default), fingerprint (16 hex digits) and component_id for every row.

    component_id is the smallest id among rows whose fingerprints can be reached by steps of at most `radius` bits, the row itself
    included; null ids count for nothing, and a component with none has null. Texts without words (null, empty) have fingerprint 0
    and are linked like any other. Result columns replace input columns of the same name.
    """
    keep = [c for c in (df.columns if carry is None else carry) if c.lower() not in ("fingerprint", "component_id") and (carry is not None or c != text_col)]
    rows = df.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)], F.col(id_col).alias("ident"), F.col(text_col).alias("t"))
    rows = cut(with_fingerprint(rows, "t", "fp", size, [c for c in rows.columns if c != "t"]))
    owners = cut(rows.groupBy("fp").agg(F.min("ident").alias("owner")))
    roots = components(links(owners.select("fp"), radius))
    linked = owners.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "owner")
    least = linked.groupBy("root").agg(F.min("owner").alias("component_id"))
    merged = linked.join(least, "root").select(F.col("fp").alias("node"), "component_id")
    named = owners.join(merged, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("key"), F.when(F.col("node").isNull(), F.col("owner")).otherwise(F.col("component_id")).alias("component_id"))
    out = rows.join(cut(named), F.col("fp") == F.col("key"))
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
