"""The trie of conversations' prefixes by prefix doubling.

Turns are named by dense numbers of their (role, text). A block of 2^k turns is named by the pair of names of its halves, for all
conversations at once and a level a round; only blocks whose place is a multiple of their length are named. A prefix of d turns is the
blocks of d's binary digits, longest first: prefixes with one digit are blocks, and those with r digits are named in round r by the
pair (prefix without the last digit's block, that block). A prefix is named by its smallest conversation. So there are as many rounds as
the longest conversation has binary digits, each a grouping and an equi-join of short rows, whatever the conversations look like.

Sums over subtrees need no walk: a node belongs to the smallest of its conversations, a conversation's own nodes are the deepest ones of
its path, and the sum over a node's subtree is the sum, over the conversations that pass it, of what they own from there on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import dense_names, positions, running
from .common import WRITTEN, remove, written

#: Bytes of ids that go to one row on their way to the hash.
CHUNK = 1 << 15


def opening(conv: Column, most: int) -> Column:
    """How many turns a conversation borrows: CRC-32 of its decimal id, modulo most."""
    return F.crc32(conv.cast("string").cast("binary")) % most


def turns_in_order(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, pos (from 1), sha, n_bytes: turns by `turn` (null first), equal ones by the SHA-256 of role and text."""
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("sha"), F.octet_length(t).cast("long").alias("n_bytes"))
    return positions(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("sha")], "pos").select("conv", F.col("pos").cast("int").alias("pos"), "sha", "n_bytes")


def rebuilt(turns: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, pos, sha, n_bytes) and conversations (conv, length): the first h turns of the group's first conversation, then the
    conversation's own turns after its first h."""
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).cast("int").alias("own"))
    convs = lengths.select("conv", "own", opening(F.col("conv"), most).cast("int").alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    first = lengths.select(F.col("conv").alias("base"), F.col("own").alias("first_own"))
    convs = written(convs.join(first, "base", "left").withColumn("lent", F.least("h", F.coalesce("first_own", F.lit(0)))).select("conv", "own", "h", "base", "lent"))
    lent = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base").join(convs.select("conv", "h", "base"), "base").where("pos <= h")
    own = turns.join(convs.select("conv", "h", "lent"), "conv").where("pos > h").withColumn("pos", F.expr("pos - h + lent"))
    out = lent.select("conv", "pos", "sha", "n_bytes").unionByName(own.select("conv", "pos", "sha", "n_bytes"))
    return written(out), convs.select("conv", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def named(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df with the dense name of its keys in place of them. Names are written, so both sides of the join are dealt anew and hot keys split."""
    names = written(dense_names(df.select(*keys).distinct(), rows))
    return df.join(names, keys).drop(*keys)


def blocks_of(turns: DataFrame, longest: int, rows: int) -> list[DataFrame]:
    """(conv, place, name) of every whole block at each level."""
    levels = [written(named(turns.select("conv", (F.col("pos") - 1).alias("place"), "sha"), ["sha"], rows))]
    while 2 << (len(levels) - 1) <= longest:
        half = F.col("place") % 2 == 0
        pairs = levels[-1].groupBy("conv", F.expr("place div 2").cast("int").alias("place")).agg(F.max(F.when(half, F.col("name"))).alias("first"), F.max(F.when(~half, F.col("name"))).alias("second"))
        levels.append(written(named(pairs.where("second IS NOT NULL"), ["first", "second"], rows)))
    return levels


def prefixes(levels: list[DataFrame]) -> DataFrame:
    """(conv, depth, node): for each conversation and depth from 1, the smallest conversation with that prefix."""
    # Depth d ends with the block of its lowest binary digit, whose place is even.
    ends = None
    for k, blocks in enumerate(levels):
        part = blocks.where("place % 2 = 0").select("conv", ((F.col("place") + 1) * (1 << k)).alias("depth"), F.lit(1 << k).alias("low"), "name")
        ends = part if ends is None else ends.unionByName(part)
    digits, done, found = F.bit_count("depth"), None, []
    for r in range(1, len(levels) + 1):
        now = ends.where(digits == r)
        if done is None:
            now = now.withColumn("head", F.lit(-1).cast("long"))
        else:
            rest = done.select("conv", F.col("depth").alias("rest"), F.col("node").alias("head"))
            now = now.withColumn("rest", F.col("depth") - F.col("low")).join(rest, ["conv", "rest"])
        now = written(now.select("conv", "depth", "head", "name"))
        least = written(now.groupBy("depth", "head", "name").agg(F.min("conv").alias("node")))
        done = written(now.join(least, ["depth", "head", "name"]).select("conv", "depth", "node"))
        found.append(done)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (node, depth, conv): the ids of a node as text, CHUNK bytes to a row, with its first id."""
    open_, first, ids, size = None, None, [], 0

    def row():
        return pa.RecordBatch.from_pylist([{"node": open_[0], "depth": open_[1], "first": first, "ids": ",".join(ids)}], schema=pa.schema([("node", pa.int64()), ("depth", pa.int32()), ("first", pa.int64()), ("ids", pa.string())]))

    for batch in batches:
        for node, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if open_ != (node, depth) or size >= CHUNK:
                if ids:
                    yield row()
                open_, first, ids, size = (node, depth), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield row()


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (node, depth, first, ids): the SHA-256 of each node's ids, comma-joined, read once and not held."""
    schema = pa.schema([("node", pa.int64()), ("depth", pa.int32()), ("ends_sha256", pa.string())])
    open_, state, out = None, None, []
    for batch in batches:
        for node, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if open_ != (node, depth):
                if open_ is not None:
                    out.append((*open_, state.hexdigest()))
                open_, state = (node, depth), hashlib.sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out = []
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*open_, state.hexdigest()), schema.types, strict=True)], schema=schema)


def ends_of(paths: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of nodes where conversations end: ids are joined to chunks range by range, then hashed chunk by chunk."""
    order = ["node", "depth", "conv"]
    ended = paths.where("depth = length").select(*order)
    parts = ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "node long, depth int, first long, ids string")
    return parts.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(hashed, "node long, depth int, ends_sha256 string")


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 5, most: int = 9) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Conversation c is the first h turns of conversation c - c % group (all if fewer, none if absent) and its own turns after its first h, with
    h = crc32(c) % most. The root is every conversation's prefix of depth 0, those without turns included; without conversations there is
    no node. A null role or text is empty; turns without a conversation id belong to none. Turns go by `turn`, null first, equal ones by
    the SHA-256 of role and text; repeated rows are turns each. Intermediate tables are removed.
    """
    since = set(WRITTEN)
    turns, convs = rebuilt(written(turns_in_order(df, conv, turn, role, text)), group, most)
    rows, longest = turns.count(), convs.agg(F.max("length")).first()[0] or 0
    root = convs.select("conv", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("node"))
    least = convs.agg(F.min("conv").alias("least"))  # one row
    root = root.join(F.broadcast(least)).select("conv", "depth", F.col("least").alias("node"))
    paths = root.unionByName(prefixes(blocks_of(turns, longest, rows))) if longest else root
    paths = written(paths)
    above = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    last = turns.select("conv", F.col("pos").alias("depth"), "n_bytes")
    paths = written(paths.join(convs, "conv").join(above, ["conv", "depth"], "left").join(last, ["conv", "depth"], "left"))
    nodes = paths.groupBy("depth", "node").agg(F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("deepest"))
    # A node's row on the path of its own conversation has its parent and its last text.
    nodes = written(nodes.join(paths.select(F.col("conv").alias("node"), "depth", "parent", "n_bytes"), ["node", "depth"]))
    owned = nodes.select(F.col("node").alias("conv"), "depth", (F.col("deepest") == F.col("depth")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.coalesce("n_bytes", F.lit(0))).alias("saved"))
    sums = running(paths.select("conv", "depth", "node").join(owned, ["conv", "depth"], "left"), ["conv"], [F.col("depth").desc()], {"leaf": F.col("leaf"), "saved": F.col("saved")})
    below = sums.groupBy("depth", "node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    out = nodes.join(below, ["depth", "node"]).join(children, ["depth", "node"], "left").join(ends_of(paths), ["depth", "node"], "left")
    none = hashlib.sha256(b"").hexdigest()
    out = out.select(
        F.col("node").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    out = written(out)
    keep = WRITTEN[-1]
    remove(df.sparkSession, [x for x in WRITTEN if x not in since and x != keep])
    return out


def crc(conv: int) -> int:
    """The checksum that `opening` takes, for tests."""
    return zlib.crc32(str(conv).encode())
