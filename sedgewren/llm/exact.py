"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters and sorted, so equal texts come to lie side by side. A splitter is the
first bytes of the normalised text, its SHA-256 and the id: short whatever the text's length, and a group of copies that holds
a third of all rows is dealt over many partitions instead of one. Within a partition neighbours with equal digests are compared
in full; runs that reach a partition's edge are summed up in a table of at most two rows per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, free_name, written

#: Bytes of the normalised text in a splitter. Samples of splitters reach the driver, so they must be short: texts that are equal so
#: far are put in the order of their digests instead of the bytes that follow.
SPLITTER_BYTES = 48


def marker(n_keep: int, run_names: list[str]):
    """mapInArrow function over sorted partitions with columns [kept columns..., id, text, digest]; adds run facts, so named, to the kept ones.

    A run is a maximal stretch of equal texts. It is held until it ends, at most a partition's worth of rows, without the texts unless
    they are kept columns.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the open run
        last: tuple[bytes, bytes] | None = None  # its digest and normalised text
        part = TaskContext.get().partitionId()  # partitions are numbered in the order of their ranges
        first_run = True

        def closed(table: pa.Table, starts: np.ndarray, edge_first: bool, edge_last: bool) -> pa.RecordBatch:
            """Rows of whole runs, which begin at `starts`."""
            n = table.num_rows
            sizes = np.diff(np.append(starts, n))
            ids = table.column(n_keep).combine_chunks()
            known = np.asarray(ids.is_valid())
            low = np.iinfo(np.int64).min
            top = np.maximum.reduceat(np.asarray(ids.fill_null(low), dtype=np.int64), starts)
            has = np.logical_or.reduceat(known, starts)
            edge = np.zeros(len(starts), bool)
            if edge_first:
                edge[0] = True
            if edge_last:
                edge[-1] = True
            is_last = np.zeros(n, bool)
            is_last[starts + sizes - 1] = True
            columns = [table.column(i).combine_chunks() for i in range(n_keep)] + [
                table.column(n_keep + 1).combine_chunks(),
                pa.array(np.repeat(sizes, sizes)),
                pa.array(np.repeat(top, sizes), mask=np.repeat(~has, sizes)),
                pa.array(np.repeat(edge, sizes)),
                pa.array(is_last),
                pa.array(np.full(n, part, np.int32)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[*table.schema.names[:n_keep], *run_names])

        for batch in batches:
            if not batch.num_rows:
                continue
            digests = batch.column(n_keep + 2).to_pylist()
            texts = batch.column(n_keep + 1)
            starts = []
            for i, d in enumerate(digests):
                prior = last if i == 0 else (digests[i - 1], None)
                if prior is None or prior[0] != d:
                    starts.append(i)
                elif texts[i].as_py().lower() != (prior[1] if prior[1] is not None else texts[i - 1].as_py().lower()):
                    starts.append(i)  # neighbours are compared in full
            last = (digests[-1], texts[batch.num_rows - 1].as_py().lower())
            table = pa.Table.from_batches([batch]).remove_column(n_keep + 1)
            if not starts:
                held.append(table)
                continue
            done = [*held, table.slice(0, starts[-1])]
            lead = sum(t.num_rows for t in held)
            at = [s + lead for s in starts[:-1]]
            if lead or starts[0]:
                at = [0, *at]
            whole = pa.concat_tables(done)
            if whole.num_rows:
                yield closed(whole, np.array(sorted(set(at)), dtype=np.int64), first_run, False)
                first_run = False
            held = [table.slice(starts[-1])]
        if held:
            whole = pa.concat_tables(held)
            yield closed(whole, np.array([0]), first_run, True)

    return mark


#: What `marker` adds: digest, rows and largest id of the run, whether it reaches the partition's edge, whether the row is its last, number of the partition.
RUN_NAMES = ("run_sha256", "run_size", "run_max_id", "run_at_edge", "run_last", "run_part")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of `carry` (all by default) and keep_id, group_size, kept, text_sha256 for every row, dropped ones too.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Of equal texts one row stays, with the largest id
    (of repeated rows with that id, one). A null id comes below every other; keep_id is null if a group has none. Result columns
    replace input columns of the same name. The marked rows are written once to the shared folder.
    """
    keep = [c for c in (df.columns if carry is None else carry) if c.lower() not in ("keep_id", "group_size", "kept", "text_sha256")]
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    taken = df.select(*keep)
    id_name, text_name, sha_name, head = (free_name(taken, x) for x in ("run_id", "run_text", "run_sha256", "run_head"))
    rows = df.select(
        *keep,
        F.col(id_col).cast("long").alias(id_name),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(text_name),
        F.unhex(F.sha2(norm.cast("binary"), 256)).alias(sha_name),
        F.substring(norm.cast("binary"), 1, SPLITTER_BYTES).alias(head),
    )
    order = [F.col(head), F.col(sha_name), F.col(id_name).asc_nulls_first()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(head)
    names = dict(zip(RUN_NAMES, (free_name(taken, x) for x in RUN_NAMES), strict=True))
    kinds = (T.BinaryType(), T.LongType(), T.LongType(), T.BooleanType(), T.BooleanType(), T.IntegerType())
    schema = T.StructType([*taken.schema.fields, *(T.StructField(names[x], k) for x, k in zip(RUN_NAMES, kinds, strict=True))])
    marked = written(dealt.mapInArrow(marker(len(keep), list(names.values())), schema))
    sha, size, top, edge, last, part = (F.col(names[x]) for x in RUN_NAMES)
    # At most two runs per partition reach its edge, so this table is bounded by the number of partitions.
    edges = (
        marked.where(edge & last)
        .groupBy(sha.alias("edge_sha"))
        .agg(F.sum(size).alias("edge_size"), F.max(top).alias("edge_max"), F.max(part).alias("edge_part"))
    )
    out = marked.join(F.broadcast(edges), edge & (sha == F.col("edge_sha")), "left")
    whole = F.col("edge_sha").isNotNull()
    return out.select(
        *[F.col(c) for c in keep],
        F.when(whole, F.col("edge_max")).otherwise(top).alias("keep_id"),
        F.when(whole, F.col("edge_size")).otherwise(size).alias("group_size"),
        (last & (~whole | (part == F.col("edge_part")))).alias("kept"),
        F.lower(F.hex(sha)).alias("text_sha256"),
    )
