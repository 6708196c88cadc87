"""Ranked lexical search with Block-Max WAND over a sharded inverted index.

Every task cuts its documents into shards of at most SHARD postings and writes one row for each of a shard's terms: its postings in
blocks of BLOCK, packed to the bytes that they need, and beside them each block's first and last document and its peaks, the pairs
(occurrences, document length) that no other pair of the block beats. Peaks hold for any corpus statistics, so the index is built in
one pass; the block's maximum impact follows from them once N and L are known. A query's lists are walked as in WAND: the pivot is the
first document that could beat the threshold by the lists' maxima; the other lists move to its blocks by the block table alone, and
unless the blocks' maxima beat the threshold the range up to the nearest block end is passed without unpacking anything.
Shards share nothing, so the index needs no shuffle of postings; the threshold found in a sixteenth of the shards is where the others
begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WRITTEN, cut, remove, small, written

#: Postings in a block, and in a shard (a longer document has a shard of its own).
BLOCK, SHARD = 128, 1 << 21
#: Bytes of a text that are split at a time.
PIECE = 1 << 20
#: Queries that a task walks over one shard, about.
QUERIES = 64
#: One in so many shards is searched first.
FIRST = 16
END = np.iinfo(np.int32).max

#: Bytes of terms: digits, letters (lower-cased) and all of other characters; the rest becomes a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX_SCHEMA = "shard long, term binary, df long, n_terms long, blocks binary, data binary"


def split(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms, in lists for a piece of it each; pieces end between terms."""
    plain, at = text.translate(TERM_BYTES), 0
    while at < len(plain):
        end = len(plain)
        if end - at > PIECE:
            end = plain.rfind(b" ", at, at + PIECE)
            end = end if end > at else plain.find(b" ", at + PIECE)
            end = len(plain) if end < 0 else end
        if words := plain[at:end].split():
            yield words
        at = end + 1


class Numbers(dict):
    """Numbers terms in the order in which they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, counts).astype(np.int64)


class Shard:
    """Documents gathered until there are SHARD postings."""

    def __init__(self) -> None:
        self.terms, self.ids, self.lengths, self.found, self.postings = Numbers(), [], [], [], 0

    def add(self, ident: int | None, text: bytes) -> None:
        parts = [np.unique(np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words)), return_counts=True) for words in split(text)]
        if not parts:
            return
        terms, tfs = parts[0] if len(parts) == 1 else summed(*map(np.concatenate, zip(*parts, strict=True)))
        self.ids.append(ident)
        self.lengths.append(int(tfs.sum()))
        self.found.append((terms, tfs))
        self.postings += len(terms)

    def rows(self, shard: int) -> pa.RecordBatch:
        """The shard's row of documents (term null, ids in ascending order, those without one last) and a row for each term."""
        known = np.array([i is not None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((ids, ~known))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)[order]
        terms = np.concatenate([t for t, _ in self.found])
        tfs = np.concatenate([f for _, f in self.found])
        docs = np.repeat(place, [len(t) for t, _ in self.found])
        by = np.lexsort((docs, terms))
        terms, docs, tfs = terms[by], docs[by], tfs[by]
        starts = np.flatnonzero(np.r_[True, np.diff(terms) > 0])
        dfs = np.diff(np.r_[starts, len(terms)])
        in_list = np.arange(len(terms)) - np.repeat(starts, dfs)
        firsts = np.flatnonzero(in_list % BLOCK == 0)  # of every block
        sizes = np.diff(np.r_[firsts, len(terms)])
        lasts = firsts + sizes - 1
        # Peaks: by length, the pairs with more occurrences than any shorter document of the block.
        block = np.repeat(np.arange(len(firsts)), sizes)
        n = lengths[docs]
        best = np.lexsort((-tfs, n, block))
        rank = block[best] << 40 | tfs[best]
        peak = best[np.r_[True, rank[1:] > np.maximum.accumulate(rank)[:-1]]]
        peaks = np.bincount(block[peak], minlength=len(firsts))
        peak_tf, peak_n = tfs[peak].astype("<i8"), n[peak].astype("<i8")
        # Deltas within a block, each in as many bytes as the block needs.
        delta = docs - np.r_[0, docs[:-1]]
        delta[firsts] = 0
        wide = [np.select([x <= 0xFF, x <= 0xFFFF], [1, 2], 4) for x in (np.maximum.reduceat(delta, firsts), np.maximum.reduceat(tfs, firsts))]
        packed = [delta[a : a + s].astype(f"<u{d}").tobytes() + tfs[a : a + s].astype(f"<u{t}").tobytes() for a, s, d, t in zip(firsts.tolist(), sizes.tolist(), wide[0].tolist(), wide[1].tolist(), strict=True)]
        table = np.column_stack([docs[firsts], docs[lasts], sizes, wide[0], wide[1], peaks]).astype("<i4")
        bounds = np.searchsorted(firsts, np.r_[starts, len(terms)]).tolist()
        at_peak = np.r_[0, np.cumsum(peaks)].tolist()
        names = list(self.terms)
        out_terms, blocks, data = [None], [np.where(known[order], ids[order], 0).astype("<i8").tobytes()], [lengths.astype("<i8").tobytes()]
        for k, term in enumerate(terms[starts].tolist()):
            a, b = bounds[k], bounds[k + 1]
            p, q = at_peak[a], at_peak[b]
            out_terms.append(names[term])
            blocks.append(np.int32(b - a).tobytes() + table[a:b].tobytes() + peak_tf[p:q].tobytes() + peak_n[p:q].tobytes())
            data.append(b"".join(packed[a:b]))
        rows = len(out_terms)
        columns = [np.full(rows, shard, np.int64), pa.array(out_terms, pa.binary()), np.r_[known.sum(), dfs], np.r_[lengths.sum(), np.zeros(rows - 1, np.int64)], pa.array(blocks, pa.binary()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["shard", "term", "df", "n_terms", "blocks", "data"])


def indexer(size: int):
    """mapInArrow function from (id, text) to the rows of shards."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, open_ = TaskContext.get().partitionId(), 0, Shard()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                open_.add(ids[i].as_py(), texts[i].as_py() or b"")
                if open_.postings >= size:
                    yield open_.rows(part << 32 | made)
                    made, open_ = made + 1, Shard()
        if open_.ids:
            yield open_.rows(part << 32 | made)

    return indexed


@dataclass
class Index:
    """Rows of shards in the shared folder, the number of documents with a term, and all their terms."""

    rows: DataFrame
    n_docs: int
    n_terms: int
    path: str


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> Index:
    """An index over every row of df; texts without terms (null, empty) are in none of its lists."""
    docs = df.select(F.col(id_col).cast("long").alias("ident"), F.col(text_col).cast("binary").alias("body"))
    rows = written(docs.mapInArrow(indexer(shard), INDEX_SCHEMA))
    docs_of = F.col("term").isNull()
    n, terms = rows.where(docs_of).agg(F.sum(F.expr("octet_length(blocks) div 8")), F.sum("n_terms")).first()
    return Index(rows, n or 0, terms or 0, WRITTEN[-1])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Postings:
    """One term's list in a shard: the block table with maximum impacts, and blocks unpacked at most once."""

    def __init__(self, blocks: bytes, data: bytes, norm) -> None:
        n = int(np.frombuffer(blocks, "<i4", 1)[0])
        table = np.frombuffer(blocks, "<i4", 6 * n, 4).reshape(n, 6)
        self.firsts, self.lasts, self.sizes, self.wide_d, self.wide_t, peaks = table.T
        pairs = np.frombuffer(blocks, "<i8", -1, 4 + 24 * n)
        tf, length = pairs[: len(pairs) // 2], pairs[len(pairs) // 2 :]
        self.peak = np.maximum.reduceat(impact(tf, norm(length)), np.r_[0, np.cumsum(peaks)[:-1]])
        self.at = np.r_[0, np.cumsum(self.sizes * (self.wide_d + self.wide_t))]
        self.data, self.open = data, {}

    def block(self, k: int, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their impacts."""
        if k not in self.open:
            size, d, t, at = int(self.sizes[k]), int(self.wide_d[k]), int(self.wide_t[k]), int(self.at[k])
            docs = np.cumsum(np.frombuffer(self.data, f"<u{d}", size, at), dtype=np.int64) + int(self.firsts[k])
            self.open[k] = docs, impact(np.frombuffer(self.data, f"<u{t}", size, at + size * d).astype(np.int64), norms[docs])
        return self.open[k]


def walk(lists: list[tuple[Postings, int]], norms: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the `top` best documents that score `floor` at least and above 0, equal scores by place."""
    lists = [(p, w) for p, w in lists if w > 0]
    places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    if not lists:
        return places, scores
    # The lists' blocks behind each other, each list closed by a block that never ends; a key is the list's number and the block's last document.
    firsts = np.concatenate([np.r_[p.firsts, END].astype(np.int64) for p, _ in lists])
    lasts = np.concatenate([np.r_[p.lasts, END].astype(np.int64) for p, _ in lists])
    bounds = np.concatenate([np.r_[p.peak * w, 0] for p, w in lists])
    counts = np.array([len(p.firsts) + 1 for p, _ in lists])
    begin = np.r_[0, np.cumsum(counts)[:-1]]
    base = np.arange(len(lists), dtype=np.int64) << 32
    keys = np.repeat(base, counts) | lasts
    most = np.maximum.reduceat(bounds, begin)
    # A block that may not be skipped is unpacked and added to the sums once; a range is complete when all blocks over it are.
    sums, added = np.zeros(len(norms), np.int64), np.zeros(len(keys), bool)
    threshold, here = max(0, floor - 1), 0
    while True:
        at = keys.searchsorted(base | here)
        low = np.maximum(firsts[at], here)
        order = low.argsort(kind="stable")
        reach = int(most[order].cumsum().searchsorted(threshold, "right"))
        if reach == len(order) or (pivot := int(low[order[reach]])) == END:
            return places, scores
        at = keys.searchsorted(base | pivot)  # shallow: only the block table is read
        low = firsts[at]
        on = low <= pivot
        over = at[on]
        end = int(lasts[over].min())
        if len(over) < len(at):
            end = min(end, int(low[~on].min()) - 1)
        here = end + 1
        if int(bounds[over].sum()) <= threshold:
            continue
        if not added[over].all():
            for i in np.flatnonzero(on & ~added[at]).tolist():
                docs, values = lists[i][0].block(int(at[i] - begin[i]), norms)
                sums[docs] += lists[i][1] * values
            added[over] = True
        found = sums[pivot:here]
        if int(found.max()) > threshold:
            better = np.flatnonzero(found > threshold)
            places, scores = np.concatenate([places, better + pivot]), np.concatenate([scores, found[better]])
            if len(places) >= top:
                best = np.lexsort((places, -scores))[:top]
                places, scores = places[best], scores[best]
                threshold = max(threshold, int(scores[-1]))


def searcher(n_docs: int, n_terms: int, top: int):
    """applyInArrow function over one shard's rows for a block of queries: term rows with uses (query, weight, floor), and the documents' row."""
    schema = pa.schema([("query", pa.int64()), ("ident", pa.int64()), ("score", pa.int64())])

    def norm(length: np.ndarray) -> np.ndarray:
        return 50 + 50 * length * n_docs // n_terms

    def search(table: pa.Table) -> pa.Table:
        norms, ids, known, lists, floors = None, None, 0, {}, {}
        for row in table.to_pylist():
            if row["term"] is None:
                ids, norms, known = np.frombuffer(row["blocks"], "<i8"), norm(np.frombuffer(row["data"], "<i8")), row["df"]
        for row in table.to_pylist():
            if row["term"] is not None:
                postings = Postings(row["blocks"], row["data"], norm)
                for use in row["uses"]:
                    lists.setdefault(use["query"], []).append((postings, use["weight"]))
                    floors[use["query"]] = use["floor"]
        out = []
        for query, of in lists.items():
            places, scores = walk(of, norms, top, floors[query])
            out.append((np.full(len(places), query, np.int64), pa.array(ids[places], mask=places >= known), scores))
        if not out:
            return schema.empty_table()
        columns = [np.concatenate([x[0] for x in out]), pa.concat_arrays([x[1] for x in out]), np.concatenate([x[2] for x in out])]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=schema)

    return search


def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, term) for every distinct term of a query's text."""
    for batch in batches:
        found = [sorted({w for words in split(x.as_py() or b"") for w in words}) for x in batch.column(1)]
        ids = np.repeat(np.asarray(batch.column(0)), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([w for x in found for w in x], pa.binary())], names=["query", "term"])


def best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("ident").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(index: Index, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = 50) -> DataFrame:
    """id_col, rank, doc_id and score of the `top` best documents of every row of queries, with scores above 0.

    Each row is a query of its own, repeated ids and null ids too; a text without terms (null, empty) finds nothing. Equal scores go by
    ascending document id, documents without an id last; repeated documents are ranked each. The result is bounded by `top` rows a query.
    """
    asked = cut(queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("asked_id"), F.col(text_col).cast("binary").alias("body")))
    terms = asked.select("query", "body").mapInArrow(query_terms, "query long, term binary")
    # df of the queries' terms over all shards; weights in doubles as the ranking has them.
    wanted = cut(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_queries")))
    dfs = index.rows.where(F.col("term").isNotNull()).select("term", "df").join(small(wanted.select("term")), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * index.n_docs + 2)) / (2 * F.col("df") + 1)))
    n_parts = 1 + asked.count() // QUERIES
    part = F.pmod(F.xxhash64("query"), F.lit(n_parts)).cast("int")
    weighed = cut(terms.join(cut(dfs), "term").select("query", "term", weight.cast("long").alias("weight"), part.alias("part")))

    def over(shards: DataFrame, floors: DataFrame | None) -> DataFrame:
        told = weighed.withColumn("floor", F.lit(0).cast("long")) if floors is None else weighed.join(floors, "query", "left").fillna(0, ["floor"])
        uses = small(cut(told.groupBy("part", "term").agg(F.collect_list(F.struct("query", "weight", "floor")).alias("uses"))))  # about QUERIES at most
        lists = shards.where(F.col("term").isNotNull()).join(uses, "term")
        docs = shards.where(F.col("term").isNull()).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))).withColumn("uses", F.lit(None).cast(uses.schema["uses"].dataType))
        names = ["part", "shard", "term", "df", "blocks", "data", "uses"]
        rows = lists.select(*names).unionByName(docs.select(*names))
        return rows.groupBy("part", "shard").applyInArrow(searcher(index.n_docs, index.n_terms, top), "query long, ident long, score long")

    first = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    begun = cut(best(over(index.rows.where(first), None), top))
    floors = cut(begun.where(F.col("rank") == top).select("query", F.col("score").alias("floor")))
    rest = best(begun.drop("rank").unionByName(over(index.rows.where(~first), floors)), top)
    return cut(rest.join(small(asked.select("query", "asked_id")), "query").select(F.col("asked_id").alias(id_col), "rank", F.col("ident").alias("doc_id"), "score"))


def ranked_search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text", top: int = 50, shard: int = SHARD) -> DataFrame:
    """`search` over an index of docs that is removed afterwards. Without documents or queries the result is empty."""
    index = build_index(docs, doc_id, doc_text, shard)
    out = search(index, queries, query_id, query_text, top)
    remove(docs.sparkSession, [index.path])
    return out
