"""Packing with lexical retrieval: a window holds a document and its nearest unused neighbours.

Documents become token ids once, in a table in the shared folder. They are sorted by their two heaviest shared tokens (range partitions;
equal ones by document id, so that a hot group is dealt over many tasks), and each task cuts its stretch into shards of about SHARD
tokens. A shard has an inverted index of BM25 weights, whose document frequencies and mean length are those of all documents. The next
unused document is a window's seed; unused neighbours are appended by falling score until the window is full; the one that does not fit is
cut, and its rest is the next seed. A window that outlives its shard is filled from the next one, and what is left at a task's end
becomes sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, remove, slices, written

WINDOW, SHARD = 2048, 1 << 19
#: Shards of a task, about.
TASK_SHARDS = 8
#: The usual constants of BM25.
K1, B = 1.2, 0.75
#: Words whose ids a worker keeps, their greatest length, and characters of a text that are split at a time.
KNOWN, WORD, PIECE = 1 << 20, 64, 1 << 23
#: Ids that are counted at a time.
PARTS = 1 << 22

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


#: An ASCII letter and a mark behind it, which never share a token (an apostrophe may).
MARKED = r"([a-z])([!-&(-/:-@\[-`{-~])"

#: Words that are one run of letters whatever the tokenizer does to them: plain Latin lower case.
LATIN = re.compile("[a-zß-öø-ÿ]+")


class Words:
    """Ids of words as bytes. The tokenizer drops white space and nothing in it reaches over a blank, so a text's ids are its words' ids;
    neither does anything reach from a letter to a mark behind it, and the tokenizer lower-cases all. New words are encoded together, apart
    by a special token."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.known: dict[str, bytes] = {"": b""}
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)}
        self.apart, self.apart_id = min(special.items(), default=(None, None))
        # Where words end with a token of their own kind, plain words need nothing but blanks between them.
        self.last = np.zeros(1 << 16, bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.openings = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}

    def plain(self, word: str) -> bool:
        """Whether no special token can begin in a word."""
        for o in self.openings:
            if o in word:
                return False
        return True

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        plain = [w for w in words if LATIN.fullmatch(w)]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(plain):
                data = ids.astype("<u2").tobytes()
                out = {w: data[2 * i : 2 * j] for w, i, j in zip(plain, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}
        joined = [w for w in words if w not in out and self.apart is not None and self.plain(w)]
        if joined:
            ids = np.array(self.tokenizer.encode_batch_fast([self.apart.join(joined)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(ids == self.apart_id)
            data = ids.astype("<u2").tobytes()
            out |= {w: data[2 * i : 2 * j] for w, i, j in zip(joined, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True)}
        for w in words:
            if w not in out:
                out[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u2").tobytes()
        return out

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of each of a few texts. Every different word is looked up once; its ids are then gathered for all its places."""
        special = pa.array([False] * len(texts))
        for o in self.openings:
            special = pc.or_(special, pc.match_substring(texts, o))
        texts = pc.if_else(special, texts, pc.replace_substring_regex(pc.ascii_lower(texts), MARKED, "\\1 \\2"))
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) + len(words) > KNOWN:
            self.known = {"": b""}
        new = self.encoded([w for w in words if w not in self.known])
        found = [self.known[w] if w in self.known else new[w] for w in words]
        self.known.update((w, i) for w, i in new.items() if len(w) <= WORD)
        pool, sizes = np.frombuffer(b"".join(found), "<u2"), np.fromiter(map(len, found), np.int64, len(found)) // 2
        starts, lengths = (np.cumsum(sizes) - sizes)[place], sizes[place]
        ends = np.r_[0, np.cumsum(lengths)]
        data = pool[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)].tobytes()
        at = 2 * ends[split.offsets.to_numpy()]
        return [data[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def pieces(text: str) -> Iterator[str]:
    """Parts of about PIECE characters that end at blanks."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE))
        if end < at:  # no blank there
            end = min((x for x in (text.find(" ", at + PIECE), text.find("\n", at + PIECE)) if x >= 0), default=len(text))
        yield text[at:end]
        at = end + 1


OPEN: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """A worker's words stay from task to task."""
    if path not in OPEN:
        OPEN[path] = Words(path)
    return OPEN[path]


def encoder(path: str, end_id: int):
    """mapInArrow function from (id, text) to (id, ids): 16-bit ids of the text and the end id. Texts are taken PIECE characters at a time."""
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            filled = pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "body"])
            for part in slices(filled, pc.binary_length(texts).to_numpy(), PIECE):
                if part.num_rows == 1:
                    ids = [b"".join(words.ids(pa.array([p]))[0] for p in pieces(part.column(1)[0].as_py()))]
                else:
                    ids = words.ids(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x + end for x in ids], pa.binary())], names=["doc_id", "ids"])

    return encode


def flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of 16-bit ids, and the numbers of them by row."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], "<u2", (offsets[-1] - offsets[0]) // 2, offsets[0]) if offsets[-1] > offsets[0] else np.empty(0, "<u2"), np.diff(offsets) // 2


def counted_terms(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and occurrences of every different id of a row, rows and ids ascending."""
    kind = np.uint32 if len(lengths) <= 1 << 16 else np.int64  # half the width sorts in half the time
    keys = np.repeat(np.arange(len(lengths), dtype=kind) << kind(16), lengths) | ids
    keys.sort()
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    found = keys[starts].astype(np.int64)
    return found >> 16, found & 0xFFFF, np.diff(np.r_[starts, len(keys)])


def parts_of(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about PARTS ids."""
    offsets = np.frombuffer(batch.column(column).buffers()[1], np.int32, batch.num_rows + 1, batch.column(column).offset * 4)
    return slices(batch, np.diff(offsets) // 2, PARTS)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each id; at -1 all documents and their tokens."""
    n, docs, tokens = np.zeros(1 << 16, np.int64), 0, 0
    for batch in batches:
        for part in parts_of(batch, 0):
            ids, lengths = flat_ids(part.column(0))
            n += np.bincount(counted_terms(ids, lengths)[1], minlength=1 << 16)
            docs, tokens = docs + len(lengths), tokens + len(ids)
    found = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found], pa.int32()), pa.array(np.r_[docs, n[found]]), pa.array(np.r_[tokens, np.zeros(len(found), np.int64)])], names=["id", "docs", "tokens"])


class Statistics:
    """Of all documents: BM25's weight of each id and the mean length. At most 65,536 numbers, whatever the corpus."""

    def __init__(self, rows: list) -> None:
        by = {r["id"]: r for r in rows}
        self.docs, self.tokens = (by[-1]["docs"], by[-1]["tokens"]) if -1 in by else (0, 0)
        df = np.zeros(1 << 16)
        for i, r in by.items():
            if i >= 0:
                df[i] = r["docs"]
        self.idf = np.log(1 + (self.docs - df + 0.5) / (df + 0.5))
        self.shared = df > 1
        self.mean = self.tokens / max(self.docs, 1)

    def weights(self, terms: np.ndarray, tf: np.ndarray, length) -> np.ndarray:
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))


def placer(about: Statistics):
    """mapInArrow function that adds a document's two heaviest ids that another document has too (-1 where there is none)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1):
                ids, lengths = flat_ids(part.column(1))
                row, term, tf = counted_terms(ids, lengths)
                kept = about.shared[term]
                row, term, tf = row[kept], term[kept], tf[kept]
                weight = about.weights(term, tf, lengths[row])
                tops = np.full((2, len(lengths)), -1, np.int32)
                for top in tops:  # the heaviest, then the heaviest of the others; of equal ones the smallest id
                    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
                    if not len(starts):
                        break
                    most = np.maximum.reduceat(weight, starts)
                    at = np.flatnonzero(weight == np.repeat(most, np.diff(np.r_[starts, len(row)])))
                    at = at[np.r_[True, row[at][1:] != row[at][:-1]]]
                    top[row[at]] = term[at]
                    left = np.ones(len(row), bool)
                    left[at] = False
                    row, term, weight = row[left], term[left], weight[left]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tops[0]), pa.array(tops[1])], names=["doc_id", "ids", "top", "next"])

    return place


class Lists:
    """Inverted index of a shard: for each id its documents and weights."""

    def __init__(self, docs: list[np.ndarray], about: Statistics) -> None:
        lengths = np.array([len(x) for x in docs])
        of, terms, tf = counted_terms(np.concatenate(docs), lengths)
        weight = about.weights(terms, tf, lengths[of])
        by = np.argsort(terms, kind="stable")
        self.docs, self.weight = of[by], weight[by]
        self.starts = np.searchsorted(terms[by], np.arange((1 << 16) + 1))
        self.n = len(docs)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Of every document, for the distinct ids of a query."""
        spans = [(a, b) for a, b in zip(self.starts[query].tolist(), self.starts[query + 1].tolist(), strict=True) if b > a]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.docs[a:b] for a, b in spans]), np.concatenate([self.weight[a:b] for a, b in spans]), self.n)


def falling(scores: np.ndarray, first: int = 64) -> Iterator[int]:
    """Places by falling score, equal ones in order. Most windows need the first few only, so the others are sorted when asked for."""
    if len(scores) <= 4 * first:
        yield from np.argsort(-scores, kind="stable").tolist()
        return
    least = np.partition(scores, len(scores) - first)[len(scores) - first]
    for some in (scores >= least, scores < least):
        places = np.flatnonzero(some)
        yield from places[np.argsort(-scores[places], kind="stable")].tolist()


class Packer:
    """Windows of one task; an open one is kept from shard to shard."""

    def __init__(self, about: Statistics, window: int, first_sequence: int) -> None:
        self.about, self.window, self.next_sequence = about, window, first_sequence
        self.out, self.open, self.filled, self.query = [], [], 0, None

    def add(self, doc: tuple, start: int) -> int:
        """Appends what fits of a document from `start` on; where the rest starts. doc: id, ids."""
        length = min(len(doc[1]) - start, self.window - self.filled)
        self.open.append((doc[0], start, doc[1][start : start + length], len(doc[1])))
        self.filled += length
        if self.filled == self.window:
            self.close([self.window])
        return start + length

    def close(self, sizes: list[int]) -> None:
        """Makes sequences of the given sizes from the open window."""
        pieces = self.open[::-1]
        for size in sizes:
            offset = 0
            while offset < size:
                ident, start, ids, total = pieces.pop()
                if len(ids) > size - offset:
                    pieces.append((ident, start + size - offset, ids[size - offset :], total))
                    ids = ids[: size - offset]
                self.out.append((ident, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_sequence, offset))
                offset += len(ids)
            self.next_sequence += 1
        self.open, self.filled, self.query = [], 0, None

    def shard(self, docs: list[tuple]) -> None:
        """Packs all of a shard's documents; the last window may stay open."""
        lists, unused, at = Lists([x for _, x in docs], self.about), np.ones(len(docs), bool), 0
        while True:
            if self.query is None:  # a new window: the next unused document, which may fill several
                while at < len(docs) and not unused[at]:
                    at += 1
                if at == len(docs):
                    return
                seed, start = at, 0
            else:
                seed = None
            while True:
                if seed is not None:
                    unused[seed] = False
                    while start < len(docs[seed][1]):
                        start = self.add(docs[seed], start)
                    if not self.filled:
                        break
                    self.query = np.unique(docs[seed][1]).astype(np.int64)
                left = np.flatnonzero(unused)
                if not len(left):
                    return
                scores = lists.scores(self.query)[left]
                seed = None
                for i in map(left.tolist().__getitem__, falling(scores)):
                    unused[i] = False
                    rest = self.add(docs[i], 0)
                    if rest < len(docs[i][1]):
                        seed, start = i, rest
                    if self.query is None:  # the window is full
                        break
                if seed is None:
                    break

    def finish(self) -> None:
        if self.filled:
            self.close([1 << k for k in range(self.filled.bit_length() - 1, -1, -1) if self.filled >> k & 1])

    def taken(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        columns = zip(*out, strict=True) if out else [[]] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)


def packer(about: Statistics, window: int, shard: int):
    """mapInArrow function from sorted (id, ids) to pieces."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, docs, size = Packer(about, window, TaskContext.get().partitionId() << 40), [], 0
        for batch in batches:
            for ident, ids in zip(*batch.columns, strict=True):
                docs.append((ident.as_py(), np.frombuffer(ids.as_py(), "<u2")))
                size += len(docs[-1][1])
                if size >= shard:
                    work.shard(docs)
                    yield work.taken()
                    docs, size = [], 0
        if docs:
            work.shard(docs)
        work.finish()
        yield work.taken()

    return pack


def token_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """doc_id and ids (16-bit, little-endian) of every row; a null text is empty and has the end id alone."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(encoder(path, end_id), "doc_id long, ids binary")


def statistics(ids: DataFrame) -> Statistics:
    return Statistics(ids.select("ids").mapInArrow(counted, "id int, docs long, tokens long").groupBy("id").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).collect())


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pieces of every row's ids in sequences of at most `window` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id is in one piece. All sequences but the last few of a task are full; those have a power of two of tokens (window must be one).
    Null and empty texts are documents of the end id alone; null ids stay null, repeated rows are packed each. An empty table has no
    pieces. A shard is SHARD tokens and one document at most in memory."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    ids = written(token_ids(df, path, id_col, text_col, end_id))
    table = WRITTEN[-1]
    about = statistics(ids)
    placed = ids.mapInArrow(placer(about), "doc_id long, ids binary, top int, next int")
    order = ["top", "next", "doc_id"]
    dealt = placed.repartitionByRange(1 + about.tokens // (shard * TASK_SHARDS), *order).sortWithinPartitions(*order, F.crc32("ids"))
    out = written(dealt.select("doc_id", "ids").mapInArrow(packer(about, window, shard), PIECES))
    remove(df.sparkSession, [table])
    return out
