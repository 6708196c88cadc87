"""Ranked search against plain scoring of every document."""

import math
import random
import re

import pytest

from sedgewren.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, queries, top=50):
    """Scores of every document, by the definition."""
    tfs = [(i, {}) for i, _ in docs]
    for (_, found), (_, text) in zip(tfs, docs, strict=True):
        for t in terms(text):
            found[t] = found.get(t, 0) + 1
    tfs = [(i, f) for i, f in tfs if f]
    n_docs, n_terms = len(tfs), sum(sum(f.values()) for _, f in tfs)
    df = {}
    for _, f in tfs:
        for t in f:
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text in queries:
        scored = []
        for i, f in tfs:
            m = 50 + 50 * sum(f.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * f[t] // (1000 * f[t] + 20 * m)) for t in set(terms(text)) if t in f)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(q, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top], 1)]
    return out


def docs_of(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(150)]
    made = [(i, " ".join(rng.choices(words, weights=range(1, 151), k=rng.choice([1, 3, 10, 40, 400])))) for i in range(n)]
    made += [(n + 1, None), (n + 2, ""), (n + 3, " .,; "), (None, "Aa bb aa"), (None, "aa"), (7, made[7][1]), (n + 4, made[3][1]), (n + 5, "KK x\x1cy z ÄÖ"), (n + 6, "aa " * 5000), (n + 7, "x" * 3000)]
    rng.shuffle(made)
    return made, words


@pytest.mark.parametrize("shard,top", [(lexical.SHARD, 50), (900, 50), (900, 2)])
def test_equals_plain_scoring(spark, shard, top):
    made, words = docs_of(1, 700)
    queries = [(1, " ".join(words[:9])), (2, words[149] + " " + words[140]), (3, None), (4, "..."), (5, " ".join(words)), (6, "unseenword"), (7, "AA aa kK y z"), (None, words[5]), (8, "x" * 3000)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = lexical.ranked_search(docs, spark.createDataFrame(queries, "item_id long, text string"), top=top, shard=shard)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(made, queries, top), key=key)


def test_pieces_end_between_terms(monkeypatch):
    made, _ = docs_of(4, 200)
    whole = [[w for x in lexical.split((t or "").encode()) for w in x] for _, t in made]
    assert [[w.decode() for w in x] for x in whole] == [terms(t) for _, t in made]
    monkeypatch.setattr(lexical, "PIECE", 64)
    assert [[w for x in lexical.split((t or "").encode()) for w in x] for _, t in made] == whole


def test_walk_over_many_blocks_skips_and_is_exact():
    """Lists of many blocks in small shards, walked with and without a floor; skipped blocks stay packed."""
    made, words = docs_of(2, 6000)
    shard = lexical.Shard()
    for i, text in made:
        shard.add(i, (text or "").encode())
    batch = shard.rows(5)
    rows = batch.to_pylist()
    n, total = len(shard.ids), sum(shard.lengths)
    norm = lambda x: 50 + 50 * x * n // total
    import numpy as np

    norms = norm(np.frombuffer(rows[0]["data"], "<i8"))
    table = {r["term"].decode(): r for r in rows[1:]}
    rng = random.Random(3)
    unpacked = blocks = 0
    for _ in range(60):
        asked = rng.sample(sorted(table), rng.choice([1, 2, 5, 20]))
        lists = [(lexical.Postings(table[t]["blocks"], table[t]["data"], norm), rng.choice([1, 7, 900, 4000])) for t in asked]
        every = np.zeros(n, np.int64)
        for p, w in lists:
            for k in range(len(p.firsts)):
                docs, values = p.block(k, norms)
                assert p.peak[k] == values.max() and docs[0] == p.firsts[k] and docs[-1] == p.lasts[k] and len(docs) <= lexical.BLOCK
                every[docs] += w * values
            p.open.clear()
        want = np.lexsort((np.arange(n), -every))[:50]
        want = want[every[want] > 0]
        for floor in (0, int(every[want[-1]])):
            for p, _ in lists:
                p.open.clear()
            places, scores = lexical.walk(lists, norms, 50, floor)
            keep = np.lexsort((places, -scores))[:50]
            assert places[keep].tolist() == want.tolist() and scores[keep].tolist() == every[want].tolist()
        unpacked += sum(len(p.open) for p, _ in lists)
        blocks += sum(len(p.firsts) for p, _ in lists)
    assert unpacked < blocks


def test_blocks_hold_every_posting():
    shard = lexical.Shard()
    for i in range(1000):
        shard.add(i, b"a " * (i % 300 + 1) + b"b" * (i % 7))
    rows = {r["term"]: r for r in shard.rows(0).to_pylist()}
    p = lexical.Postings(rows[b"a"]["blocks"], rows[b"a"]["data"], lambda x: x)
    import numpy as np

    found = [p.block(k, np.array(shard.lengths)) for k in range(len(p.firsts))]
    assert np.concatenate([d for d, _ in found]).tolist() == list(range(1000)) and p.sizes.tolist() == [128] * 7 + [104]


def test_no_documents_no_queries(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked_search(none, asked).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    assert lexical.ranked_search(some, asked.limit(0)).count() == 0
    extra = some.selectExpr("*", "1 AS query", "2 AS term", "3 AS shard")
    assert [tuple(r)[:3] for r in lexical.ranked_search(extra, asked.selectExpr("*", "5 AS score")).collect()] == [(1, 1, 1)]
