"""The prefix trie against plain dictionaries of prefixes."""

import random
from hashlib import sha256

import pytest

from sedgewren.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(turns, group=5, most=9):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            r, t = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, sha256(f"{len(r.encode())}:{r}{t}".encode()).digest(), (r, t)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    whole = {c: own.get(c - c % group, [])[: trie.crc(c) % most] + v[trie.crc(c) % most :] for c, v in own.items()}
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[:-1] == q for x in members)
        ends = sorted(c for c in m if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), sum(map(leaf, below)),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, turns, **more):
    df = trie.prefix_trie(spark.createDataFrame(turns, SCHEMA).repartition(3), **more)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def conversations(seed, n, texts, longest):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for k in range(rng.randint(1, longest)):
            out.append((c, k, rng.choice(["user", "assistant"]) if k % 3 else "user", rng.choice(texts)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,texts,longest", [(1, ["a", "b"], 7), (2, ["é", "", None], 20), (3, list("abcdefgh"), 12)])
def test_equals_dictionaries(spark, seed, texts, longest):
    turns = conversations(seed, 90, texts, longest)
    assert got(spark, turns) == plain(turns)


def test_odd_rows(spark):
    """Turns without a number or a conversation, ties, repeated rows, null roles, gaps in ids, a conversation that only borrows."""
    turns = [(10, None, None, "x"), (10, 3, "user", None), (10, 3, "user", "y"), (10, 3, "user", "y"), (10, 3, "a", "y"), (11, 0, "user", "z"), (12, 0, "user", "z"), (13, 5, "", "x"), (14, 0, None, "x"),
             (27, 0, "u", "v"), (29, 1, "ab", "c"), (28, 1, "a", "bc"), (None, 1, "user", "lost"), (41, 0, "1:", "x"), (42, 0, "user", "w" * 100_000), (43, 0, "user", "w" * 100_000), (10**12, 0, "u", "v")]
    assert got(spark, turns) == plain(turns)
    assert got(spark, turns * 2, group=3, most=4) == plain(turns * 2, 3, 4)


def test_hot_conversations(spark):
    """Most conversations are the same, one is long: as many rounds as its length has digits."""
    turns = [(c, k, "user", str(k)) for c in range(0, 2000, 5) for k in range(12)] + [(1, k, "user", "again") for k in range(260)]
    assert got(spark, turns) == plain(turns)


def test_chunks_join(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(trie, "CHUNK", 10)
    rows = [(1, 0, c) for c in range(25)] + [(1, 1, 7)] + [(2, 0, 8), (2, 0, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part, strict=True)], names=["node", "depth", "conv"]) for part in (rows[:9], rows[9:])]
    parts = list(trie.chunks(iter(batches)))
    assert len(parts) > 4
    out = [r for b in trie.hashed(iter(parts)) for r in b.to_pylist()]
    want = {k: sha256(",".join(str(c) for a, b, c in rows if (a, b) == k).encode()).hexdigest() for k in {(a, b) for a, b, _ in rows}}
    assert {(r["node"], r["depth"]): r["ends_sha256"] for r in out} == want


def test_no_turns(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
