"""SimHash operators against brute force over all pairs."""

import random

import pytest
import xxhash

from sedgewren.llm import similar, simhash

DOCS = "doc_id long, text string"


def brute_components(n: int, linked) -> list[int]:
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def brute_print(text: str | None) -> int:
    words = [w for w in "".join(c if c not in " \t\n\x0b\f\r" else " " for c in (text or "")).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edited(rng: random.Random, words: list[str], share: float) -> str:
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in words)


VOCABULARY = [f"w{i}" for i in range(500)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", "  \n", "one", "One  two", "ONE two", "ÄB äb Äb c", "a b c"]
    for _ in range(12):
        base = rng.choices(VOCABULARY, k=rng.randint(40, 300))
        out += [edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05])) for _ in range(rng.randint(2, 8))]
    out.append(" ".join(rng.choices(VOCABULARY, k=70_000)))  # longer than a block
    out += [out[-1], out[-2], out[8]]
    return out


def test_fingerprints_and_components(spark, texts):
    got = {r[0]: r for r in simhash.simhash_groups(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    prints = [brute_print(t) for t in texts]
    roots = brute_components(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", roots[i]) for i, p in enumerate(prints)}


@pytest.mark.parametrize("radius", [2, 4, 6])
def test_covering_masks_guarantee_a_meeting(radius):
    rng = random.Random(radius)
    for _ in range(2000):
        apart = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(apart & m == 0 for m in simhash.masks(radius))


def brute_links(prints: list[int], radius: int) -> list[int]:
    return brute_components(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= radius)


@pytest.mark.parametrize("group", [2, 2048])
def test_links_by_either_way(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(5)
    prints = set()
    for _ in range(20):
        p = rng.getrandbits(63)
        for _ in range(8):
            prints.add(p)
            for b in rng.sample(range(63), rng.randint(1, 3)):
                p ^= 1 << b
    prints = sorted(prints)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 2)
    got = {r[0]: r[1] for r in simhash.components(edges).collect()}
    want = brute_links(prints, 2)
    assert [got.get(p, p) for p in prints] == [prints[i] for i in want]


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_by_similarity(spark):
    rng, rows, pairs = random.Random(11), [], []
    for _ in range(150):
        base = rng.choices(VOCABULARY, k=200)
        rows.append(" ".join(base))
        rows.append(edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.06])))
        a, b = shingles(rows[-2]), shingles(rows[-1])
        pairs.append((len(rows) - 2, len(rows) - 1, len(a & b) / len(a | b)))
    got = {r.doc_id: r.component_id for r in similar.near_copies(spark.createDataFrame(list(enumerate(rows)), DOCS), carry=["doc_id"]).collect()}
    assert sum(s >= 0.8 for _, _, s in pairs) > 40 and sum(s < 0.8 for _, _, s in pairs) > 20
    assert all((got[b] == a) == (s >= 0.8) for a, b, s in pairs)


@pytest.mark.parametrize("operator", [simhash.simhash_groups, similar.near_copies])
def test_odd_tables(spark, operator):
    """Nulls, repeated rows and clashing names; empty tables."""
    schema = "doc_id long, text string, component_id string, ident int, fp int, in_0 int, t int, node int"
    rows = [(None, None, "x", 1, 1, 1, 1, 1), (3, "", "x", 1, 1, 1, 1, 1), (3, "", "x", 1, 1, 1, 1, 1), (None, "alone here", None, None, None, None, None, None)]
    got = operator(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and sorted(str(r.component_id) for r in got) == ["3", "3", "3", "None"]
    assert operator(spark.createDataFrame([], schema)).count() == 0


def test_one_row_of_each_component_is_kept(spark):
    """Rows without an id, rows that share one with different texts, repeated rows."""
    long = " ".join(f"u{i}" for i in range(60))
    rows = [(7, long), (7, long), (7, "quite another text of its own"), (None, long + " more"), (None, "nobody's"), (None, "nobody's"), (2, None), (5, "")]
    got = similar.near_copies(spark.createDataFrame(rows, DOCS), carry=["doc_id", "text"]).where("kept").collect()
    assert sorted(map(str, got)) == sorted(map(str, [r for r in got if r.kept]))
    assert sorted((r.doc_id or 0, r.text or "", r.component_id or 0) for r in got) == [(0, "nobody's", 0), (2, "", 2), (7, "quite another text of its own", 7), (7, long, 7)]
