"""The near-copy stage against the exact Jaccard similarity of all pairs."""

import random

import pytest
from test_near import DOCS, VOCABULARY, brute_components, shingles

from sedgewren.llm import similar


def varied(rng: random.Random) -> list[str]:
    """Short and long texts with edits at both sides of the threshold, chains of them, and a passage that many share."""
    out, passage = [], rng.choices(VOCABULARY, k=80)
    for _ in range(60):
        base = [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([1, 4, 5, 8, 10, 14, 30, 100, 300]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(1, 4)):  # each from the one before: chains
            base = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 60)):
                base[rng.randrange(len(base))] = f"y{rng.randrange(10**6)}"
            base += [f"z{rng.randrange(10**6)}"] * (rng.random() < 0.5)
            out.append(" ".join(base))
    out += [" ".join([*passage, *(f"v{rng.randrange(10**6)}" for _ in range(rng.randint(5, 30)))]) for _ in range(60)]
    return [*out, "", " \n", out[3].upper()]


@pytest.mark.parametrize(("group", "sample"), [(2048, 1), (3, 1), (2048, 16)])
def test_all_similar_pairs_and_no_others(spark, monkeypatch, group, sample):
    monkeypatch.setattr(similar, "SAMPLE", sample)
    monkeypatch.setattr(similar.links, "__defaults__", (group,))
    monkeypatch.setattr(similar, "SALT_ROWS", 20 if group == 3 else 100_000)
    texts = varied(random.Random(group + sample))
    sets = [shingles(t) for t in texts]
    want = brute_components(len(texts), lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)
    got = {r.doc_id: r.component_id for r in similar.near_copies(spark.createDataFrame(list(enumerate(texts)), DOCS), carry=["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_short_texts(spark):
    """Eight words and one appended: 4 of 5 shingles, a similarity of exactly 0.8, which a SimHash nearly always misses."""
    texts = [x for i in range(30) for x in (" ".join(f"w{i}-{k}" for k in range(8)), " ".join(f"w{i}-{k}" for k in range(9)))]
    got = {r.doc_id: r.component_id for r in similar.near_copies(spark.createDataFrame(list(enumerate(texts)), DOCS), carry=["doc_id"]).collect()}
    assert all(got[i] == i - i % 2 for i in range(len(texts)))
