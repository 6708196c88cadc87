"""Mixing: budgets against a plain water-filling, prefixes against a sort."""

import random
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from sedgewren.llm import mixing

WEIGHTS = {"lang": {"en": 3}, "source": {"a": 2}}


def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def shares(budget, children):
    """children: name to (capacity, weight). Those that can't use their share are filled, the rest is shared again."""
    out, open_ = {}, dict(children)
    while open_:
        total = sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c <= budget * w / total + 1e-9]
        if not full:
            return out | {k: budget * w / total for k, (_, w) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[0]
            budget -= out[k]
    return out


def brute(rows, share, epochs, seed):
    tokens, docs = defaultdict(int), defaultdict(list)
    for i, t, lang, source in rows:
        n = len((t or "").split())
        tokens[lang or "", source or ""] += n
        docs[lang or "", source or ""].append(("" if i is None else str(i), n))
    at_hand = sum(tokens.values())
    by_lang = defaultdict(int)
    for (lang, _), n in tokens.items():
        by_lang[lang] += n
    top = shares(min(int(at_hand * share), at_hand * epochs), {k: (n * epochs, WEIGHTS["lang"].get(k, 1)) for k, n in by_lang.items() if n})
    out = []
    for lang, budget in top.items():
        for source, want in shares(budget, {s: (n * epochs, WEIGHTS["source"].get(s, 1)) for (k, s), n in tokens.items() if k == lang and n}).items():
            want, leaf = int(want + 1e-6), docs[lang, source]
            whole = min(want // tokens[lang, source], epochs)
            left = want - whole * tokens[lang, source]
            out += [(i, e) for e in range(whole) for i, _ in leaf]
            if whole < epochs:
                for key, i, n in sorted((md5(f"{seed}:{whole}:{i}".encode()).hexdigest(), i, n) for i, n in leaf):
                    left -= n
                    if left < 0:
                        break
                    out.append((i, whole))
    return sorted(out)


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 3), (1.7, 3), (5.0, 2), (0.0, 1)])
def test_budgets_and_prefixes(spark, share, epochs):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "a", "b", None])) for i in range(400)]
    rows += [(1000, None, "en", "a"), (1001, "big " * 3000, "de", "a")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, lang string, source string, mix_epoch int, node_0 string")
    got = mixing.mix(df, levels(), weights=WEIGHTS, budget_share=share, max_epochs=epochs, seed=5)
    assert sorted((str(r.doc_id), r.mix_epoch) for r in got.collect()) == brute(rows, share, epochs, 5)
    assert "node_0" in got.columns and got.columns.count("mix_epoch") == 1


def test_repeated_and_null_ids_stand_or_fall_together(spark):
    df = spark.createDataFrame([(None, "a b", "x", "s"), (None, "c", "x", "s"), (2, "d e", "x", "s"), (2, "d e", "x", "s")], "doc_id long, text string, lang string, source string")
    for share in (0.3, 0.5, 0.7):
        ids = [r.doc_id for r in mixing.mix(df, levels(), budget_share=share).collect()]
        assert ids.count(None) in (0, 2) and ids.count(2) in (0, 2)
    assert mixing.mix(df.limit(0), levels()).count() == 0
    assert mixing.mix(df.withColumn("text", F.lit(None).cast("string")), levels()).count() == 0
