"""Quality classifier: held-out accuracy, posteriors against a plain computation, odd tables."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgewren.llm import quality

BIGGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{BIGGER}/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    known = labels.where("quality IS NOT NULL")
    model = quality.fit(docs, known.where("doc_id % 2 = 0"))
    scored = quality.quality_classifier(docs, model, carry=["doc_id"])
    rows = scored.join(known.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("label")), "doc_id").select("kept", "label").collect()
    right = np.mean([r.kept == (r.label == 1) for r in rows])
    good = [r.kept for r in rows if r.label == 1]
    print(f"held-out accuracy {right:.3f} on {len(rows)} rows, {np.mean(good):.3f} of the good kept")
    assert len(rows) > 150 and right >= 0.9 and np.mean(good) >= 0.95


def brute(rows, p):
    """rows: (host, path); p: the documents' own probabilities. The posterior without the document itself, and the combination."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for (h, k), x in zip(rows, p, strict=True):
        hosts[h].append(x)
        paths[h, k].append(x)
    mean = np.mean(p)
    of_host = sum(len(x) * (np.mean(x) - mean) ** 2 for x in hosts.values()) / len(p)
    within = sum(len(x) * (np.mean(x) - np.mean(hosts[h])) ** 2 for (h, _), x in paths.items()) / len(p)
    size = lambda spread: min(max(mean * (1 - mean) / spread - 1 if spread > 1e-15 else 1e9, quality.PRIOR_SIZE[0]), quality.PRIOR_SIZE[1])
    logit = lambda x: math.log(x / (1 - x))
    out = []
    for (h, k), x in zip(rows, p, strict=True):
        up = (size(of_host) * mean + sum(hosts[h]) - x) / (size(of_host) + len(hosts[h]) - 1)
        at = (size(within) * up + sum(paths[h, k]) - x) / (size(within) + len(paths[h, k]) - 1)
        out.append((at, 1 / (1 + math.exp(-(logit(min(max(x, 1e-6), 1 - 1e-6)) + logit(at) - logit(mean))))))
    return out


def test_posteriors(spark):
    texts = ["Good words, and more of them. " * 4, "# $ % ^ 11 22 33", "plain text without end", "A B C! D! 99%"]
    rows = [(i, texts[i % 4 if i % 5 else 0], f"h{i % 3}" if i % 7 else None, f"p{i % 2}" if i % 3 else "") for i in range(60)]
    rng = np.random.default_rng(0)
    x = np.array([quality.features(t) for t in texts * 5])
    model = quality.Classifier.fitted(x + rng.normal(0, 0.01, x.shape), np.array([1, 0, 1, 0] * 5, float))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sorted(quality.quality_classifier(df, model).collect(), key=lambda r: r.doc_id)
    own = model.score(np.array([quality.features(r[1]) for r in rows]))
    want = brute([(r[2] or "", r[3] or "") for r in rows], own)
    assert np.allclose([r.doc_quality for r in got], own)
    assert np.allclose([(r.site_quality, r.quality) for r in got], want, rtol=1e-6)
    assert all(r.kept == (r.quality >= quality.THRESHOLD) for r in got)


def test_sparse_sites_shrink(spark):
    """One bad document hardly lowers its site's posterior; many do."""
    model = quality.Classifier.fitted(np.array([quality.features("# # #"), quality.features("good words here")] * 30), np.array([0.0, 1.0] * 30))
    rows = [(i, "good words here", "big") for i in range(200)] + [(300 + i, "# # #", "bad") for i in range(100)] + [(500, "# # #", "new"), (501, "good words here", "new")]
    got = {r.doc_id: r for r in quality.quality_classifier(spark.createDataFrame(rows, "doc_id long, text string, source string"), model, path=F.lit("")).collect()}
    assert got[300].site_quality < 0.2 < got[501].site_quality < got[0].site_quality


def test_odd_tables(spark):
    schema = "doc_id long, text string, source string, lang string, kept string, g_host int, p int, t int, in_0 int"
    rows = [(None, None, None, None, "x", 1, 1, 1, 1), (1, "", "s", None, "x", 1, 1, 1, 1), (1, "", "s", None, "x", 1, 1, 1, 1), (2, "w " * 200_000, "s", "l", None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    for labels in ([], [(1, 1), (1, None), (None, 0)], [(1, 0), (2, 1), (2, 1)]):
        model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = quality.quality_classifier(df, model)
        assert got.count() == 4 and got.columns.count("kept") == 1
        assert quality.quality_classifier(df.limit(0), model).count() == 0


def test_words_are_evidence(spark):
    """Classes that differ in their words only."""
    rng = np.random.default_rng(5)
    text = lambda kind: " ".join(f"{kind}{i}" if rng.random() < 0.3 else f"x{i}" for i in rng.integers(0, 200, 40))
    rows = [(i, text("good" if i % 2 else "poor"), "s", "l") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    got = quality.quality_classifier(docs, quality.fit(docs, labels)).collect()
    assert np.mean([r.kept == bool(r.doc_id % 2) for r in got if r.doc_id >= 300]) > 0.95


def test_query_against_a_plain_version(spark, sf):
    """The query's rows from the same features by plain loops; a tie at the threshold is kept."""
    from sedgewren.llm import queries

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = docs.collect()
    own = model.score(np.array([quality.features(r.text, model.ratio) for r in rows]))
    want = brute([(r.source or "", r.lang or "") for r in rows], own)
    got = {r.doc_id: r for r in queries.op3_quality_classifier(spark, sf).collect()}
    assert len(got) == len(rows)
    for r, (site, q) in zip(rows, want, strict=True):
        x = got[r.doc_id]
        assert abs(x.site_quality - site) < 1e-6 and abs(x.quality - q) < 1e-6 and (x.kept == (q >= 0.5) or abs(q - 0.5) < 1e-6)
    flat = quality.Classifier.fitted(np.empty((0, len(quality.FEATURES))), np.empty(0))
    same = quality.quality_classifier(docs, flat, carry=["doc_id"]).collect()
    assert all(abs(r.quality - 0.5) < 1e-12 for r in same)
