"""Queries on tables in which their method decides, and plans without Python where the operator is native."""

import os
import random

import duckdb
import pytest
from conftest import plain, rows

from sedgewren.llm import queries


def table(spark, path, name, data, schema):
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")


def sql(path, name):
    con = duckdb.connect()
    for t in os.listdir(path):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{path}/{t}/*.parquet'")
    got = con.sql(queries.ORACLES[name])
    names = sorted(got.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in got.select(*[f'"{n}"' for n in names]).fetchall()), key=repr)


def test_op5_links_parts(spark, tmp_path):
    """Half of the documents have complementary weak parts; query and SQL agree on what links them."""
    rng, docs = random.Random(1), []
    mixed = lambda: "".join(rng.choices("abcdeABCDE012345", k=40)) + "aB1"
    parts = [lambda: f"user: {rng.choice(['ann', 'bo_b', 'c.d'])}", mixed, lambda: f"postgres://db{rng.randrange(9)}.example:5432", lambda: "password = hunter2x", lambda: "AKIA" + "Q" * 17, lambda: "0123456789abcdef" * 2]
    for i in range(400):
        words = []
        for _ in range(rng.randrange(5)):
            words += [rng.choice(parts)(), "é" * rng.choice([1, 5, 150, 199, 260])]
        docs.append((i, " ".join(words)))
    docs += [(400, None), (401, ""), (402, docs[1][1]), (402, docs[1][1])]
    table(spark, tmp_path, "documents", docs, "doc_id long, text string")
    got = queries.op5_secret_scan(spark, str(tmp_path))
    names, want = sql(tmp_path, "op5_secret_scan")
    assert sorted(got.columns) == names and rows(got) == want
    found = [r.n_weak for r in got.collect()]
    assert sum(n > 0 for n in found) > 60 and sum(n == 0 for n in found) > 100


def test_op3_sites_decide(spark, tmp_path):
    """The same middling text is kept where its site is good and goes where it is bad: only the posteriors tell."""
    rng, docs, labels = random.Random(2), [], []
    good, bad = "study result method paper theory review proof section".split(), "win cash click free now cheap deal spin".split()
    both = lambda: " ".join(rng.choice(good if k % 2 else bad) for k in range(40))
    middling = [both() for _ in range(60)]
    for i in range(1200):
        site = i % 2
        text = " ".join(rng.choices(good if site else bad, k=40)) + "."
        docs.append((i, text, "en", f"site{site}"))
        if i % 3 == 0:
            labels.append((i, site, 0))
    for i, t in enumerate(middling):
        docs += [(2000 + i, t, "en", "site0"), (3000 + i, t, "en", "site1")]
        if i < 30:
            labels.append((2000 + i, i % 2, 0))
    table(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string, source string")
    table(spark, tmp_path, "labels", labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in queries.op3_quality_classifier(spark, str(tmp_path)).collect()}
    pairs = [(got[2000 + i], got[3000 + i]) for i in range(60)]
    assert all(a.doc_quality == b.doc_quality and a.site_quality < 0.3 < 0.7 < b.site_quality for a, b in pairs)
    assert sum(b.kept and not a.kept for a, b in pairs) > 30 and not any(a.kept and not b.kept for a, b in pairs)
    assert sum(got[i].kept == bool(i % 2) for i in range(1200)) > 1150


@pytest.mark.parametrize("name", ["op5_secret_scan", "op9_quality_rules", "op10_mixing"])
def test_native_plans_have_no_python(spark, sf, name, monkeypatch):
    """Neither the plan nor what was cut from it runs Python."""
    plans, real = [], type(spark.range(1)).checkpoint

    def seen(df, *a, **b):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *a, **b)

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", seen)
    out = queries.QUERIES[name](spark, sf)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not any(word in p for p in plans for word in ("Python", "Pandas", "InArrow", "InPandas", "ArrowEval"))
