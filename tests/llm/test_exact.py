"""Exact dedup against a dictionary of texts."""

import random
from collections import defaultdict
from hashlib import sha256

import pytest

from sedgewren.llm import exact

UP = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), digest) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_groups(spark, partitions):
    rng = random.Random(partitions)
    rows = [(None, None), (None, ""), (4, ""), (5, "Ä"), (6, "ä"), (7, "İ"), (8, "A b\n"), (9, "a B\n"), (9, "a b\n"), (9, "a b\n"), (10, "a b")]
    rows += [(100 + i, "copy " * 50 + rng.choice("xyzXYZ")) for i in range(400)]  # few groups hold most rows and reach over partitions
    rows += [(1000 + i, "long " * 200_000 + "Ab"[i % 2]) for i in range(4)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert {k: v for k, v in kept.items()} == {d: [keep] for _, keep, _, d in brute(rows)}


def test_all_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", 2, 3, True, "h")], "doc_id long, text string, run_id int, run_text int, KEPT boolean, run_sha256 string")
    got = exact.exact_dedup(df)
    assert got.first().asDict() == {"doc_id": 1, "text": "a", "run_id": 2, "run_text": 3, "run_sha256": "h", "keep_id": 1, "group_size": 1, "kept": True, "text_sha256": sha256(b"a").hexdigest()}
    assert exact.exact_dedup(df.limit(0)).count() == 0
