"""Secret scans against a plain loop over matches and pairs."""

import random
import re

from sedgewren.llm import secrets

IDENT, MIXED = "user: ada_l", "Ab1" * 12
TEXTS = [
    None, "", "nothing here", "password = hunter2x", 'PassWord": "abc', "api_key=ABCDEF token:abcdefg", "secret==abcdef", "password=token=abcdef1",
    "AKIA" + "Z" * 16, "AKIA" + "Z" * 15, "xAKIAAKIA" + "Q" * 20, "f" * 24, "f" * 23, "F" * 24, "é" * 300 + "0123456789abcdef" * 2,
    f"{IDENT} {MIXED}", f"{IDENT} {'x' * 195} {MIXED}", f"{IDENT} {'x' * 400} {MIXED}", f"{MIXED} postgres://db.example:5432", f"{IDENT} {MIXED} postgres://db.example:5432",
    "AKIA" + "Z" * 16 + " " + MIXED + " https://s3.example", f"password={MIXED} {IDENT}", f"login=bob password=qwerty1 ftp://h.example\n" * 3,
]


def matches(text):
    out = []
    for no, kind in enumerate(secrets.KINDS):
        regex, group, least = secrets.BASE_KINDS.get(kind) or (secrets.WEAK_KINDS[kind][0], 0, 0)
        needs = () if kind in secrets.BASE_KINDS else secrets.WEAK_KINDS[kind][1]
        out += [(m.start(), no, m.end()) for m in re.finditer(regex, text, re.A) if len(m[group]) >= least and all(re.search(n, m[0]) for n in needs)]
    return out


def brute(text):
    found, n_base = matches(text or ""), len(secrets.BASE_KINDS)
    out = [x for x in found if x[1] < n_base]
    for s, k, e in found:
        if k < n_base:
            continue
        near = [p for p in found if p[0] - secrets.SCOPE <= e and s <= p[2] + secrets.SCOPE]
        apart = [p for p in near if p[0] >= e or s >= p[2]]
        if any(p not in apart and p[1] < n_base for p in near):
            continue
        parts = {secrets.KINDS[p[1]] for p in apart}
        ident, secret = bool(parts & set(secrets.IDENTIFIERS)), bool(parts & set(secrets.SECRETS))
        if {"mixed": ident, "ident": secret, "endpoint": ident and secret}[secrets.KINDS[k]]:
            out.append((s, k, e))
    return sorted(out)


def contract(text):
    """The base spans as the contract words them."""
    text, out = text or "", []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for no, (regex, group, least) in enumerate(((assign, 2, 6), ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24))):
        out += [(m.start(), no, m.end()) for m in re.finditer(regex, text, re.A) if len(m[group]) >= least]
    return sorted(out)


def test_spans(spark):
    rng = random.Random(1)
    bits = [IDENT, MIXED, "password=abcdef9", "AKIA" + "7" * 16, "0a" * 15, "mysql://h.example/x", "word " * 9, "é\n", "🙂", " "]
    texts = TEXTS + ["".join(rng.choice(bits) + rng.choice(["", " ", " " * 90]) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    texts += ["w " * 300_000 + IDENT + " " + MIXED, TEXTS[3], TEXTS[3]]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, rid int, n_weak string")
    got = {r.doc_id: sorted((s.start, s.kind_no, s.end) for s in r.secret_spans) for r in secrets.secret_scan(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    n_base = len(secrets.BASE_KINDS)
    assert {i: [x for x in v if x[1] < n_base] for i, v in got.items()} == {i: contract(t) for i, t in enumerate(texts)}
    assert secrets.secret_scan(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = secrets.secret_scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
