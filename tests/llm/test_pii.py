"""Pseudonyms: permutations, formats, links across documents and the way back."""

import random
import re
from datetime import date

import pytest

from sedgewren.llm import pii

KEY = b"k"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation(size):
    got = [pii.permute(i, size, KEY, b"t") for i in range(size)]
    assert sorted(got) == list(range(size)) and [pii.permute(x, size, KEY, b"t", True) for x in got] == list(range(size))


VALUES = {
    "card": ["4111 1111 1111 1111", "5500-0055-5555-5559", "378282246310005"],
    "ip": ["192.168.0.1", "8.8.8.8", "255.255.255.255"],
    "date": ["2020-02-29", "31.12.1999", "05/11/2001", "12/25/2010", "2000/01/31", "1873-05-09", "0001-01-01", "31/12/9999", "2100-01-01"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"],
    "mail": ["ada.l@example.com", "x@mail.shop.example.org"],
    "phone": ["+49 30 1234567", "(212) 555-0199", "212-555-0199"],
}


def shape(text):
    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", text)))


@pytest.mark.parametrize("kind", VALUES)
def test_formats_and_way_back(kind):
    for value in VALUES[kind]:
        text, spans = pii.pseudonymise(f"é see {value}, then", KEY)
        assert [(k, s, e) for k, s, e, _ in spans] == [(kind, 6, 6 + len(value))]
        new = spans[0][3]
        assert text == f"é see {new}, then" and pii.pseudonymise(text, KEY, inverse=True)[0] == f"é see {value}, then"
        if kind != "ip":  # numbers of other lengths
            assert shape(new) == shape(value)
        if kind == "card":
            d = re.sub(r"\D", "", new)
            assert pii.luhn_digit(d[:-1]) == d[-1]
        if kind == "iban":
            p = new.replace(" ", "")
            assert pii.iban_check(p[:2], p[4:]) == p[2:4]
        if kind == "date" and "-" in new:
            date.fromisoformat(new)


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "256.1.1.1", "2021-02-29", "DE88370400440532013000", "a@b", "version 1.2.3", "12345", "", "99/99/2000"])
def test_invalid_values_stay(text):
    assert pii.pseudonymise(text, KEY) == (text, [])


def test_documents(spark):
    rng = random.Random(4)
    values = [v for x in VALUES.values() for v in x]
    rows = [(i, ", ".join(rng.choice(["word", "é🙂", *values]) for _ in range(rng.randint(0, 30))), "old") for i in range(100)]
    rows += [(200, None, "x"), (201, "", "x"), (202, "w " * 200_000 + values[0], "x"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, PII_spans string")
    got = pii.pseudonyms(df, key=KEY)
    new, links = got.collect(), {}
    assert len(new) == len(rows)
    by_id = {i: t for i, t, _ in rows}
    for r in new:
        assert (r.text is None) == (by_id[r.doc_id] is None)
        for s in r.pii_spans or []:
            old = by_id[r.doc_id][s.start : s.end]
            assert links.setdefault((s.kind, old), s.value) == s.value
    assert len(set(links.values())) == len(links) > 10
    back = {r.doc_id: r.text for r in pii.pseudonyms(got.drop("pii_spans"), key=KEY, inverse=True).collect()}
    assert back == by_id
    assert pii.pseudonyms(df.limit(0), KEY).count() == 0


def plain_spans(text):
    """Every value by brute force: each place in turn, each kind, each end, with checks of its own."""
    out, at = [], 0
    for i in range(len(text)):
        if i < at:
            continue
        for kind, regex, _ in pii.EACH:
            m = regex.match(text, i)
            ends = [m.end()] if m else []
            if m and kind in ("card", "iban"):
                ends += [e for e in range(m.end() - 1, i, -1) if text[e] in " -" and regex.fullmatch(text, i, e)]
            end = next((e for e in ends if valid(kind, text[i:e])), None)
            if end is not None:
                out.append((kind, i, end))
                at = end
                break
    return out


def valid(kind, v):
    digits = [int(c) for c in v if c in "0123456789"]
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    if kind == "iban":
        p = v.replace(" ", "")
        return 15 <= len(p) <= 34 and int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97 == 1 and 2 <= int(p[2:4]) <= 98
    if kind == "ip":
        return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in v.split("."))
    if kind == "date":
        x, y, z = map(int, re.split(r"[-/.]", v))
        return any(exists(*o) for o in ([(x, y, z)] if len(re.split(r"[-/.]", v)[0]) == 4 else [(z, y, x), (z, x, y)]))
    if kind == "phone":
        plus = re.match(r"\+\d{1,3}(?=[ (.-])|\+\d{2}|0|", v)[0]
        return 6 <= len(re.sub(r"\D", "", v[len(plus) :])) <= 14
    return True


def exists(y, m, d):
    try:
        return bool(date(y, m, d))
    except ValueError:
        return False


def test_query_by_brute_force(spark, sf):
    """Spans and texts of the query over a whole table; the values undo to what was there and link equal ones."""
    from sedgewren.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op6_pii(spark, sf).collect()}
    assert got.keys() == texts.keys()
    links, found = {}, 0
    for i, text in texts.items():
        spans = plain_spans(text or "")
        assert got[i].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in spans) and got[i].n_values == len(spans)
        new = got[i].text
        shift = 0
        for kind, s, e in spans:
            old = text[s:e]
            back = [x for x in pii.pseudonymise(text, queries.PII_KEY)[1] if (x[1], x[2]) == (s, e)][0][3]
            assert new[s + shift : s + shift + len(back)] == back and links.setdefault((kind, old), back) == back
            shift += len(back) - (e - s)
            found += 1
        assert (new is None) == (text is None) and len(new or "") == len(text or "") + shift
    assert found > 5 and len({(k, v) for (k, _), v in links.items()}) == len(links)
