"""Packing: ids as the library gives them, every id once, nothing padded, and the greedy choice against a plain loop."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from sedgewren.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 7))) for _ in range(300)]
    made = [" ".join(rng.choices(words[k * 60 : k * 60 + 90], k=rng.choice([1, 5, 20, 60, 200]))) for k in (rng.randrange(4) for _ in range(n))]
    return made + [None, "", " \n ", "It's John's, don't! we'll 3½ <|endoftext|> x<|startoftext|>y", "é ́a İI ΑΣ Σ b c\x1cd\x85e", "🙂👍🏽 中文字 ١٢٣", made[0], made[0], "word " * 3000, "x" * 5000, "tab\tsep\r\nline"]


def test_ids_are_the_library_s(library, monkeypatch):
    words = packing.Words(PATH)
    for piece in (packing.PIECE, 16):
        monkeypatch.setattr(packing, "PIECE", piece)
        for t in texts(1, 80):
            assert [i for p in packing.pieces(t or "") for i in np.frombuffer(words.ids(pa.array([p]))[0], "<u2")] == ids_of(library, t)[:-1]
    made = [t or "" for t in texts(2, 30)] + ODD
    for w in (words, packing.Words(PATH)):
        assert [np.frombuffer(x, "<u2").tolist() for x in w.ids(pa.array(made))] == [ids_of(library, t)[:-1] for t in made]
    monkeypatch.setattr(packing, "KNOWN", 5)
    few = packing.Words(PATH)
    for t in made:
        assert np.frombuffer(few.ids(pa.array([t]))[0], "<u2").tolist() == ids_of(library, t)[:-1]


ODD = ["e\u0301!! a\u030a?", "Straße!! ΑΣ!! ΣΑΣ. İI!", "<|endoftext|>!! x<|endoftext|>", "<|ENDOFTEXT|>", "a<|endof text|> <|", "don't!! 'TIS it's' o'clock.\"'", "1st!! 2nd, x1! y²! ½!", "名前!! カナ。!", "a…!! b—c! d\u00a0e! f\u2003g", "ǅ! ﬁ! ＡＢ!", "!!! ??? ... a!b?c", "\u0338!! <\u0338 =\u0338", "__init__! _a_ a_!", "x\x00! y\x1c! z\x85!"]


def test_random_words_as_the_library(library):
    rng = random.Random(6)
    letters = "abCD'!.<|>éßİσΣ1½_-\u0301\u0338名…"
    made = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(40)) for _ in range(150)]
    assert [np.frombuffer(x, "<u2").tolist() for x in packing.Words(PATH).ids(pa.array(made))] == [ids_of(library, t)[:-1] for t in made]


def checked(rows, made, library, window):
    """The contract's conditions over all pieces."""
    ids = {i: ids_of(library, t) for i, t in enumerate(made)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert set(by_doc) == set(ids)
    for i, found in by_doc.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: nothing is padded


@pytest.mark.parametrize("shard", [packing.SHARD, 4000])
def test_every_id_once(spark, library, shard):
    made = texts(3, 150)
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS top").repartition(3)
    rows = packing.pack(df, PATH, shard=shard).collect()
    checked(rows, made, library, packing.WINDOW)
    small = packing.pack(df, PATH, window=64, shard=shard).collect()
    checked(small, made, library, 64)


def plain(docs, window):
    """docs (id, ids) in the shard's order: windows as lists of (id, start, length), by the definition."""
    n = len(docs)
    df = Counter(t for _, x in docs for t in set(x))
    mean = sum(len(x) for _, x in docs) / n
    weight = lambda t, x: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / mean))
    unused, out, open_, seed, start = list(range(n)), [], [], None, 0
    room = lambda: window - sum(p[2] for p in open_)
    while unused or seed is not None:
        if seed is None:
            seed, start = unused.pop(0), 0
        query, ident = set(docs[seed][1]), docs[seed][0]
        while start < len(docs[seed][1]):
            k = min(room(), len(docs[seed][1]) - start)
            open_.append((ident, start, k))
            start += k
            if not room():
                out.append(open_)
                open_ = []
        seed = None
        if not open_:
            continue
        for i in sorted(unused, key=lambda i: (-round(sum(weight(t, docs[i][1]) for t in query if t in set(docs[i][1])), 9), i)):
            unused.remove(i)
            k = min(room(), len(docs[i][1]))
            open_.append((docs[i][0], 0, k))
            if not room():
                out.append(open_)
                open_ = []
                if k < len(docs[i][1]):
                    seed, start = i, k
                break
    return [*out, open_] if open_ else out


def test_neighbours_as_a_plain_loop_finds_them(library):
    made = [t for t in dict.fromkeys(texts(5, 120)) if t]
    docs = [(i, np.array(ids_of(library, t), "<u2")) for i, t in enumerate(made)]
    df = Counter(t for _, x in docs for t in set(x.tolist()))
    rows = [{"id": -1, "docs": len(docs), "tokens": sum(len(x) for _, x in docs)}, *({"id": int(t), "docs": n, "tokens": 0} for t, n in df.items())]
    work = packing.Packer(packing.Statistics(rows), 256, 0)
    work.shard(docs)
    got = {}
    for ident, start, length, _, _, sequence, _ in work.out:
        got.setdefault(sequence, []).append((ident, start, length))
    want = plain([(i, x.tolist()) for i, x in docs], 256)
    assert [*got.values(), *([[(i, s, len(x)) for i, s, x, _ in work.open]] if work.open else [])] == want


def test_windows_gather_related_documents(spark):
    """Four vocabularies in turn: nearly all windows hold one of them."""
    rng = random.Random(9)
    made = [" ".join(rng.choices([f"{'abcd'[i % 4]}{w}q" for w in range(40)], k=60)) for i in range(400)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), PATH).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.sequence_id, Counter())[r.doc_id % 4] += r.length
    assert sum(max(c.values()) for c in kinds.values()) > 0.85 * sum(r.length for r in rows)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, PATH).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r)[:3] + tuple(r)[4:5] + (r.offset,) for r in packing.pack(one, PATH).collect()] == [(None, 0, 1, 1, 0)]
    with pytest.raises(ValueError):
        packing.pack(one, PATH, window=1000)
