"""Encoding against the sentencepiece library, spans against the text."""

import random

import pytest
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as proto

from sedgewren.llm import pieces, queries

TEXTS = [
    None, "", " ", "  a  b ", "\n", "a\nb\r\n\tc", "▁", "a▁b ▁ c", "🙂🙃 é é ﬁ Ａ", "<unk> <s></s> <0x41>", "\x00x\x01", "你好世界 אבג", "x" * 500, "a " * 300, "​﻿z",
    "ab" * 40 + " " + "ba" * 50, "word " * 100_000, "ꙮ", "á" * 100, "�",
]


@pytest.fixture(scope="module")
def path():
    return queries.piece_model()


def all_texts():
    rng = random.Random(6)
    letters = "abcdefgh  \n éüßñ▁.,;1234你🙂ꙮ́"
    return TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 120))) for _ in range(300)]


def check(spark, path, texts):
    library = SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece_ids string")
    coded = pieces.encode_pieces(df, path)
    got = pieces.decode_pieces(coded, path).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        want = library.encode(text, add_eos=True)
        assert r.piece_ids == want and r.decoded == library.decode(want)
        proto_pieces = [*library.encode(text, return_type="proto").pieces, None]
        assert len(r.piece_ends) == len(want) and r.piece_ends == sorted(r.piece_ends)
        size = len(text.encode())
        assert r.piece_ends[-1] == (size if text.strip(" ") or not trims(path) else r.piece_ends[-1])
        if trims(path):
            continue
        for end, p, i in zip(r.piece_ends, proto_pieces, want, strict=True):
            if p and not library.is_byte(i):
                assert end == p.end


def trims(path):
    m = proto.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    return m.normalizer_spec.remove_extra_whitespaces


def test_as_the_library(spark, path):
    check(spark, path, all_texts())


@pytest.mark.parametrize(("rule", "trim"), [("nmt_nfkc", True), ("nmt_nfkc", False), ("nfkc_cf", True), ("identity", True)])
def test_with_a_character_map(spark, path, tmp_path, rule, trim):
    """The given vocabulary behind real compiled maps: composed and compatibility characters, case folding, odd spaces."""
    from sentencepiece import SentencePieceNormalizer

    m, other = proto.ModelProto(), proto.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    other.ParseFromString(SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    m.normalizer_spec.name, m.normalizer_spec.precompiled_charsmap = rule, other.normalizer_spec.precompiled_charsmap
    m.normalizer_spec.remove_extra_whitespaces = trim
    mapped = tmp_path / "mapped.model"
    mapped.write_bytes(m.SerializeToString())
    odd = ["ＡＢＣ ｄｅｆ　ｇ", "ﬁne ﬂow ½ ㍿", "e\u0301a\u0308 é", "\u00a0\u2003 x \u200b y\u00ad", "STRAẞE Ǆ İ", "   lead", "trail   ", "   ", "\u0001\u0002 a", "가각ᄀ", "①②③ ™"]
    check(spark, str(mapped), all_texts() + odd)


def test_whole_table_as_the_library(spark, path):
    """All of sf0.01's documents; the library is used here only."""
    library = SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pieces.decode_pieces(pieces.encode_pieces(docs, path), path).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r.doc_id], add_eos=True)
        assert r.piece_ids == want and r.decoded == library.decode(want)


def test_compiled_map_by_longest_prefix():
    """A map of two rules, built by hand: `a` to `x`, `ab` to `yz`; the longer wins."""
    import numpy as np

    units, values = np.zeros(1024, np.uint32), b"x\0yz\0"
    root = 256

    def put(at, label, offset, leaf):
        units[at] = label | (offset << 10) | (leaf << 8)

    units[0] = root << 10
    at = root ^ ord("a")
    put(at, ord("a"), at ^ 512, 1)
    units[512] = 0 | 1 << 31
    at2 = 512 ^ ord("b")
    put(at2, ord("b"), at2 ^ 768, 1)
    units[768] = 2 | 1 << 31
    blob = units.astype("<u4").tobytes()
    chars = pieces.CharMap(len(blob).to_bytes(4, "little") + blob + values)
    assert chars.longest(b"abc", 0) == (2, b"yz") and chars.longest(b"ac", 0) == (1, b"x") and chars.longest(b"b", 0) is None


def test_no_rows(spark, path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode_pieces(pieces.encode_pieces(df, path), path).count() == 0
