"""The operators' queries: against their SQL, or their contract, on a driver's table."""

import json
from hashlib import sha256
from pathlib import Path

import pytest
from conftest import rows, sql_rows
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from sedgewren.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    names, want = sql_rows(duck, queries.ORACLES[name])
    assert sorted(got.columns) == names
    assert rows(got) == want


def documents(duck):
    return duck.sql("SELECT doc_id, text FROM documents").fetchall()


def test_op7(spark, sf, duck):
    library = SentencePieceProcessor(model_file=queries.piece_model())
    want = {}
    for i, text in documents(duck):
        ids = library.encode(text or "", add_eos=True)
        want[i] = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_pieces(spark, sf).collect()} == want


def test_op4_has_every_document(spark, sf, duck):
    got = {r.doc_id: r for r in queries.op4_simhash(spark, sf).collect()}
    assert set(got) == {i for i, _ in documents(duck)}
    prints = {}
    for i, r in got.items():
        prints.setdefault(r.fingerprint, set()).add(r.component_id)
        assert got[r.component_id].component_id == r.component_id <= i and len(r.fingerprint) == 16
    assert all(len(x) == 1 for x in prints.values())


def test_op6_and_op8_shapes(spark, sf, duck):
    assert queries.op6_pii(spark, sf).count() == len(documents(duck))
    pages = queries.op8_main_text(spark, sf).collect()
    assert len(pages) == duck.sql("SELECT * FROM pages").fetchall().__len__()
    assert all(r.n_chars == len(r.text) for r in pages)


def test_entry_registers_all(spark):
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")] + ["pipeline"]
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{i}" for i in range(1, 14)] and len(corpus_pipeline.STAGES) == 5
    json.dumps(__spark_entry__.oracle_sql())
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"
