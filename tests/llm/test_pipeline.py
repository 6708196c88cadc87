"""The pipeline stage by stage on a small table, against plain versions of its stages."""

import random

import pytest
from sentencepiece import SentencePieceProcessor
from test_mixing import shares

import corpus_pipeline
from sedgewren.llm import mixing, quality, queries

WORDS = [f"word{i}" for i in range(800)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, texts = random.Random(21), []
    for _ in range(60):
        base = [rng.choice(WORDS) for _ in range(rng.randint(60, 200))]
        prose = lambda w: ". ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)).capitalize() + "."
        texts.append((prose(base), 1))
        if rng.random() < 0.5:
            texts.append((prose(base).upper(), 1))  # an exact copy but for case
        if rng.random() < 0.5:
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            texts.append((prose(near), 1))
    texts += [(" ".join(rng.choice(["#", "$$", "%%%", "1234", "|"]) for _ in range(80)), 0) for _ in range(20)] + [(None, 0), ("", 0)]
    docs = [(i, t, rng.choice(["en", "de", None]), f"src{rng.randrange(5)}", len(t or "")) for i, (t, _) in enumerate(texts)]
    out = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    labels = [(i, q, 0) for i, (_, q) in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), {d[0]: d for d in docs}, dict(enumerate(q for _, q in texts))


def test_stages(spark, folder):
    out, docs, labels = folder
    table = spark.read.parquet(f"{out}/documents.parquet")
    kept = set(docs)
    got = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, table, out)
        if i < 4:
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            path = f"{out}/stage{i}"
            df.write.parquet(path)
            table = spark.read.parquet(path)
            got.append(sorted(r.doc_id for r in table.select("doc_id").collect()))
        else:
            final = df.collect()
    # Quality: what the fitted classifier keeps; it keeps the good and drops the junk here.
    assert set(got[0]) == {i for i in docs if labels[i]}
    # Exact copies: the largest id of equal texts.
    low = {}
    for i in got[0]:
        key = docs[i][1].lower()
        low[key] = max(i, low.get(key, i))
    assert got[1] == sorted(low.values())
    # Near copies: the smallest id of texts that share 0.8 of their five-word shingles or more.
    sets = {i: shingles(docs[i][1]) for i in got[1]}
    first = {i: min(j for j in got[1] if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8) for i in got[1]}
    assert got[2] == [i for i in got[1] if first[i] == i]
    # Mixing: half of the tokens, shared by weight through domain, language and source.
    assert got[3] == plain_mix([docs[i] for i in got[2]])
    # Encoding: every copy of every chosen document, as the library does it.
    library = SentencePieceProcessor(model_file=queries.piece_model())
    assert sorted(r.doc_id for r in final) == got[3]
    for r in final:
        assert r.piece_ids == library.encode(docs[r.doc_id][1], add_eos=True) and r.n_tokens == len(r.piece_ids)
    assert kept and sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, out).collect()) == sorted((r.doc_id, r.n_tokens) for r in final)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_mix(docs):
    from hashlib import md5

    tree: dict = {}
    for i, text, lang, source, _ in docs:
        tree.setdefault(f"domain{int(source[3:]) % 4}", {}).setdefault(lang or "", {}).setdefault(source, []).append((str(i), len(text.split())))
    tokens = lambda x: sum(map(tokens, x.values())) if isinstance(x, dict) else sum(n for _, n in x)
    epochs, out = mixing.MAX_EPOCHS, []

    def down(node, budget, level):
        if isinstance(node, list):
            want, total = int(budget + 1e-6), tokens(node)
            whole = min(want // total, epochs)
            left = want - whole * total
            out.extend(int(i) for _ in range(whole) for i, _ in node)
            for _, i, n in sorted((md5(f"{mixing.SEED}:{whole}:{i}".encode()).hexdigest(), i, n) for i, n in node) if whole < epochs else ():
                left -= n
                if left < 0:
                    break
                out.append(int(i))
            return
        weight = mixing.WEIGHTS.get(level[0], {})
        for k, b in shares(budget, {k: (tokens(v) * epochs, weight.get(k, 1)) for k, v in node.items()}).items():
            down(node[k], b, level[1:])

    down(tree, int(tokens(tree) * mixing.BUDGET_SHARE), ["domain", "lang", "source", ""])
    return sorted(out)


def test_empty_table(spark, folder, tmp_path):
    out, _, _ = folder
    spark.read.parquet(f"{out}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{out}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")) is not None


def test_odd_rows_and_names(spark, folder, tmp_path):
    """Repeated rows, rows without an id, a very long text and extra columns named like results: every stage keeps the columns' values."""
    out, docs, _ = folder
    rows = [(*d, "mine", d[0], i) for i, d in enumerate(list(docs.values())[:60])]
    long = " ".join(f"long{i % 977} and{i}." for i in range(60_000)).capitalize()
    rows += [rows[0], rows[0], (None, rows[3][1] + " Once more.", "en", "src1", 1, "mine", 7, 900), (5000, long, "en", "src2", len(long), "mine", 8, 901)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id long, node int"
    table = spark.createDataFrame(rows, kinds)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        got = stage(spark, table, out)
        assert got.columns == table.columns
        got.write.parquet(f"{tmp_path}/{i}")
        table = spark.read.parquet(f"{tmp_path}/{i}")
        assert {tuple(r) for r in table.collect()} <= set(rows) and table.count() > 0
        if i == 1:
            ids = [r.doc_id for r in table.collect()]
            assert len(ids) == len(set(ids))
    assert corpus_pipeline.encode(spark, table, out).count() == table.count()
