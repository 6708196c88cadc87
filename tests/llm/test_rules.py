"""Quality rules: facts against a plain count, thresholds by group."""

import random
import re
from collections import Counter

from sedgewren.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_facts_and_base(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a\nb\na\n a\n\n", "# * $ % & | < > x", "a b c d e " * 3, "a a a a a a", "a a a a a", "\x1cword\x1c x\x0by\x85z", "🙂 é\r\nx\r\n🙂 é\r\n", "x y " * 20_000]
    texts += ["".join(rng.choice(["ab", "c", "d", "e", "#"]) + rng.choice([" ", "  ", "\n", " ", "\t"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "x", None, 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, kept int")
    got = {r.doc_id: r for r in rules.quality_rules(df).collect()}
    assert {i: tuple(r[f] for f in rules.FACTS) for i, r in got.items()} == {i: brute(t) for i, t in enumerate(texts)}
    for i, t in enumerate(texts):
        n, *_, repeated = brute(t)
        assert got[i].base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert got[i].kept == (not got[i].base_failed and not got[i].failed)
    assert rules.quality_rules(df.limit(0)).count() == 0


def with_symbols(words, n):
    return " ".join(w + " #" * (i < n) for i, w in enumerate(words))


def test_thresholds_follow_the_group(spark):
    """A share of symbols that is usual in one source is an outlier in another."""
    rng, data = random.Random(4), []
    for source, usual in (("code", 14), ("prose", 0)):
        for i in range(300):
            words = with_symbols([f"w{rng.randrange(5000)}" for _ in range(30)], usual + rng.randint(0, 2))
            data.append((f"{source}{i}", words, "en", source))
        data.append((f"{source}-odd", with_symbols([f"w{i}" for i in range(30)], 15), "en", source))
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(data, "doc_id string, text string, lang string, source string")).collect()}
    assert got["code-odd"].kept and not got["prose-odd"].kept and list(got["prose-odd"].failed) == ["symbols_per_word"]
    assert sum(not r.kept for r in got.values()) == 1


def test_sketches_merge(spark):
    """Quantiles of a merged sketch are within the relative error of the true ones."""
    rng = random.Random(8)
    values = [rng.lognormvariate(0, 1) for _ in range(3000)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    cells = df.select(rules.cell(df.x).alias("cell")).repartition(5).groupBy("cell").count().withColumnRenamed("count", "n")
    got = rules.quartiles(cells.selectExpr("'m' AS metric", "cell", "n"), []).first()
    values.sort()
    for k, q in enumerate((got.q1, got.q2, got.q3), 1):
        true = values[(len(values) * k + 3) // 4 - 1]
        assert abs(q / true - 1) <= (rules.GAMMA - 1) / 2 + 1e-9


def test_each_metric_alone_rejects(spark):
    """In a clean group each metric can fire within the base rules; what lies on a fence stays; repeated rows are judged alike."""
    rng, data = random.Random(6), []
    word = lambda k=5: "".join(rng.choices("abcdefghijklmnop", k=k))
    text = lambda n, k=5: [word(k) for _ in range(n)]
    for i in range(300):
        data.append((f"clean{i}", "\n".join(" ".join(text(10)) for _ in range(10))))
    odd = {
        "symbols_per_word": " ".join(w + "#" * (i % 5 == 0) for i, w in enumerate(text(100))),
        "dup_line_share": "\n".join(x for i in range(8) for x in [" ".join(text(12)), *["again here"] * (i % 2)]),
        "repeat_word_share": " ".join([*(passage := text(9)), *text(50), *passage, *text(50)]),
        "chars_per_word": " ".join(text(100, 9)),
        "chars_per_word ": " ".join(text(100, 1)),
    }
    data += [(k, t) for k, t in odd.items() for _ in range(2)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in data], "doc_id string, text string, lang string, source string")
    got = rules.quality_rules(df, carry=["doc_id"]).collect()
    for r in got:
        assert not r.base_failed, r.doc_id
        assert list(r.failed) == ([r.doc_id.strip()] if r.doc_id in odd else []), r
    assert len(got) == len(data)
    fence = rules.thresholds(df.sparkSession.createDataFrame([("en", "s", False, *[0.5] * 4)] * 200, "g_lang string, g_source string, base_failed boolean, " + ", ".join(f"{m} double" for m in rules.METRICS))).first()
    assert fence.high_repeat_word_share > 0.5  # equal values lie within
