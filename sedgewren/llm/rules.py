"""Quality rules with adaptive thresholds, in DataFrame operations only.

Facts are counted per text. Each metric is put on a logarithmic grid and counted per language, source and cell: a quantile sketch
with a fixed relative error whose parts merge by adding counts, whatever the order. Thresholds are fences around the quartiles of
a group, as wide as the group's own spread (between its quartiles, or from its median to its ninth decile); those of a group with few documents come from its language's merged sketch, or else from that of all rows. The thresholds
are joined back and filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, written

#: White space of the word rule, and the characters that count as symbols.
SPACE, SYMBOLS = " \t-\r", "#*$%&|<>"
#: Base rules: fewest words, and the largest share in percent of words in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Sketch: relative error of a quantile is at most (GAMMA - 1) / 2.
GAMMA = 1.05
#: A group with fewer documents takes the thresholds of its language, a language with fewer those of all rows.
MIN_GROUP = 200
#: Metric: (fence in spreads, smallest spread in parts of the median, smallest spread, both sides). In a group that is all alike each
#: metric can fire within the base rules.
METRICS = {
    "symbols_per_word": (4.0, 0.25, 0.03, False),
    "dup_line_share": (4.0, 0.25, 0.05, False),
    "repeat_word_share": (4.0, 0.25, 0.03, False),
    "chars_per_word": (5.0, 0.12, 0.4, True),
}
FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_facts(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """The columns of keep and FACTS, as longs."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    rows = df.select(*keep, F.coalesce(text, F.lit("")).alias("f_text"), body.alias("f_body"))
    lines = F.filter(F.split("f_text", "\n", -1), lambda x: F.rlike(x, F.lit("[^ \t-\r]")))
    rows = rows.select(
        "*",
        F.when(F.col("f_body") == "", F.array().cast("array<string>")).otherwise(F.split("f_body", "[ \t-\r]+")).alias("f_words"),
        lines.alias("f_lines"),
    )
    n = F.size("f_words")
    hashes = F.when(
        n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("f_words", i + k) for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("*", hashes.alias("f_hashes"))
    # Only texts in which a window occurs again pay for the sort that finds where.
    again = F.size(F.array_distinct("f_hashes")) < F.size("f_hashes")
    paired = F.when(again, F.sort_array(F.transform("f_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select("*", paired.alias("f_pairs"))
    twice = F.filter(
        "f_pairs",
        lambda p, k: F.coalesce(p["h"] == F.get("f_pairs", k - 1)["h"], F.lit(False)) | F.coalesce(p["h"] == F.get("f_pairs", k + 1)["h"], F.lit(False)),
    )
    rows = rows.select("*", F.sort_array(F.transform(twice, lambda p: p["i"])).alias("f_at"))
    covered = F.transform("f_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("f_at", k + 1) - p, F.lit(WINDOW))))
    name = dict(zip(FACTS, FACTS, strict=True))
    return rows.select(
        *[F.col(c) for c in df.select(*keep).columns],
        n.cast("long").alias(name["n_words"]),
        (F.length("f_text") - F.regexp_count("f_text", F.lit("[ \t-\r]"))).cast("long").alias(name["word_chars"]),
        F.regexp_count("f_text", F.lit("[#*$%&|<>]")).cast("long").alias(name["n_symbols"]),
        (F.size("f_lines") - F.size(F.array_distinct("f_lines"))).cast("long").alias(name["n_dup_lines"]),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias(name["n_repeat_words"]),
        F.size("f_lines").cast("long").alias("n_lines"),
    )


def metric_columns() -> dict[str, Column]:
    per_word = lambda c: F.try_divide(F.col(c).cast("double"), F.col("n_words").cast("double"))
    return {
        "symbols_per_word": per_word("n_symbols"),
        "dup_line_share": F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines").cast("double")),
        "repeat_word_share": per_word("n_repeat_words"),
        "chars_per_word": per_word("word_chars"),
    }


def cell(x: Column) -> Column:
    """Grid cell of a value of 0 or more; 0 has a cell of its own."""
    return F.when(x > 0, F.ceil(F.log(x) / F.log(F.lit(GAMMA)))).otherwise(F.lit(-100_000)).cast("long")


def cell_value(c: Column) -> Column:
    return F.when(c > -100_000, 2.0 * F.pow(F.lit(GAMMA), c.cast("double")) / (GAMMA + 1.0)).otherwise(F.lit(0.0))


def quartiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """q1, q2, q3, q90 and the number of documents of each group's merged sketch."""
    merged = sketch.groupBy(*group, "metric", "cell").agg(F.sum("n").alias("n"))
    family = Window.partitionBy(*group, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(family.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("total", F.sum("n").over(family))
    q = lambda k, of: cell_value(F.min(F.when(F.col("upto") * of >= F.col("total") * k, F.col("cell"))))
    return ranked.groupBy(*group, "metric").agg(*[q(k, 4).alias(f"q{k}") for k in (1, 2, 3)], q(9, 10).alias("q90"), F.max("total").alias("docs"))


def thresholds(facts: DataFrame) -> DataFrame:
    """Per g_lang and g_source one row with low_ and high_ of every metric. facts: g_lang, g_source, base_failed and metric columns.

    Only documents that pass the base rules count. The sketch is checkpointed, so every task filters by the same thresholds."""
    passed = facts.where(~F.col("base_failed"))
    stacked = passed.select(
        "g_lang", "g_source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), cell(F.coalesce(F.col(m), F.lit(0.0))).alias("cell")) for m in METRICS])).alias("m")
    )
    sketch = cut(stacked.groupBy("g_lang", "g_source", "m.metric", "m.cell").agg(F.count(F.lit(1)).alias("n")))
    own, lang, every = (quartiles(sketch, g) for g in (["g_lang", "g_source"], ["g_lang"], []))
    pick = lambda t, at: t.select(*[c for c in t.columns if c.startswith("g_")], F.col("metric"), F.struct("q1", "q2", "q3", "q90", "docs").alias(at))
    joined = pick(own, "own").join(pick(lang, "of_lang"), ["g_lang", "metric"]).join(F.broadcast(pick(every, "of_all")), "metric")
    use = (
        F.when(F.col("own.docs") >= MIN_GROUP, F.col("own")).when(F.col("of_lang.docs") >= MIN_GROUP, F.col("of_lang")).otherwise(F.col("of_all"))
    )
    used = joined.select("g_lang", "g_source", "metric", use.alias("u"))
    aggs = []
    for m, (k, part, least, both) in METRICS.items():
        spread = F.greatest(F.col("u.q3") - F.col("u.q1"), F.col("u.q90") - F.col("u.q2"), F.col("u.q2") * part, F.lit(least))
        aggs.append(F.max(F.when(F.col("metric") == m, F.col("u.q3") + spread * k)).alias(f"high_{m}"))
        if both:
            aggs.append(F.max(F.when(F.col("metric") == m, F.col("u.q1") - spread * k)).alias(f"low_{m}"))
    return cut(used.groupBy("g_lang", "g_source").agg(*aggs))


def quality_rules(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The columns of `carry` (all by default), the five facts, base_failed, failed (names of the metrics out of bounds) and kept.

    Null text has no words and fails the base rules; null and empty language or source are one group. A group none of whose rows pass
    the base rules has no thresholds and needs none. Result columns replace input columns of the same name. Windows are compared by
    64-bit hash; a text of a million words has a false repeat with a probability below one in ten million. Where the texts are carried,
    they are written once to the shared folder with their facts.
    """
    made = (*FACTS, "base_failed", "failed", "kept")
    keep = [c for c in (df.columns if carry is None else carry) if c.lower() not in made]
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cols = [F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)]
    facts = with_facts(df, F.col(text_col), [*cols, key(lang_col).alias("g_lang"), key(source_col).alias("g_source")])
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    facts = facts.withColumn("base_failed", base_failed).withColumns(metric_columns())
    # The texts are counted once; without this a filter on the result would be pushed below and count them again for each use.
    facts = written(facts) if text_col in keep else cut(facts)
    fences = thresholds(facts)
    joined = facts.join(small(fences.select(F.col("g_lang").alias("t_lang"), F.col("g_source").alias("t_source"), *[c for c in fences.columns if c[:2] != "g_"])), (F.col("g_lang") == F.col("t_lang")) & (F.col("g_source") == F.col("t_source")), "left")
    out_of = [F.when(F.col(m) > F.col(f"high_{m}"), F.lit(m)) if not METRICS[m][3] else F.when((F.col(m) > F.col(f"high_{m}")) | (F.col(m) < F.col(f"low_{m}")), F.lit(m)) for m in METRICS]
    joined = joined.withColumn("failed", F.array_compact(F.array(*out_of)))
    return joined.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)],
        *FACTS,
        "base_failed",
        "failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
    )
