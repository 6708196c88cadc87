"""The operators' queries over the text tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, lexical, mixing, packing, pieces, pii, quality, rules, secrets, simhash, trie, urls, wrappers

#: Key of op6's pseudonyms.
PII_KEY = b"sedgewren-op6"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The tokenizer's file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.quality_classifier(docs, model, carry=["doc_id", "source", "lang"])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), carry=["doc_id"])


def span_list(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = F.filter("secret_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.BASE_KINDS), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("secret_spans")).alias("spans"), "n_weak")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)
    return found.select("doc_id", "text", F.coalesce(F.size("pii_spans"), F.lit(0)).alias("n_values"), span_list(F.col("pii_spans")).alias("spans"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = piece_model()
    ids = pieces.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), path, carry=["doc_id"])
    told = ids.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("piece_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.element_at("piece_ends", -1).alias("n_bytes"),
        "piece_ids",
    )
    return pieces.decode_pieces(told, path, drop=("piece_ids",)).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_bytes")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.main_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"]).withColumn("failed", F.concat_ws(",", "failed"))


def domain(source: Column) -> Column:
    """The domain of a source: its number modulo four."""
    return F.concat(F.lit("domain"), F.coalesce(F.pmod(F.regexp_extract(source, "[0-9]+$", 0).try_cast("int"), F.lit(4)), F.lit(0)).cast("string"))


def tree() -> dict[str, Column]:
    return {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, tree(), carry=["doc_id", "lang", "source"])


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_exact_dedup,
        op3_quality_classifier,
        op4_simhash,
        op5_secret_scan,
        op6_pii,
        op7_pieces,
        op8_main_text,
        op9_quality_rules,
        op10_mixing,
        op11_lexical_search,
        op12_prefix_trie,
        op13_packing,
    )
}

#: SQL by query, in the files beside this module.
ORACLES = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "sql").glob("*.sql"))}


def _secret_sql() -> str:
    """SQL of op5: matches and what lies between them give positions; weak spans meet parts of the document within SCOPE."""

    def found(no: int, kind: str) -> str:
        regex, group, least = secrets.BASE_KINDS.get(kind) or (secrets.WEAK_KINDS[kind][0], 0, 0)
        r = regex.replace("'", "''")
        needs = () if kind in secrets.BASE_KINDS else secrets.WEAK_KINDS[kind][1]
        ok = " AND ".join([f"length(g) >= {least}", *(f"regexp_matches(g, '{n}')" for n in needs)])
        return f"""SELECT rid, {no} AS kind_no, '{kind}' AS kind, upto - length(m) AS s, upto AS e FROM (
            SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS upto FROM (
                SELECT rid, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1 : len(ms)]) AS gap FROM (
                    SELECT rid, regexp_extract_all(t, '{r}', 0) AS ms, regexp_extract_all(t, '{r}', {group}) AS gs, string_split_regex(t, '{r}') AS gaps FROM d) WHERE len(ms) > 0)) WHERE {ok}"""

    spans = " UNION ALL ".join(found(i, k) for i, k in enumerate(secrets.KINDS))
    names = lambda kinds: ", ".join(f"'{k}'" for k in kinds)
    base, scope = names(secrets.BASE_KINDS), secrets.SCOPE
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), spans AS ({spans}), linked AS (
        SELECT c.rid, c.kind_no, c.kind, c.s, c.e, bool_or(NOT apart AND p.kind IN ({base})) AS on_base, bool_or(apart AND p.kind IN ({names(secrets.IDENTIFIERS)})) AS by_ident,
               bool_or(apart AND p.kind IN ({names(secrets.SECRETS)})) AS by_secret
        FROM (SELECT c.*, p.kind AS p_kind, p.s AS ps, p.e AS pe, p.s >= c.e OR c.s >= p.e AS apart, p AS p FROM spans c JOIN spans p ON p.rid = c.rid AND p.s - {scope} <= c.e AND c.s <= p.e + {scope} WHERE c.kind NOT IN ({base})) c
        GROUP BY 1, 2, 3, 4, 5), shown AS (
        SELECT rid, kind_no, kind, s, e FROM spans WHERE kind IN ({base})
        UNION ALL SELECT rid, kind_no, kind, s, e FROM linked WHERE NOT on_base AND CASE kind WHEN 'mixed' THEN by_ident WHEN 'ident' THEN by_secret ELSE by_ident AND by_secret END), per AS (
        SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind NOT IN ({base})) AS n_weak,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no, e) FILTER (kind IN ({base})) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no, e) AS every
        FROM shown GROUP BY 1)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(n_weak, 0) AS n_weak
    FROM d LEFT JOIN per USING (rid)""".replace("p.kind IN", "p_kind IN").replace(", p AS p FROM", " FROM")


ORACLES["op5_secret_scan"] = _secret_sql()
