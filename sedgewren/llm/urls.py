"""URL filters: rules indexed by their rarest literal token.

A rule is a host-and-path rule (`example.net/en/`) or a pattern (`||spam-farm.`, `/casino/`, `*` any run, `^` a separator).
Every rule becomes one regular expression and the list of tokens (runs of a-z0-9) that any matching URL must contain whole.
The corpus counts those tokens; each rule is filed under its rarest one, a URL's own tokens fetch the candidate rules by an
equi-join, and only candidates run their expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, UPPER, free_name

#: Host-and-path rules: (action, rule).
SITE_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
#: Pattern rules that judge what no host-and-path rule fits. An allow pattern beats a block pattern.
PATTERN_RULES = (
    ("block", "||spam-farm."),
    ("block", "||adult-x."),
    ("block", "||casino*."),
    ("block", "^casino^"),
    ("block", "^poker^"),
    ("block", "^porn^"),
    ("block", "^xxx^"),
    ("block", "/cart/"),
    ("block", "/login^"),
    ("block", "?s=*&sort="),
    ("allow", "^education^"),
)


@dataclass(frozen=True)
class Rule:
    text: str
    action: str
    regex: str
    on_site: bool
    tokens: tuple[str, ...]


def site_rule(action: str, text: str) -> Rule:
    """Fits the host and all its subdomains if the path starts with the rule's. Matched on host followed by path."""
    host, slash, path = text.partition("/")
    host, tail = host.translate(str.maketrans(UPPER, LOWER)), slash + path
    regex = r"(?s)^(?:[^/]*\.)?" + re.escape(host) + ("(?=/|$)" if not tail else re.escape(tail))
    whole = re.findall(r"[a-z0-9]+", host)
    inner = re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", tail)
    return Rule(text, action, regex, True, tuple(dict.fromkeys(whole + [t.lower() for t in inner])))


def pattern_rule(action: str, text: str) -> Rule:
    """`||` anchors at a host label, `*` is any run, `^` a character outside [A-Za-z0-9_.%-] or the end. Letters match in either case."""
    body, regex = text, "(?is)"
    if text.startswith("||"):
        body, regex = text[2:], r"(?is)^[^:/?#]*://(?:[^/?#]*\.)?"
    for part in re.findall(r"[*^]|[^*^]+", body):
        regex += {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(part) or re.escape(part)
    edge = " " if text.startswith("||") else "*"  # an end of an unanchored pattern may lie within a longer token
    tokens = re.findall(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", edge + body + "*")
    return Rule(text, action, regex, False, tuple(dict.fromkeys(t.lower() for t in tokens)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://` (A-Z lower-cased) and path; both empty for null or without `://`."""
    part = lambda g: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", g), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def url_tokens(url: Column) -> Column:
    """Distinct runs of a-z0-9 of the URL, lower-cased in A-Z only as the expressions are, and the empty token under which rules without any token are filed."""
    return F.array_distinct(F.concat(F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+"), F.array(F.lit(""))))


def rule_index(spark: SparkSession, rules: list[Rule], tokens: DataFrame) -> DataFrame:
    """One row per rule: rank, regex and the token under which it is filed, the rarest in `tokens` (column token)."""
    table = spark.createDataFrame(
        [(i, r.text, r.action, r.regex, r.on_site, len(r.text), list(r.tokens) or [""]) for i, r in enumerate(rules)],
        "rule_no int, rule string, action string, regex string, on_site boolean, length int, tokens array<string>",
    )
    by_token = table.select("rule_no", F.explode("tokens").alias("token"))
    wanted = by_token.select("token").distinct()
    seen = tokens.join(F.broadcast(wanted) if len(rules) <= BROADCAST_ROWS else wanted, "token").groupBy("token").count()
    rarest = by_token.join(seen, "token", "left").groupBy("rule_no").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("rarest")
    )
    return table.drop("tokens").join(rarest, "rule_no").select("*", F.col("rarest.token").alias("token")).drop("rarest")


def url_filter(df: DataFrame, url_col: str = "url", site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Adds host, path, rule, verdict and matched_pattern to every row.

    rule: the longest fitting host-and-path rule (the first listed of equal length), else null; its action is then the verdict.
    Otherwise matched_pattern is the deciding pattern rule (allow before block, then as listed), and without one the verdict is
    allow. Null, empty and odd URLs have empty host and path and are allowed unless a pattern matches. Rows are neither dropped
    nor merged; a result column that clashes with an input column replaces it.
    """
    spark = df.sparkSession
    rules = [site_rule(*r) for r in site_rules] + [pattern_rule(*r) for r in pattern_rules]
    key = free_name(df, "url_key")
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict", "matched_pattern")]
    base = df.select(*kept, F.col(url_col).alias(key))
    host, path = host_and_path(F.col(key))
    urls = base.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    tokens = urls.select(F.col(key).alias("u"), F.concat(host, path).alias("site"), F.explode(url_tokens(F.col(key))).alias("token"))
    index = rule_index(spark, rules, tokens.select("token"))
    hits = (
        tokens.join(F.broadcast(index) if len(rules) <= BROADCAST_ROWS else index, "token")
        .where(F.expr("regexp_like(if(on_site, site, u), regex)"))
        .groupBy("u")
        .agg(
            F.max(F.when(F.col("on_site"), F.struct("length", -F.col("rule_no"), "rule", "action"))).alias("by_site"),
            F.max(F.when(~F.col("on_site"), F.struct(F.col("action") == "allow", -F.col("rule_no"), "rule", "action"))).alias("by_pattern"),
        )
    )
    out = base.join(hits.withColumnRenamed("u", key), key, "left")
    return out.select(
        *[F.col(c) for c in base.columns if c != key],
        host.alias("host"),
        path.alias("path"),
        F.col("by_site.rule").alias("rule"),
        F.coalesce("by_site.action", "by_pattern.action", F.lit("allow")).alias("verdict"),
        F.when(F.col("by_site").isNull(), F.col("by_pattern.rule")).alias("matched_pattern"),
    )
