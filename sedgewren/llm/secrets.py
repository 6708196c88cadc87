"""Secret scans with multipart linking, in DataFrame operations only.

Strong kinds are reported wherever they match. Weak candidates (an identifier, a long mixed token, an endpoint) are reported only
where complementary parts of one credential lie in the same scope, a window of SCOPE characters around a part: candidates and parts
of a document are joined as intervals, by the cells of SCOPE characters that they touch. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Characters between two parts of one credential at most.
SCOPE = 200
#: Base kinds in the order of the listing: regular expression, group, fewest characters of the group. Where a minimum is part of
#: the expression, maximal runs below it could not have matched: the leftmost matches are the same as with `+` and a later test.
BASE_KINDS = {
    "assign": (
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
#: Weak kinds: regular expression, and what else the match must contain.
WEAK_KINDS = {
    "ident": (
        r"""([Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Uu][Ss][Ee][Rr]([Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]+""",
        (),
    ),
    "mixed": ("[A-Za-z0-9+/_-]{32,}", ("[a-z]", "[A-Z]", "[0-9]")),
    "endpoint": ("[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.:@_-]+", ()),
}
KINDS = [*BASE_KINDS, *WEAK_KINDS]
#: What a part can stand for in a credential.
IDENTIFIERS, SECRETS = ("access", "ident"), ("assign", "hex", "mixed")


def pieces(text: Column, kind: str) -> Column:
    """array<struct<gap, len, ok>>: for each leftmost non-overlapping match the characters before it since the last one, its own,
    and whether it passes. Null if there is none."""
    regex, group, least = BASE_KINDS.get(kind, (WEAK_KINDS.get(kind, ("",))[0], 0, 0))
    whole = F.regexp_extract_all(text, F.lit(regex), 0)
    inner = F.regexp_extract_all(text, F.lit(regex), group) if group else whole

    def passes(value: Column) -> Column:
        ok = F.length(value) >= least
        for n in () if kind in BASE_KINDS else WEAK_KINDS[kind][1]:
            ok = ok & F.rlike(value, F.lit(n))
        return ok

    found = F.zip_with(whole, inner, lambda w, g: F.struct(F.length(w).alias("len"), passes(g).alias("ok")))
    # The text is cut at the same places: what lies between the matches gives their positions.
    gaps = F.slice(F.split(text, regex, -1), 1, F.size(whole))
    both = F.zip_with(gaps, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m["len"].alias("len"), m["ok"].alias("ok")))
    return F.when(F.rlike(text, F.lit(regex)), both)


def cells(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / SCOPE).cast("int"), F.floor(end / SCOPE).cast("int")))


def secret_scan(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of `carry` (all but the text by default), secret_spans and n_weak for every row.

    secret_spans: array<struct<start, kind_no, end, kind, base>> by start, then kind in the order of KINDS, then end; empty if none.
    Base spans are always reported. A weak candidate that overlaps a base span is not reported; a mixed token is if an identifier
    lies within SCOPE characters of it, an identifier if a secret does, an endpoint if both do. Null text has no spans. Rows are
    neither dropped nor merged; result columns replace input columns of the same name.
    """
    keep = [c for c in (df.columns if carry is None else carry) if c.lower() not in ("secret_spans", "n_weak") and (carry is not None or c != text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = cut(
        df.select(F.monotonically_increasing_id().alias("rid"), *[F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)], text.alias("t")).select(
            "rid", *[f"in_{i}" for i in range(len(keep))], *[pieces(F.col("t"), k).alias(f"k_{k}") for k in KINDS]
        )
    )
    some = scanned.where(F.coalesce(*[F.col(f"k_{k}").isNotNull() | F.lit(None) for k in KINDS]))
    none = F.array().cast("array<struct<gap:int,len:int,ok:boolean>>")
    kinds = F.array(*[F.struct(F.lit(i).alias("kind_no"), F.coalesce(f"k_{k}", none).alias("m")) for i, k in enumerate(KINDS)])
    flat = some.select("rid", F.explode(kinds).alias("x")).select("rid", "x.kind_no", F.posexplode("x.m").alias("no", "m"))
    upto = F.sum(F.col("m.gap") + F.col("m.len")).over(Window.partitionBy("rid", "kind_no").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    spans = flat.withColumn("end", upto.cast("int")).where("m.ok").select("rid", "kind_no", (F.col("end") - F.col("m.len")).alias("start"), "end")
    spans = cut(spans)
    n_base = len(BASE_KINDS)
    number = {k: i for i, k in enumerate(KINDS)}
    part = spans.select("rid", F.col("kind_no").alias("p_kind"), F.col("start").alias("p_start"), F.col("end").alias("p_end"), cells(F.col("start") - SCOPE, F.col("end") + SCOPE).alias("cell"))
    weak = spans.where(F.col("kind_no") >= n_base).select("*", cells(F.col("start"), F.col("end")).alias("cell"))
    near = (F.col("p_start") - SCOPE <= F.col("end")) & (F.col("start") <= F.col("p_end") + SCOPE)
    apart = (F.col("p_start") >= F.col("end")) | (F.col("start") >= F.col("p_end"))
    linked = weak.join(part, ["rid", "cell"]).where(near).groupBy("rid", "kind_no", "start", "end").agg(
        F.max(~apart & (F.col("p_kind") < n_base)).alias("on_base"),
        F.max(apart & F.col("p_kind").isin([number[k] for k in IDENTIFIERS])).alias("by_ident"),
        F.max(apart & F.col("p_kind").isin([number[k] for k in SECRETS])).alias("by_secret"),
    )
    kind = F.col("kind_no")
    shown = linked.where(
        ~F.col("on_base")
        & F.when(kind == number["mixed"], F.col("by_ident")).when(kind == number["ident"], F.col("by_secret")).otherwise(F.col("by_ident") & F.col("by_secret"))
    )
    every = spans.where(kind < n_base).unionByName(shown.select("rid", "kind_no", "start", "end"))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind_no") + 1)
    per_row = every.groupBy(F.col("rid").alias("s_rid")).agg(
        F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", name.alias("kind"), (kind < n_base).alias("base")))).alias("secret_spans"),
        F.sum((kind >= n_base).cast("int")).alias("n_weak"),
    )
    out = scanned.join(per_row, F.col("rid") == F.col("s_rid"), "left")
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,base:boolean>>")
    return out.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)],
        F.coalesce("secret_spans", empty).alias("secret_spans"),
        F.coalesce("n_weak", F.lit(0)).cast("long").alias("n_weak"),
    )
