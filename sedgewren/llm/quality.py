"""Quality classifier by hierarchical empirical Bayes.

A logistic regression on surface features and on the words' own evidence, fitted on a bounded sample of labelled rows, gives each
document its probability. The words' evidence is the mean log ratio of a document's words between the classes, counted by grouped
aggregation in hashed buckets; in fitting, each half of the sample is judged by the other half's counts. Grouped
sums of that evidence give every host, and every path below a host, a Beta posterior: a sparse host is shrunk toward the global mean
and a sparse path toward its host, as strongly as the groups' spread allows. The posterior shifts the document's log odds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, small

#: About so many labelled rows at most are drawn (by a hash of their ids) to fit the classifier.
LABEL_SAMPLE = 20_000
#: A document is kept if its combined probability is at least this.
THRESHOLD = 0.5
#: Prior sizes (in documents) stay within these bounds.
PRIOR_SIZE = (5.0, 1000.0)
RIDGE, STEPS = 1.0, 25
FEATURES = ("log_words", "symbols", "digits", "upper", "punctuation", "exclaims", "word_bytes", "distinct_words", "distinct_lines", "top_word", "bars", "ends", "evidence")
#: Buckets of hashed words.
BUCKETS = 1 << 15
_SYMBOLS, _PUNCTUATION = np.frombuffer(b"#*$%&<>~^{}[]\\_=@", np.uint8), np.frombuffer(b".,;:?", np.uint8)


def buckets(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64) % BUCKETS


def log_ratio(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's share of documents between the classes, smoothed. counts: (2, BUCKETS) by class; docs: by class."""
    share = (counts + 1) / (docs[:, None] + 2)
    return np.log(share[1] / share[0])


def features(text: str | None, ratio: np.ndarray | None = None) -> list[float]:
    """Shares and means of the whole text, in the order of FEATURES. ratio: the buckets' log ratios (0 if not given)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = Counter(words)
    letters = int(count[65:91].sum() + count[97:123].sum()) or 1
    return [
        float(np.log1p(n)),
        min(5.0, count[_SYMBOLS].sum() / n),
        min(5.0, count[48:58].sum() / n),
        count[65:91].sum() / letters,
        min(5.0, count[_PUNCTUATION].sum() / n),
        min(5.0, float(count[33]) / n),
        min(20.0, float(len(raw) - count[9:14].sum() - count[32]) / n),
        len(distinct) / n,
        len(set(lines)) / len(lines),
        max(distinct.values()) / n,
        min(5.0, float(count[124]) / n),
        min(1.0, float(count[46]) / n),
        0.0 if ratio is None else float(ratio[buckets(distinct)].mean()),
    ]


class Classifier:
    """Standardised logistic regression."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, ratio: np.ndarray | None = None):
        self.mean, self.scale, self.weights, self.ratio = mean, scale, weights, ratio

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, ratio: np.ndarray | None = None) -> Classifier:
        """Newton steps with a ridge. Without both classes every document gets the classes' mean (0.5 without rows)."""
        d = len(FEATURES)
        if len(y) == 0 or y.min() == y.max():
            p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
            return cls(np.zeros(d), np.ones(d), np.append(np.zeros(d), np.log(p / (1 - p))), ratio)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
        w, ridge = np.zeros(d + 1), np.diag([RIDGE] * d + [0.0])
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge + 1e-9 * np.eye(d + 1), z.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w, ratio)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = LABEL_SAMPLE) -> Classifier:
    """labels: id_col and quality (0 or 1; null is no label, repeated ids are averaged). At most about `sample` rows are fitted; their
    features and four counts a bucket reach the driver."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), "quality")
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 60)) < int(share * (1 << 60))).groupBy("label_id").agg(F.avg("quality").alias("quality"))
    half = F.pmod(F.xxhash64("label_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("t")).join(F.broadcast(drawn), "label_id")
    rows = rows.select(half, (F.col("quality") >= 0.5).cast("int").alias("good"), "t")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for half, good, text in zip(*b.columns, strict=True):
                found = np.unique(buckets(set((text.as_py() or "").encode("utf-8", "surrogatepass").split())))
                found = np.append(found, -1)  # counts the document itself
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x.as_py(), np.int32)) for x in (half, good)] + [pa.array(found)], names=["half", "good", "bucket"])

    counts, docs_in = np.zeros((2, 2, BUCKETS)), np.zeros((2, 2))
    told = rows.mapInArrow(words, "half int, good int, bucket long").groupBy("half", "good", "bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    halves, goods, places, n = (told.column(i).to_numpy() for i in range(4))
    whole = places < 0
    docs_in[halves[whole], goods[whole]] = n[whole]
    counts[halves[~whole], goods[~whole], places[~whole]] = n[~whole]
    others = [log_ratio(counts[1 - i], docs_in[1 - i]) for i in (0, 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(text.as_py(), others[half.as_py()]) for half, text in zip(b.column(0), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["good", "x"])

    got = rows.mapInArrow(work, "good int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return Classifier.fitted(x, got.column("good").to_numpy().astype(float), log_ratio(counts.sum(axis=0), docs_in.sum(axis=0)))


def with_score(df: DataFrame, model: Classifier, text_col: str, name: str, carry: list[str]) -> DataFrame:
    """The columns of carry and the document's own probability."""
    schema = T.StructType([*df.select(*carry).schema.fields, T.StructField(name, T.DoubleType())])
    text = free_name(df, "score_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py(), model.ratio) for t in b.column(b.num_columns - 1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(x))], names=[*b.schema.names[:-1], name])

    return df.select(*carry, F.col(text_col).alias(text)).mapInArrow(work, schema)


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def prior_size(mean: Column, spread: Column) -> Column:
    """Documents' worth of a Beta prior with this mean whose groups spread so much (method of moments), within PRIOR_SIZE."""
    low, high = PRIOR_SIZE
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.try_divide(mean * (1 - mean), spread) - 1, F.lit(high))))


def sites(scored: DataFrame) -> DataFrame:
    """Per host and path (g_host, g_path): sums, both prior sizes and the global mean. scored: g_host, g_path, p."""
    paths = cut(scored.groupBy("g_host", "g_path").agg(F.count(F.lit(1)).alias("path_n"), F.sum("p").alias("path_sum")))
    hosts = cut(paths.groupBy("g_host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum")))
    both = paths.join(hosts, "g_host")
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_sum").alias("s"), F.sum(F.col("host_sum") * F.col("host_sum") / F.col("host_n")).alias("sq")).first()
    if not total["n"]:
        return both.select("*", *[F.lit(0.5).alias(c) for c in ("mean", "host_size", "path_size")])
    mean = total["s"] / total["n"]
    of_host = max(0.0, total["sq"] / total["n"] - mean * mean)
    within = both.agg(F.sum(F.col("path_n") * F.pow(F.col("path_sum") / F.col("path_n") - F.col("host_sum") / F.col("host_n"), 2.0))).first()[0] / total["n"]
    return both.select(
        "*",
        F.lit(mean).alias("mean"),
        prior_size(F.lit(mean), F.lit(of_host)).alias("host_size"),
        prior_size(F.lit(mean), F.lit(within)).alias("path_size"),
    )


def quality_classifier(
    df: DataFrame,
    model: Classifier,
    host: Column | None = None,
    path: Column | None = None,
    text_col: str = "text",
    threshold: float = THRESHOLD,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns of `carry` (all by default), doc_quality, site_quality, quality and kept for every row.

    host and path name the levels (source and language by default; null and empty are one site). doc_quality is the classifier's
    probability, site_quality the path's posterior without the document itself, quality their combination, kept whether it is at
    least `threshold`. Null and empty texts have the features of no words. Result columns replace input columns of the same name.
    """
    made = ("doc_quality", "site_quality", "quality", "kept")
    keep = [c for c in (df.columns if carry is None else carry) if c.lower() not in made]
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = df.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)], key(host).alias("g_host"), key(path).alias("g_path"), F.col(text_col).alias("t"))
    if text_col in keep:  # texts are scored twice rather than stored
        scored = with_score(rows, model, "t", "p", [c for c in rows.columns if c != "t"])
        stats = sites(with_score(rows, model, "t", "p", ["g_host", "g_path"]))
    else:
        scored = cut(with_score(rows, model, "t", "p", [c for c in rows.columns if c != "t"]))
        stats = sites(scored)
    stats = cut(stats.withColumnsRenamed({"g_host": "s_host", "g_path": "s_path"}))
    out = scored.join(small(stats), (F.col("g_host") == F.col("s_host")) & (F.col("g_path") == F.col("s_path")))
    p = F.col("p")
    of_host = (F.col("host_size") * F.col("mean") + F.col("host_sum") - p) / (F.col("host_size") + F.col("host_n") - 1)
    of_path = (F.col("path_size") * of_host + F.col("path_sum") - p) / (F.col("path_size") + F.col("path_n") - 1)
    odds = logit(p) + logit(of_path) - logit(F.col("mean"))
    quality = 1 / (1 + F.exp(-odds))
    return out.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)], p.alias("doc_quality"), of_path.alias("site_quality"), quality.alias("quality"), (quality >= threshold).alias("kept")
    )
