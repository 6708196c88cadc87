"""The corpus pipeline: documents to token ids in five stages, each one of the text operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
Documents that the quality classifier rejects go, then exact copies, then near copies; sources are mixed to target weights; what is
left is encoded into pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.llm import exact, mixing, pieces, quality, queries, similar
from sedgewren.llm.common import WRITTEN, remove, shared_folder


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with names that no operator's results have, and these names; `restored` gives the old ones back."""
    names = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(out: DataFrame, names: dict[str, str]) -> DataFrame:
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts."""
    model = quality.fit(docs, queries.table(spark, sf_dir, "labels"))
    plain, at = renamed(docs)
    return restored(quality.quality_classifier(plain, model, F.col(at["source"]), F.col(at["lang"]), at["text"]).where("kept"), at)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of equal texts."""
    plain, at = renamed(docs)
    return restored(exact.exact_dedup(plain, at["doc_id"], at["text"]).where("kept"), at)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near copies: SimHash candidates and an exact join, five-word shingles, a
    similarity of 0.8 or more."""
    plain, at = renamed(docs)
    return restored(similar.near_copies(plain, at["doc_id"], at["text"], carry=plain.columns).where("kept"), at)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chosen documents, once per epoch in which they are chosen."""
    plain, at = renamed(docs)
    tree = {"domain": queries.domain(F.col(at["source"])), "lang": F.col(at["lang"]), "source": F.col(at["source"])}
    return restored(mixing.mix(plain, tree, id_col=at["doc_id"], text_col=at["text"]), at)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's pieces and the ends of their byte spans."""
    out = pieces.encode_pieces(docs, queries.piece_model(), carry=["doc_id", "lang", "source"])
    return out.withColumn("n_tokens", F.size("piece_ids").cast("long"))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("near copies", drop_near_copies),
    ("mixing", mix),
    ("encoding", encode),
]

#: A fitted classifier, XXH64 and piece merging have no SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's result is kept in the shared folder until the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        before = set(WRITTEN)
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        remove(spark, [x for x in WRITTEN if x not in before] + ([f"{folder}/{i - 1}"] if i else []))
    return docs
