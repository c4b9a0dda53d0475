"""From raw documents to a training mix: toxic documents go, then exact and near copies, then documents
with test items; what stays is mixed to the sources' target weights.

Each stage reads what its predecessor kept, as Parquet. All stages but the last return the columns of
``documents``; the last returns the training order, one row per occurrence of a document.

Cases: rows without an id pass the filters like others, but of equal texts a row with an id stays
before one without. Rows with the same id are one document: what holds for the id holds for all of
them. Extra columns of ``documents`` are left behind; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.llm import decontam, exactdedup, minhash, mixing, toxicity
from momentloom.llm.shared import folder, stable, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _judged(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids(keep)``; null ids match null ids."""
    same = F.col("doc_id").eqNullSafe(F.col("keep"))
    return docs.select(*COLUMNS).join(ids, same, "left_semi")


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier calls toxic."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").drop("score")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id."""
    kept = exactdedup.exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("keep"))
    return _judged(docs, kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    kept = stable(minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("keep")))
    return _judged(docs, kept)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order of what is left."""
    return mixing.order(docs)


STAGES = [
    ("toxic_filter", toxic_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


ORACLE_SQL = None  # the classifier and the item index cannot be expressed in SQL
