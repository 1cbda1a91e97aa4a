"""The corpus pipeline: from `documents` to shards of a clean, deduplicated, decontaminated and weighted mix.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and columns of any name. Null texts count as
empty. All stages but the last return the columns of documents with the values they had, also if they are named like a stage's results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashelf.llm import decontaminate, mixing, sharding, simhash, toxicity
from mediashelf.session import shared_dir


def _aside(docs: DataFrame, results: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """The documents with columns named like results out of their way, and what gives the columns back."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in results}
    return docs.withColumnsRenamed(own), [F.col(own[c]).alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, holds for toxic go. Empty texts stay; repeated rows share their fate."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, columns = _aside(docs, ("score", "predicted"))
    return toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0").select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id: five-word shingles, similarity of 0.8 or more.

    Texts without words are copies of each other. Documents with a null doc_id stay; of rows with one doc_id, all stay or none.
    """
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text go; those with a null doc_id stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their targets. A null source is one of its own; rows with one doc_id fare alike."""
    docs, columns = _aside(docs, ("size", "source_size", "target", "copies", "taken", "copy"))
    return mixing.emit(mixing.mix(docs)).select(*columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Forty shards of near equal bytes; equal texts stay together. With all columns, but those named like a result are replaced."""
    return sharding.shard(docs, shards=40)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL can't express the stages on trained models, fingerprints and latent spaces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
