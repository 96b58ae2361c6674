"""A corpus from raw documents to packed sequences: five stages, each by one operator of tidewatch.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import blocknames, packing, quality, secrets, simhash
from tidewatch.llm.shared import stored, table


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality the factorisation machine accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id."""
    return blocknames.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", accept),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", redact),
    ("packing", pack),
]

#: A trained classifier, fingerprints and a tokenizer are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
