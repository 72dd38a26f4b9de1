"""From documents to packed sequences: toxicity, near-duplicates, mixing, packing.

Each stage works on all rows that the one before kept; a run's stages hand DataFrames on, and a driver may write each one's
result as Parquet and read it again. All but the last return the columns of documents.

Defined results: a null or empty text is not rejected, is near to nothing, and has no words, so that the mix does not take it; a null source is a source of
its own; of documents alike the one with the least doc_id stays (a null doc_id after all others), and rows that repeat its doc_id and text stay with it and
share what the mix takes; an empty table gives no rows; without labels nothing is rejected. Other columns are handed on up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.minhash import deduplicate
from sparkloom.llm.mixing import mixed_documents
from sparkloom.llm.packing import pack_documents
from sparkloom.llm.toxicity import category_labels, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject; it learns from the labels table."""
    return without_toxic(docs, category_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by target weights takes them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place. The encoder's cache is an eighth as large, as the stages before have left memory in the same executors."""
    return pack_documents(docs, most_pieces=60_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents table: pieces of tokens with their sequence and offset."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
