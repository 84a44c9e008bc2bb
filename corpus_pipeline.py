"""A corpus pipeline of five stages over the table of documents; part of the corpus operators (lattica.llm).

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Null and empty texts fail the quality rules, so later stages see texts only; a very long text is taken whole
by every stage; an empty table passes through every stage; columns besides those of documents pass through all stages but the last, whatever their names. Repeated rows are
judged alike and leave one row at near_duplicates, which keeps the smallest id of each group; rows with a null id are never near duplicates of others, and stay. Ties: a score of just
0.5 is toxic; what equal ranks mean in mixing and packing is stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import op1_quality, op2_simhash, op8_toxicity, op9_packing, op10_mixing
from lattica.llm.common import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    return op1_quality.filter_quality(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the toxicity threshold; the model is trained on those that are labelled."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return op8_toxicity.train(docs, labels).keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, five-word shingles at a similarity of 0.8 or more: the one with the smallest id.

    By SimHash with tables of segments; links that these leave out follow by an exact way.
    """
    return op2_simhash.dedup_similar(docs, shingle=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it; longer ones are likelier."""
    return op10_mixing.mixed(docs, preference=op10_mixing.by_length)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its sequence and its place there."""
    return op9_packing.pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the stages; tests hold near_duplicates, scores, measures, rates and best-fit against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
