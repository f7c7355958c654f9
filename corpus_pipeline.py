"""A corpus of documents, ready for training: filtered, without near copies and benchmark items, mixed, encoded.

Null and empty texts fail the quality rules; repeated rows are one group of near copies, of which one row stays; equal
keys at a source's cut are decided by a hash of the text; an empty table passes every stage and gives no rows; other
columns go along up to the token files, which have their own. Texts of any length go through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm.decontam import decontaminated
from pagequarry.llm.mixing import mixed_documents
from pagequarry.llm.neardup import without_near_duplicates
from pagequarry.llm.quality import good_documents
from pagequarry.llm.tokens import tokenized
from pagequarry.sources.lineage import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without_near_duplicates(docs)


def without_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, each text whole."""
    return mixed_documents(docs, whole_texts=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and the digest of each document read back from them."""
    return tokenized(docs)


STAGES = [
    ("quality rules", rules),
    ("near duplicates", distinct_texts),
    ("benchmark items", without_items),
    ("mixing sources", weighted),
    ("token files", encoded),
]

#: Hashes of n-grams, shingles and token ids have no like in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
