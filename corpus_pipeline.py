"""A training-corpus pipeline: quality, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last,
returns the columns of documents; run() writes what a stage returns and reads it for the next.
A document with a null doc_id passes the near-duplicate and passage stages, which go by doc_id; rows
that share a doc_id are one document there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, near_dedup, packing, quality_rules, suffix_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    row = F.xxhash64("text", "lang", "source").alias("_row")  # rows of one doc_id are judged each by itself
    judged = quality_rules.judge(docs.select("doc_id", "text", "lang", "source", row)).where("not kept").select(F.col("doc_id").alias("_id"), "_row")
    own = docs.select(*COLUMNS, row.alias("_own"))
    return own.join(judged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_row")), "left_anti").select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.judge(docs.select(*COLUMNS), labels).where("not toxic").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near duplicates."""
    others = near_dedup.near_duplicates(docs.select("doc_id", "text")).where("class_id <> doc_id").select("doc_id")
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document holds."""
    cut = suffix_dedup.dedup(docs.select(*COLUMNS), as_text=True)
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("quality", quality), ("toxicity", clean), ("near_dedup", distinct), ("suffix_dedup", passages), ("packing", packed)]

#: The stages are no SQL; tests/llm compares the pipeline with plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again."""
    folder = f"{common.shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
