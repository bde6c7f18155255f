"""A pipeline over ``documents``: each stage's result is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplelake.llm.common import staged
from samplelake.llm.compression_quality import keep_good
from samplelake.llm.decontaminate import drop_leaks
from samplelake.llm.order_minhash import keep_one
from samplelake.llm.packing import pack_documents
from samplelake.llm.template_tree import clean_lines


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go. Null and empty texts have no
    evidence and score near the labels' share; repeated rows stay or go together."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first document that has them; n_chars
    follows the text. All documents stay, also those whose text is null, empty or all gone;
    repeated rows, same id and text, keep the same lines."""
    return clean_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the least id. Null and
    empty texts are one class; of repeated rows one stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go. Null and empty texts have none and stay."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens at most. A null or empty text
    is the end token alone; repeated rows are packed each for itself; no rows give none."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can express neither the compression, the sampling of k-mers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
