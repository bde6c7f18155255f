"""One query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, secrets, template_tree
from .compact_windows import repeated_passages
from .compression_quality import score_quality
from .conversations import audit_conversations, damage
from .line_cleaning import clean_documents
from .log_bilinear import score_texts
from .order_minhash import near_duplicates
from .packing import pack_documents
from .token_counts import count_tokens
from .url_rules import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.withColumn("slot_share", F.round("slot_share", 6)).drop("row")


@_query
def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir))


@_query
def op6_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_documents(_documents(spark, sf_dir)).drop("clean_text")


@_query
def op7_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = template_tree.drop_recurring_lines(_documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("clean_md5"))


@_query
def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_documents(spark, sf_dir))


@_query
def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_documents(spark, sf_dir))


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


@_query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report_secrets(_documents(spark, sf_dir))


@_query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_conversations(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLES["op1_decontamination"] = decontaminate.ORACLE
ORACLES["op7_template_lines"] = template_tree.ORACLE
ORACLES["op11_centroids"] = centroids.ORACLE
ORACLES["op12_secrets"] = secrets.ORACLE
