"""The registered queries of the training-data operators: thin digests of their results."""

from __future__ import annotations

from collections.abc import Callable

from corpus_pipeline import run as pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .clustering import cluster_vectors
from .common import sha256_hex
from .decontaminate import contamination
from .exact_dedup import dedup_exact
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .packing import pack
from .pii import replace_pii
from .quality import classify_quality
from .sharding import shard_by_bytes
from .sql import ORACLE_SQL
from .suffix_dedup import remove_repeats
from .url_filter import TASK_RULES, url_verdicts
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents: doc_id, n_lines, n_dropped, kept_sha256."""
    kept = dedup_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings of all documents removed: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kept = remove_repeats(read_table(spark, sf_dir, "documents"), length=200)
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents replaced by surrogates: doc_id, n_entities, found, text."""
    clean = replace_pii(read_table(spark, sf_dir, "documents"), key="nextbuy")
    return clean.select("doc_id", F.size("found").cast("long").alias("n_entities"), F.array_join("found", ",").alias("found"), "text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents, learnt from labels that are not held out."""
    return classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents: doc_id, keep_id, group_size, kept, text_sha256."""
    return dedup_exact(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces packed into sequences of at most 4096 tokens."""
    return pack(read_table(spark, sf_dir, "documents"), capacity=4096)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents overlap with benchmark items, substitutions tolerated."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; grown_shard belongs to another law and is null."""
    placed = shard_by_bytes(read_table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select("*", F.lit(None).cast("int").alias("grown_shard"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents (2-word shingles, similarity 0.8)."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2, percent=80)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL under the task's rules."""
    return url_verdicts(read_table(spark, sf_dir, "pages"), TASK_RULES)


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 finite entries in 40 clusters, five rounds, exact integers."""
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5, scale=256, dims=64, tag="2")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All finite vectors on their 32 leading whitened components."""
    return whiten(read_table(spark, sf_dir, "embeddings"), n_components=32, scale=64)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))


LLM_QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_pii, op3_quality, op4_line_dedup, op5_exact_dedup, op6_packing, op7_decontamination, op8_sharding,
                           op9_minhash, op10_url_filter, op11_clustering, op12_whitening, op13_licenses)
}
LLM_QUERIES["pipeline"] = pipeline
LLM_ORACLES: dict[str, str] = {k: v for k, v in ORACLE_SQL.items() if k in LLM_QUERIES}
