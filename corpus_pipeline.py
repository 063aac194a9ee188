"""From raw documents to packed training sequences.

STAGES are run in order; each works on all rows that the one before kept.
The first four return the columns of ``documents``, the last the packed pieces:

1. quality   documents that the classifier rejects go (learnt from ``labels``)
2. exact     of equal texts one document stays
3. near      of each near-duplicate group one document stays (five words, 0.8)
4. benchmark documents that overlap with a benchmark item go
5. pack      what is left, tokenised and packed into sequences of 4096 tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nextbuy.llm.common import stored
from nextbuy.llm.decontaminate import drop_contaminated
from nextbuy.llm.exact_dedup import keep_unique
from nextbuy.llm.minhash import keep_one_of_near
from nextbuy.llm.packing import pack
from nextbuy.llm.quality import keep_good
from nextbuy.session import prepare_session
from nextbuy.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read_table(spark, sf_dir, "labels"), threshold=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_near(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, capacity=4096)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("pack", packed)]

#: SQL cannot express the classifier and the packing; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that every stage keeps."""
    prepare_session(spark)
    rows = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
