"""Helpers the training-data operators share.

Rows are identified by a 128-bit content key of (id, text), not by the id alone:
it is deterministic (a lost executor recomputes the same key), never null, and
rows repeated with the same id and text simply share one key and one result.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import share_package, shared_output_dir

#: The ASCII white space of all contracts: space, tab, LF, VT, FF, CR.
ASCII_WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["k1", "k2"]


def stored(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage in a way that survives lost executors, and later reads
    prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_output_dir(spark, 'llm')}/{label}-{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, cannot interfere. Null text becomes empty."""
    share_package(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id, text) with the 128-bit row key (null id: a key of its own)."""
    d = id_text(docs, id_col, text_col)
    tag = F.coalesce(F.col("doc_id").cast("string"), F.lit("~null"))
    return d.select(F.xxhash64(tag, "text").alias("k1"), F.xxhash64(F.lit(7), "text", tag).alias("k2"),
                    "doc_id", "text")


def with_row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """All columns of ``docs`` and the two columns of the row key, under names that ``docs`` does not have."""
    text, tag = F.coalesce(docs[text_col].cast("string"), F.lit("")), F.coalesce(docs[id_col].cast("string"), F.lit("~null"))
    keys = [fresh(docs, "k1"), fresh(docs, "k2")]
    return docs.withColumns({keys[0]: F.xxhash64(tag, text), keys[1]: F.xxhash64(F.lit(7), text, tag)}), keys


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else (``lower`` would also fold other letters)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def crc32_text(c: Column) -> Column:
    return F.crc32(c.cast("binary"))


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows, counted by all tasks (of a stored table: from its footers)."""
    return df.count() <= max_rows


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(ddl))


def apply_decisions(rows: DataFrame, decisions: DataFrame, keys: list[str], max_broadcast: int = 500_000) -> DataFrame:
    """The rows whose key some decision (``keys``, kept) keeps; of rows that repeat a key as many as are kept.

    Only what is dropped is looked up: broadcast when proven small, otherwise
    joined by a shuffle.
    """
    counts = decisions.groupBy(*keys).agg(F.count_if("kept").alias("n_kept"), F.count("*").alias("n_all"))
    less = stored(counts.filter("n_kept < n_all"), "dropped")
    gone = less.filter("n_kept = 0").select(*keys)
    out = rows.join(F.broadcast(gone) if fits_broadcast(gone, max_broadcast) else gone, keys, "left_anti")
    some = less.filter("n_kept > 0").select(*keys, "n_kept")
    if some.isEmpty():  # no key repeats
        return out
    some = F.broadcast(some) if fits_broadcast(some, max_broadcast) else some
    place, kept = fresh(rows, "place"), fresh(rows, "n_kept")
    repeated = out.join(some.withColumnRenamed("n_kept", kept), keys)
    repeated = repeated.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    return out.join(some.select(*keys), keys, "left_anti").unionByName(
        repeated.filter(F.col(place) <= F.col(kept)).select(*out.columns))
