"""Stored intermediate tables: bucketed by customer so later steps skip shuffles.

A table bucketed (and sorted) by ``id`` lets every later ``groupBy("id")``,
window over ``id`` and join on ``id`` between such tables run without an
exchange: the histories, the frequency scores and the score/snapshot join
all reuse the partitioning written once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_output_dir


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "id",
                   sort_cols=("id", "t"), partition_by=None, mode: str = "overwrite", dealt: bool = False) -> DataFrame:
    """Write an external Parquet table bucketed by ``key`` at ``path``; return it as a table.

    ``dealt``: the rows already lie together by bucket and are written where they are (rows that do not only make more files).
    """
    # one task per bucket: each bucket (of a month) is one sorted file
    w = (df if dealt else df.repartition(buckets, key)).write.mode(mode).format("parquet").option("path", path)
    if partition_by:
        w = w.partitionBy(partition_by)
    w = w.bucketBy(buckets, key)
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    sort_cols = [c for c in sort_cols if c in df.columns and c not in parts]
    if sort_cols:
        w = w.sortBy(*sort_cols)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def store_by_customer(df: DataFrame, label: str, buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """Bucket ``df`` by ``id`` into a fresh table under the shared checkpoint folder (``dealt``: see ``write_bucketed``).

    Serves as a lineage cut as well: later reads start from the stored files.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"nextbuy_{label}_{uuid.uuid4().hex[:12]}"
    return write_bucketed(df, name, shared_output_dir(spark, f"tables/{name}"), buckets, dealt=dealt)


def store_rows(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back (``options``: of the writer).

    Cuts the lineage like a checkpoint, but later reads take only the columns they need.
    """
    path = shared_output_dir(df.sparkSession, f"rows/{label}-{uuid.uuid4().hex[:12]}")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Forget the tables that ``store_by_customer`` registered, once their results are used."""
    for t in spark.catalog.listTables():
        if t.name.startswith("nextbuy_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")


def read_stored(spark: SparkSession, ref: str) -> DataFrame:
    """A table name (catalog, keeps bucketing) or a Parquet path."""
    return spark.read.parquet(ref) if ("/" in ref or ":" in ref) else spark.table(ref)
