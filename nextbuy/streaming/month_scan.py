"""Incremental month scan with Structured Streaming.

The original reads the snapshot file in chunks of a million rows and keeps
the rows of one month. Here the snapshot folder is a file stream: each
micro-batch takes a bounded number of files (``maxFilesPerTrigger``),
keeps the month, and appends to a Parquet sink. The checkpoint makes the
scan restartable: after a lost executor or driver it resumes at the first
unprocessed file, and files added later are picked up by the next run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def start_month_scan(spark: SparkSession, source_dir: str, schema: StructType, month: int, sink_dir: str,
                     checkpoint_dir: str, columns=None, bytes_per_batch: int = 64 << 30, fmt: str = "parquet"):
    """Start the stream (trigger availableNow: process what is there, then stop)."""
    stream = (spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch)
                   .format(fmt).load(source_dir))
    rows = stream.filter(F.col("t") == month)
    if columns:
        rows = rows.select(*columns)
    return (rows.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir)
                .outputMode("append").trigger(availableNow=True).start(sink_dir))


def run_month_scan(spark: SparkSession, source_dir: str, schema: StructType, month: int, sink_dir: str,
                   checkpoint_dir: str, columns=None, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """Run the scan to the end and return the collected month rows (read from the sink)."""
    q = start_month_scan(spark, source_dir, schema, month, sink_dir, checkpoint_dir, columns, bytes_per_batch)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(sink_dir)
