"""Line deduplication over levelled sorted runs of line hashes (operator 4).

A line's key is the line with ASCII white space stripped at both ends and A-Z
lower-cased; it is held as a 128-bit hash. Documents arrive in batches. The
state is a set of *runs*: tables of (key hash, number of documents, largest
document id), bucketed and sorted by the hash, in levels as in a log-structured
merge tree:

* a batch is aggregated to one row per key and merge-anti-joined with every
  run; the keys that no run has become a new run of level 0;
* the batch's other keys are *hits*, each taken once; they wait beside the runs with their
  counts until the next compaction;
* ``fan_in`` runs of a level, with the hits so far, are merged into one run of
  the next level.

The hash is exchanged once per batch; the buckets of batch and runs line up, so
the joins merge sorted files. Counts are pre-aggregated in the map tasks, so a
line that a third of all documents share moves one row per task.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_output_dir
from .common import ASCII_WS, KEY, ascii_lower, keyed, stored

HASH = ["h1", "h2"]


def line_key(line):
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_WS)))


class LineRuns:
    """The levelled runs over (h1, h2, n_docs, max_id)."""

    def __init__(self, spark: SparkSession, buckets: int, fan_in: int = 3):
        self.spark, self.buckets, self.fan_in = spark, buckets, fan_in
        self.levels: list[list[str]] = [[]]
        self.hits: list[DataFrame] = []
        self._tables: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"nextbuy_run_{uuid.uuid4().hex}"
        path = f"{shared_output_dir(self.spark, 'llm')}/{name}"
        (rows.write.format("parquet").option("path", path).bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name))
        self._tables.append(name)
        return name

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def add(self, batch: DataFrame) -> None:
        """Take one batch: rows of (h1, h2, n_docs, max_id) with distinct hashes."""
        runs = self._runs()
        if not runs:
            self.levels[0].append(self._write(batch.repartition(self.buckets, *HASH)))
            return
        own = self.spark.table(self._write(batch.repartition(self.buckets, *HASH)))
        new = self._write(reduce(lambda b, run: b.join(run, HASH, "left_anti"), runs, own))
        self.levels[0].append(new)
        self.hits.append(own.join(self.spark.table(new), HASH, "left_anti"))  # once each: after a compaction several runs may have a key
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            merged = self._write(self._merge([self.spark.table(n) for n in self.levels[level]] + self.hits))
            if len(self.levels) == level + 1:
                self.levels.append([])
            # the merged hits also cover keys of other levels' runs; counts add up over runs at the end
            self.levels[level], self.hits = [], []
            self.levels[level + 1].append(merged)
            level += 1

    @staticmethod
    def _merge(parts: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, parts)
        return rows.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("max_id").alias("max_id"))

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, max_id) over all batches."""
        return self._merge(self._runs() + self.hits)

    def forget(self) -> None:
        """Remove the tables' names from the catalog (their files lie in the job's shared folder)."""
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, doc_id, h1, h2, pos, first): a row per line whose key is long enough.

    ``first`` marks one line of each key in its document. Lines are sorted by
    hash inside the row for that, so long documents stay linear.
    """
    d = docs.select(*KEY, "doc_id", F.transform(F.split("text", "\n", -1), line_key).alias("keys"))
    hashed = F.transform("keys", lambda x, i: F.when(F.char_length(x) >= min_chars, F.struct(
        F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(11), x).alias("h2"), i.alias("pos"))))
    d = d.select(*KEY, "doc_id", F.array_sort(F.filter(hashed, lambda x: x.isNotNull())).alias("s"))
    before = F.concat(F.array(F.lit(None).cast("struct<h1:bigint,h2:bigint,pos:int>")), F.col("s"))
    marked = F.zip_with("s", before, lambda x, p: F.struct(
        x.h1.alias("h1"), x.h2.alias("h2"), x.pos.alias("pos"),
        (p.isNull() | (x.h1 != p.h1) | (x.h2 != p.h2)).alias("first")))
    return d.filter(F.size("s") > 0).select(*KEY, "doc_id", F.inline(F.slice(marked, F.lit(1), F.size("s"))))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, n_batches: int = 4, fan_in: int = 3,
                buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for every row.

    Texts are split at ``\\n`` (null or empty: one empty line). A key of at
    least ``min_chars`` code points that ``min_docs`` rows or more hold loses
    all its lines except in the rows with the largest doc_id that holds it (a
    null id counts as smallest). Each row counts as a document, also when rows
    repeat. No rows: no result rows. Only id and text are read.
    """
    spark = docs.sparkSession
    docs = keyed(docs, id_col, text_col)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    batch = F.pmod(F.col("k1"), F.lit(n_batches)).cast("int")  # rows arrive in n_batches; all of them are processed
    lines = stored(_lines(docs, min_chars).withColumn("batch", batch), "lines", ["batch"])
    runs = LineRuns(spark, buckets, fan_in)
    for b in range(n_batches):
        own = lines.filter((F.col("batch") == b) & F.col("first"))
        runs.add(own.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_id")))
    often = stored(runs.totals().filter(F.col("n_docs") >= min_docs).select(*HASH, "max_id"), "line-keys")
    runs.forget()
    drop = (lines.join(often, HASH).filter(~F.col("doc_id").eqNullSafe(F.col("max_id")))
            .groupBy(*KEY).agg(F.collect_set("pos").alias("drop")))  # as many positions as the document has lines
    d = docs.join(drop, KEY, "left").select("doc_id", "text", "drop", F.split("text", "\n", -1).alias("lines"))
    kept_pos = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    d = d.select("doc_id", "text", "lines", F.coalesce(F.size("drop"), F.lit(0)).alias("n_dropped"), F.size("lines").alias("n"),
                 F.when(F.col("drop").isNotNull(), F.array_sort(kept_pos)).alias("kept_pos"))
    kept = F.array_join(F.transform("kept_pos", lambda i: F.get("lines", i)), "\n")
    return d.select("doc_id", F.col("n").cast("long").alias("n_lines"),
                    F.when(F.col("kept_pos").isNull(), 0).otherwise(F.col("n_dropped")).cast("long").alias("n_dropped"),
                    F.when(F.col("kept_pos").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))
