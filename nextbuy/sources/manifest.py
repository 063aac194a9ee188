"""Data skipping for snapshot files that are not partitioned by month.

A manifest keeps, for every file of a folder, the least and largest month it holds. It is
built by one scan and refreshed by scanning new and changed files only (a file is known by its
path, length and modification time). A month is then read from the files that can hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import store_rows

_FILES = "file string, length long, modified timestamp, low int, high int, n_rows long, n_other long"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, modified) of the data files below ``path``; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    hidden = F.element_at(F.split("path", "/"), -1).rlike(r"^[._]")
    return rows.select(F.col("path").alias("file"), F.col("length"), F.col("modificationTime").alias("modified")).filter(~hidden)


@dataclass(frozen=True)
class Manifest:
    """``files``: a row per file with its months; ``scanned``: how many files the last refresh read."""

    path: str
    files: DataFrame
    scanned: int
    month: Column
    fmt: str
    schema: StructType | None
    options: dict

    def _read(self, spark: SparkSession, files: list[str]) -> DataFrame:
        reader = spark.read.options(**self.options)
        if self.schema is not None:
            reader = reader.schema(self.schema)
        return reader.format(self.fmt).load(files)

    def files_of(self, low: int, high: int | None = None) -> list[str]:
        """The files that can hold rows of months ``low`` to ``high``."""
        high = low if high is None else high
        return sorted(r.file for r in self.files.filter((F.col("low") <= high) & (F.col("high") >= low)).select("file").collect())

    def scan(self, spark: SparkSession, low: int, high: int | None = None) -> DataFrame:
        """The rows of months ``low`` to ``high``, read from ``files_of`` them only."""
        high = low if high is None else high
        files = self.files_of(low, high)
        if not files:
            some = self.files.limit(1).collect()
            if not some and self.schema is None:
                raise ValueError("an empty folder needs a schema")
            rows = self._read(spark, [some[0].file]) if some else spark.createDataFrame([], self.schema)
            return rows.filter(F.lit(False))
        return self._read(spark, files).filter(self.month.between(low, high))

    def refreshed(self, spark: SparkSession) -> Manifest:
        """The manifest of the folder as it is now; only files that are new or have changed are scanned."""
        return build_manifest(spark, self.path, self.month, self.fmt, self.schema, self.options, known=self.files)

    def save(self, path: str) -> None:
        self.files.write.mode("overwrite").parquet(path)


def build_manifest(spark: SparkSession, path: str, month: Column | None = None, fmt: str = "csv", schema: StructType | None = None,
                   options: dict | None = None, known: DataFrame | None = None) -> Manifest:
    """A manifest of the files below ``path``; ``month``: the month of a row (default: the column ``t``).

    ``known``: (file, length, modified, low, high, ...) rows of an earlier manifest (``Manifest.files`` or a saved
    table); its files are not scanned again. Rows without a month are counted (``n_other``) and found in no month. A file
    without any month has null bounds. A CSV is read with a header unless ``options`` say otherwise.
    """
    month = F.col("t") if month is None else month
    options = {**({"header": True} if fmt == "csv" else {}), **(options or {})}
    now = store_rows(listed(spark, path), "files")
    same = ["file", "length", "modified"]
    kept = spark.createDataFrame([], _FILES) if known is None else known.join(now, same, "left_semi").select(*_names())
    fresh = now.join(kept.select(*same), same, "left_anti")
    new = sorted(r.file for r in fresh.select("file").collect())  # names of files, not their rows
    table = Manifest(path, kept, len(new), month.cast("int"), fmt, schema, options)
    if not new:
        return Manifest(path, store_rows(kept, "manifest"), 0, table.month, fmt, schema, options)
    seen = table._read(spark, new).select(F.col("_metadata.file_path").alias("file"), table.month.alias("m"))
    seen = seen.groupBy("file").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.count("m").alias("n_rows"), F.count_if(F.col("m").isNull()).alias("n_other"))
    name = lambda c: F.regexp_replace(F.url_decode(c), "^file:/+", "file:/")  # noqa: E731  the two listings spell a path differently
    seen = seen.select(name(F.col("file")).alias("_file"), "low", "high", "n_rows", "n_other")
    found = fresh.join(seen, name(fresh["file"]) == seen["_file"], "left").select(
        *same, "low", "high", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_other")])
    files = store_rows(kept.unionByName(found), "manifest")
    return Manifest(path, files, len(new), table.month, fmt, schema, options)


def _names() -> list[str]:
    return [c.split()[0] for c in _FILES.split(", ")]
