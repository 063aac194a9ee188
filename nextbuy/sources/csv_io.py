"""CSV/Parquet sources and sinks with explicit schemas (no inference): text in, guarded conversion.

Readers never chunk by hand: Spark splits files into tasks
(``spark.sql.files.maxPartitionBytes``) and pushes month filters into the
scan, which replaces the original chunked reading.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..constants import P_COLS, PRODUCT_LABELS, RAW_ATTR_COLS
from ..functions.clean import try_number, why_not_number

_INT_COLS = {"indrel", "tipodom", "cod_prov"}


def raw_schema(with_products: bool = True) -> StructType:
    """Raw snapshot file: text attributes (parsed later), integer codes, 24 flags (train only)."""
    fields = []
    for c in RAW_ATTR_COLS:
        t = LongType() if c == "ncodpers" else IntegerType() if c in _INT_COLS else StringType()
        fields.append(StructField(c, t, True))
    if with_products:
        fields += [StructField(c, IntegerType(), True) for c in PRODUCT_LABELS]
    return StructType(fields)


PRED_SCHEMA = StructType([StructField("id", LongType(), True)] + [StructField(c, DoubleType(), True) for c in P_COLS])
SUBMISSION_SCHEMA = StructType([StructField("ncodpers", LongType(), True),
                                StructField("added_products", StringType(), True)])


def _text_columns(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header as text columns bound by name; files whose header differs from the first file's fail."""
    return spark.read.option("header", True).option("enforceSchema", False).option("nullValue", "NA").csv(path)


def _typed(text: DataFrame, schema: StructType, keep: tuple = ()) -> DataFrame:
    """The schema's columns by name, numbers converted with a guard (bad text -> null); a missing column is an error."""
    missing = [f.name for f in schema.fields if f.name not in text.columns]
    if missing:
        raise ValueError(f"columns missing in the file: {missing}")
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (IntegerType, LongType, DoubleType)):
            c = try_number(c, f.dataType.simpleString())
        elif not isinstance(f.dataType, StringType):
            c = c.try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return text.select(*cols, *keep)


def read_raw(spark: SparkSession, path: str, with_products: bool = True) -> DataFrame:
    """Raw snapshot CSV: columns found by header name, in any order; empty fields and ``NA`` are null, ``' NA'`` stays text.

    Integer codes, flags and ids may be written with blanks, as ``1.0`` or as ``1.375586e+06``; they are read exactly, and a fraction is null.
    """
    return _typed(_text_columns(spark, path), raw_schema(with_products))


_NUMBERS = (IntegerType, LongType, DoubleType)
#: Extra columns of checked reading.
RESCUED, _FILE, _LINE, _WHY = "_rescued", "_file", "_line", "_why"


@dataclass
class CheckedTable:
    """``rows``: the schema's columns and ``_rescued`` (field -> text, of the fields that could not be read; null without any).
    ``rejects``: (file, field, value, reason) of each such field, and of each line with too few or too many fields (field null, value the line)."""

    rows: DataFrame
    rejects: DataFrame

    def counts(self) -> DataFrame:
        """(file, field, reason, n): how many values were rejected."""
        return self.rejects.groupBy("file", "field", "reason").agg(F.count("*").alias("n"))


def _why(f: StructField) -> Column:
    """Why a text field is rejected, or null."""
    kind = f.dataType.simpleString()
    if isinstance(f.dataType, _NUMBERS):
        return why_not_number(f.name, kind)
    if isinstance(f.dataType, StringType):
        return F.lit(None).cast("string")
    bad = F.col(f.name).isNotNull() & (F.trim(f.name) != "") & F.col(f.name).try_cast(f.dataType).isNull()
    return F.when(bad, F.lit(f"not a {kind}"))


def read_checked(spark: SparkSession, path: str, schema: StructType, header: bool = True, null_value: str = "NA") -> CheckedTable:
    """A CSV file or folder with bad fields set apart instead of lost.

    Every line gives one typed row; a field that is no value of its type is null there, kept as text in
    ``_rescued``, and listed with its file and reason in the rejects. Blank fields and ``null_value`` are plain nulls. A line with
    another number of fields than the header (without a header: than the schema) gives a row of what could be read
    and one reject. A column of the schema that the header lacks is an error. Both tables read the file; nothing is cached.
    """
    names = spark.read.option("header", True).csv(path).columns if header else [f.name for f in schema.fields]
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"columns missing in the file: {missing}")
    text = StructType([*[StructField(n, StringType(), True) for n in names], StructField(_LINE, StringType(), True)])
    lines = (spark.read.schema(text).option("header", header).option("enforceSchema", False).option("nullValue", null_value)
             .option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", _LINE).csv(path).withColumn(_FILE, F.col("_metadata.file_path")))
    # reasons are columns of their own: arguments of array functions are not compiled
    checked = [f for f in schema.fields if not isinstance(f.dataType, StringType)]
    reasons = [_why(f).alias(f"r{i}") for i, f in enumerate(checked)]
    lines = lines.withColumn(_WHY, F.struct(*reasons, F.when(F.col(_LINE).isNotNull(), F.lit("wrong number of fields")).alias("line")))
    reject = lambda field, value, why: F.struct(F.lit(field).cast("string").alias("field"), value.alias("value"), F.col(f"{_WHY}.{why}").alias("reason"))
    found = [reject(f.name, F.col(f.name), f"r{i}") for i, f in enumerate(checked)]
    found.append(reject(None, F.col(_LINE), "line"))
    bad = F.filter(F.array(*found), lambda r: r.reason.isNotNull())
    fields = F.filter(bad, lambda r: r.field.isNotNull())
    any_field = F.coalesce(F.lit(None).cast("string"), *[F.col(f"{_WHY}.r{i}") for i in range(len(checked))]).isNotNull()
    rescued = F.when(any_field, F.map_from_entries(F.transform(fields, lambda r: F.struct(r.field, r.value))))
    typed = _typed(lines.withColumn(RESCUED, rescued), StructType([*schema.fields]), keep=(RESCUED,))
    return CheckedTable(typed, lines.filter(any_field | F.col(f"{_WHY}.line").isNotNull()).select(F.col(_FILE).alias("file"), F.explode(bad).alias("r")).select("file", "r.field", "r.value", "r.reason"))


def read_raw_checked(spark: SparkSession, path: str, with_products: bool = True) -> CheckedTable:
    """``read_raw`` with bad fields set apart (see ``read_checked``)."""
    return read_checked(spark, path, raw_schema(with_products))


def read_predictions_checked(spark: SparkSession, path: str) -> CheckedTable:
    """``read_predictions`` with bad fields, ids included, set apart instead of an error."""
    return read_checked(spark, path, PRED_SCHEMA, header=False)


def _writer(df: DataFrame, mode: str, header: bool):
    # Spark trims blanks when writing CSV by default; raw text such as " NA" must survive.
    return (df.write.mode(mode).option("header", header)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    """Table to CSV part files (IO5/IO6); one file per task, never funnelled through one task."""
    _writer(df, mode, header).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table written by ``write_csv``, by header name."""
    return _typed(_text_columns(spark, path), schema)


def write_predictions(pred: DataFrame, path: str, mode: str = "overwrite") -> None:
    """id followed by the 24 scores, comma separated, no header (IO7)."""
    _writer(pred.select("id", *P_COLS), mode, False).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless predictions file (IO4). Ids may be written as floats (``1.375586e+06``); one that is no number is an error."""
    text = StructType([StructField(f.name, StringType(), True) for f in PRED_SCHEMA.fields])
    typed = _typed(spark.read.schema(text).option("header", False).csv(path), PRED_SCHEMA)
    return typed.withColumn("id", F.coalesce("id", F.raise_error(F.lit("a prediction without a customer id")).cast("long")))


def write_submission(lists: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header ``ncodpers,added_products`` and CRLF line ends (IO8)."""
    _writer(lists.select("ncodpers", "added_products"), mode, True).option("lineSep", "\r\n").csv(path)


def write_submission_file(lists: DataFrame, path: str, rows_per_part: int = 200_000) -> int:
    """The submission as one file (IO8): one header, CRLF between lines, none after the last, customers in order.

    Written by all tasks at once (see ``single_file``); labels hold no commas or quotes, so fields are not quoted.
    Returns the file's bytes.
    """
    from .single_file import write_single_file

    line = F.concat(F.col("ncodpers").cast("string"), F.lit(","), F.coalesce("added_products", F.lit("")))
    return write_single_file(lists.select("ncodpers", "added_products"), line, ["ncodpers"], path, "ncodpers,added_products", "\r\n", rows_per_part)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(SUBMISSION_SCHEMA).option("header", True).option("lineSep", "\r\n").csv(path)
    return df.withColumn("added_products", F.coalesce("added_products", F.lit("")))


def month_scan(spark: SparkSession, path: str, month: int, fmt: str = "parquet",
               schema: StructType | None = None) -> DataFrame:
    """Rows of one month of a stored snapshot table (IO3).

    With a ``partitionBy("t")`` layout this prunes partitions; otherwise
    the predicate is pushed into the file scan.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path).filter(F.col("t") == month)
