"""Exact integers, quarantined fields."""

import pytest

from nextbuy.constants import P_COLS
from nextbuy.functions import clean
from nextbuy.sources import csv_io
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASES = [("9007199254740993", 9007199254740993, None), ("-9223372036854775808", -(1 << 63), None), ("9223372036854775808", None, "out of range"),
         ("1.7", None, "not an integer"), ("1.0", 1, None), (" 1", 1, None), ("1.375586000000000000e+06", 1375586, None), ("1e-3", None, "not an integer"),
         ("1e400", None, "out of range"), ("1.0000000000000000000000001", None, "not an integer"), ("1.000000000000000000000", 1, None), ("00012", 12, None),
         ("", None, None), ("  ", None, None), (None, None, None), ("abc", None, "not a number"), ("NaN", None, "not a number"), ("12345678901234567890123", None, "out of range"),
         ("5.", 5, None), ("+7", 7, None), ("0x1", None, "not a number"), ("1 2", None, "not a number"), ("-0", 0, None)]


def test_integers_are_exact(spark):
    d = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(CASES)], "i int, c string")
    got = d.select("i", clean.try_number("c", "bigint").alias("v"), clean.why_not_number("c", "bigint").alias("w")).orderBy("i").collect()
    assert [(r.v, r.w) for r in got] == [(v, w) for _, v, w in CASES]
    narrow = d.select(clean.try_number("c", "int").alias("v"), clean.why_not_number("c", "int").alias("w")).filter("w = 'out of range'").count()
    assert narrow == 5
    assert d.select(clean.try_number("c").alias("v")).filter("v = 1.7").count() == 1


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("name", T.StringType()), T.StructField("day", T.DateType())])


def test_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,id,x,day\nann,9007199254740993,1.5,2020-01-02\nbob,1.7,oops,NA\n"c, d",, ,yesterday\nshort,5\nlong,6,1,2020-01-01,extra\n')
    (tmp_path / "b.csv").write_text("name,id,x,day\neve,1e3,NA,2020-02-30\n")
    t = csv_io.read_checked(spark, str(tmp_path), SCHEMA)
    assert t.rows.columns == ["id", "x", "name", "day", "_rescued"]
    rows = {r.name: r for r in t.rows.collect()}
    assert (rows["ann"].id, rows["ann"].x, str(rows["ann"].day), rows["ann"]["_rescued"]) == (9007199254740993, 1.5, "2020-01-02", None)
    assert (rows["bob"].id, rows["bob"].x, rows["bob"].day, rows["bob"]["_rescued"]) == (None, None, None, {"id": "1.7", "x": "oops"})
    assert rows["c, d"]["_rescued"] == {"day": "yesterday"} and rows["c, d"].id is None
    assert rows["eve"].id == 1000 and rows["eve"]["_rescued"] == {"day": "2020-02-30"}
    assert rows["short"].id == 5 and rows["long"].id == 6 and len(rows) == 6
    got = {(r.file.rsplit("/", 1)[1], r.field, r.value, r.reason) for r in t.rejects.collect()}
    assert got == {("a.csv", "id", "1.7", "not an integer"), ("a.csv", "x", "oops", "not a number"), ("a.csv", "day", "yesterday", "not a date"),
                   ("b.csv", "day", "2020-02-30", "not a date"), ("a.csv", None, "short,5", "wrong number of fields"),
                   ("a.csv", None, "long,6,1,2020-01-01,extra", "wrong number of fields")}
    assert {(r.field, r.reason): r.n for r in t.counts().filter("file like '%a.csv'").collect()}[(None, "wrong number of fields")] == 2
    with pytest.raises(ValueError, match="missing"):
        csv_io.read_checked(spark, str(tmp_path), T.StructType([*SCHEMA.fields, T.StructField("other", T.LongType())]))


def test_prediction_rejects(spark, tmp_path):
    scores = ",".join(["0.5"] * len(P_COLS))
    (tmp_path / "p.csv").write_text(f"9.007199254740993e+15,{scores}\nnobody,{scores}\n7,{scores.replace('0.5', 'inf', 1)}\n")
    t = csv_io.read_predictions_checked(spark, str(tmp_path))
    assert sorted((r.id or 0, r.p_1 or 0) for r in t.rows.collect()) == [(0, 0.5), (7, 0), (9007199254740993, 0.5)]
    assert {(r.field, r.value) for r in t.rejects.collect()} == {("id", "nobody"), ("p_1", "inf")}


def test_an_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,x,name,day\n")
    t = csv_io.read_checked(spark, str(tmp_path), SCHEMA)
    assert t.rows.count() == t.rejects.count() == t.rows.filter(F.col("_rescued").isNotNull()).count() == 0


def test_reasons_are_compiled(spark, tmp_path):
    """Why a field is rejected is computed beside the array functions, whose arguments are not compiled."""
    from pyspark.sql.types import StructType

    path = str(tmp_path / "f")
    spark.createDataFrame([("1", "x"), ("2.5", "7")], "a string, b string").coalesce(1).write.option("header", True).csv(path)
    t = csv_io.read_checked(spark, path, StructType.fromDDL("a int, b int"))
    assert {(r.a, r.b): r["_rescued"] for r in t.rows.collect()} == {(1, None): {"b": "x"}, (None, 7): {"a": "2.5"}}
    plan = t.rows._jdf.queryExecution().optimizedPlan().toString()
    line = next(line for line in plan.splitlines() if "map_from_entries" in line)
    assert "RLIKE" not in line[line.index("map_from_entries"):line.index("AS _rescued")].upper()
