"""Data skipping on unpartitioned files."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nextbuy.sources.manifest import build_manifest

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.IntegerType())])


def write(folder, name, rows):
    (folder / name).write_text("id,t\n" + "".join(f"{i},{'' if t is None else t}\n" for i, t in rows))


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "snap shots"
    f.mkdir()
    write(f, "a.csv", [(1, 1), (2, 2), (3, 2)])
    write(f, "b c.csv", [(4, 2), (5, 3)])
    write(f, "d.csv", [(6, 7), (7, 9), (8, None)])
    write(f, "e.csv", [])
    (f / "_SUCCESS").write_text("")
    return f


def ids(df):
    return sorted(r.id for r in df.collect())


def names(files):
    return sorted(os.path.basename(x).replace("%20", " ") for x in files)


def test_reads_only_the_files_that_hold_the_month(spark, folder):
    m = build_manifest(spark, str(folder), schema=SCHEMA)
    assert m.scanned == 4 and m.files.count() == 4
    for month, want, files in ((2, [2, 3, 4], ["a.csv", "b c.csv"]), (3, [5], ["b c.csv"]), (8, [], ["d.csv"]), (9, [7], ["d.csv"]), (4, [], []), (1, [1], ["a.csv"])):
        scan = m.scan(spark, month)
        assert ids(scan) == want and names(m.files_of(month)) == files
        assert names(scan.inputFiles()) == files or not files
        assert scan.columns == ["id", "t"]
    assert ids(m.scan(spark, 2, 7)) == [2, 3, 4, 5, 6]
    row = m.files.filter("n_other = 1").first()
    assert (row.low, row.high, row.n_rows) == (7, 9, 2)


def test_refresh_scans_new_and_changed_files_only(spark, folder, tmp_path):
    first = build_manifest(spark, str(folder), schema=SCHEMA)
    assert first.refreshed(spark).scanned == 0
    first.save(str(tmp_path / "manifest"))
    write(folder, "f.csv", [(9, 3), (10, 4)])
    write(folder, "a.csv", [(1, 1), (2, 2), (3, 2), (11, 5)])
    os.remove(folder / "d.csv")
    for known in (first.files, spark.read.parquet(str(tmp_path / "manifest"))):
        second = build_manifest(spark, str(folder), schema=SCHEMA, known=known)
        assert second.scanned == 2 and second.files.count() == 4
        assert ids(second.scan(spark, 3)) == [5, 9] and ids(second.scan(spark, 5)) == [11]
        assert second.files_of(7) == [] and ids(second.scan(spark, 9)) == []


def test_a_month_from_a_date(spark, folder, tmp_path):
    other = tmp_path / "dates"
    other.mkdir()
    (other / "x.csv").write_text("id,day\n1,2015-01-28\n2,2015-02-28\n")
    (other / "y.csv").write_text("id,day\n3,2016-02-28\n4,never\n")
    month = 12 * (F.year(F.col("day").try_cast("date")) - 2015) + F.month(F.col("day").try_cast("date"))
    m = build_manifest(spark, str(other), month)
    assert ids(m.scan(spark, 14)) == ["3"] and names(m.files_of(14)) == ["y.csv"]
    assert ids(m.scan(spark, 2)) == ["2"]


def test_an_empty_folder(spark, tmp_path):
    m = build_manifest(spark, str(tmp_path), schema=SCHEMA)
    assert m.scanned == 0 and m.scan(spark, 1).count() == 0
    with pytest.raises(ValueError, match="schema"):
        build_manifest(spark, str(tmp_path)).scan(spark, 1)
