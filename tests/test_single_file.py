"""A submission in one file, byte for byte."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nextbuy.constants import PRODUCT_LABELS
from nextbuy.sources import csv_io, single_file


def plain(rows):
    return "\r\n".join(["ncodpers,added_products", *(f"{i},{x or ''}" for i, x in sorted(rows))]).encode()


def lists(spark, rows, parts=9):
    return spark.createDataFrame(rows, "ncodpers long, added_products string").repartition(parts)


def test_equal_to_a_plain_writer(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i * 7 % 100_003, " ".join(rnd.sample(PRODUCT_LABELS, rnd.randint(0, 7))) or None) for i in range(100_000)]
    path = tmp_path / "out" / "submission.csv"
    for per_part in (9_000, 200_000):
        n = csv_io.write_submission_file(lists(spark, rows), str(path), rows_per_part=per_part)
        assert path.read_bytes() == plain(rows) and n == path.stat().st_size
        assert [p.name for p in path.parent.iterdir()] == ["submission.csv"]
    back = {r.ncodpers: r.added_products for r in csv_io.read_submission(spark, str(path)).collect()}
    assert back == {i: x or "" for i, x in rows}


def test_few_rows_and_none(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    csv_io.write_submission_file(lists(spark, [(5, "a"), (-3, None), (5, "a")]), f"file://{path}", rows_per_part=1)
    assert open(path, "rb").read() == b"ncodpers,added_products\r\n-3,\r\n5,a\r\n5,a"
    assert csv_io.write_submission_file(lists(spark, []), path) == 23
    assert open(path, "rb").read() == b"ncodpers,added_products"


def test_other_text(spark, tmp_path):
    rows = spark.createDataFrame([(2, "zwei äöü"), (1, "x" * 5000), (3, "")], "k int, t string")
    path = str(tmp_path / "t.txt")
    single_file.write_single_file(rows, F.col("t"), ["k"], path, "", "\n", rows_per_part=1)
    assert open(path, encoding="utf-8").read() == "\n" + "\n".join(["x" * 5000, "zwei äöü", ""])
    with pytest.raises(PySparkException, match="null"):
        single_file.write_single_file(spark.createDataFrame([(1, None)], "k int, t string"), F.col("t"), ["k"], path, "h")
    with pytest.raises(ValueError, match="shared file system"):
        single_file.local_path("hdfs://host/x")
    assert open(path, encoding="utf-8").read().startswith("\nxxx")  # the file of the run that failed never appears
