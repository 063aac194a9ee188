"""Sources and sinks: month pruning, submission format, cluster sizing."""

import glob

from pyspark.sql import functions as F

from nextbuy.plans import standin as S
from nextbuy.session import cluster_conf
from nextbuy.sources import csv_io

from .conftest import SF_SMALL


def test_month_scan_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "snap")
    S.snap(spark, SF_SMALL).write.partitionBy("t").parquet(path)
    df = csv_io.month_scan(spark, path, 78)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(t" in plan and "(t#" in plan
    assert df.count() == S.snap(spark, SF_SMALL).filter(F.col("t") == 78).count()


def test_submission_crlf_and_header(spark, tmp_path):
    lists = spark.createDataFrame([(1, "a b"), (2, "")], "ncodpers long, added_products string")
    path = str(tmp_path / "sub")
    csv_io.write_submission(lists, path)
    blobs = [open(f, "rb").read() for f in glob.glob(path + "/*.csv")]
    assert all(b.startswith(b"ncodpers,added_products\r\n") for b in blobs if b)
    assert all(b"\n" not in b.replace(b"\r\n", b"") for b in blobs)
    back = {r["ncodpers"]: r["added_products"] for r in csv_io.read_submission(spark, path).collect()}
    assert back == {1: "a b", 2: ""}


def test_cluster_conf_scales_with_input():
    small, big = cluster_conf(10 << 30), cluster_conf(100 << 40)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
