"""The incremental month scan resumes from its checkpoint."""

from pyspark.sql import functions as F

from nextbuy.plans import standin as S
from nextbuy.streaming.month_scan import run_month_scan

from .conftest import SF_SMALL


def test_month_scan_resumes(spark, tmp_path):
    snap = S.snap(spark, SF_SMALL)
    src, sink, ckpt = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ckpt")
    first, later = snap.filter(F.col("id") % 2 == 0), snap.filter(F.col("id") % 2 == 1)
    first.write.parquet(src + "/part_a")
    schema = spark.read.parquet(src + "/part_a").schema

    out = run_month_scan(spark, src + "/*", schema, 78, sink, ckpt, columns=["id", "t"])
    n_first = out.count()
    assert n_first == first.filter(F.col("t") == 78).count()

    # a second run over the same checkpoint finds nothing new
    assert run_month_scan(spark, src + "/*", schema, 78, sink, ckpt, columns=["id", "t"]).count() == n_first

    # a new file is picked up on the next run, and only it
    later.write.parquet(src + "/part_b")
    out = run_month_scan(spark, src + "/*", schema, 78, sink, ckpt, columns=["id", "t"])
    assert out.count() == snap.filter(F.col("t") == 78).count()
    assert out.select("id").distinct().count() == out.count()
