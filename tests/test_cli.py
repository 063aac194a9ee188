"""The command line drives the four steps (in-process, sharing the test session)."""

from pyspark.sql import functions as F

from nextbuy.__main__ import main
from nextbuy.constants import PRODUCT_LABELS
from nextbuy.sources import csv_io, fixtures

from .conftest import SF_SMALL


def test_cli_steps(spark, tmp_path, capsys):
    raw = fixtures.raw_snapshots(spark, SF_SMALL).withColumn("_m", F.substring("fecha_dato", 1, 7))
    train_csv, test_csv = str(tmp_path / "train"), str(tmp_path / "test")
    csv_io.write_csv(raw.filter(F.col("_m") <= "2001-07").drop("_m"), train_csv)
    csv_io.write_csv(raw.filter(F.col("_m") == "2001-08").drop("_m", *PRODUCT_LABELS), test_csv)
    out = str(tmp_path / "out")
    main(["features", train_csv, out, "--base-year", "1995"], spark=spark)
    main(["features", test_csv, out, "--test", "--base-year", "1995", "--impute-from", f"{out}/df"], spark=spark)
    test_clean = spark.read.parquet(f"{out}/testdf")
    train_income = spark.read.parquet(f"{out}/df").filter(F.col("income").isNotNull())
    assert test_clean.filter(F.col("income").isNull()).count() == 0
    assert train_income.count() > 0
    main(["train", f"{out}/catdf", "-m", "78", "-t", "79", "--last-file-month", "79", "-n", "3",
          "-f", str(tmp_path / "models")], spark=spark)
    assert "MAP@7 on new products" in capsys.readouterr().out
    main(["inspect", "-f", str(tmp_path / "models"), "--features", f"{out}/catdf", "-m", "78", "-t", "79",
          "--last-file-month", "79", "-n", "3", "-s", "0.05", "--out", str(tmp_path / "insp")], spark=spark)
    top = spark.read.parquet(str(tmp_path / "insp/top_per_unit"))
    assert top.select("dim").distinct().count() == 24 and top.count() == 24 * 3
    proj = spark.read.parquet(str(tmp_path / "insp/projections"))
    assert proj.count() > 0 and proj.filter("pc1 IS NULL").count() == 0
    main(["train", f"{out}/catdf", "--testset", f"{out}/testcatdf", "-m", "79", "-t", "80",
          "--last-file-month", "79", "-n", "3", "--pred-out", str(tmp_path / "pred")], spark=spark)
    main(["recommend", str(tmp_path / "pred"), str(tmp_path / "sub"), "-d", f"{out}/df", "-m", "79", "--limit", "7"],
         spark=spark)
    sub = csv_io.read_submission(spark, str(tmp_path / "sub"))
    assert sub.count() > 0
    assert sub.filter(F.size(F.split("added_products", " ")) > 7).count() == 0
    fixtures.activations(spark, SF_SMALL).write.parquet(str(tmp_path / "acts"))
    main(["inspect", str(tmp_path / "acts"), "-n", "3", "-s", "0.2"], spark=spark)
