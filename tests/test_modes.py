"""Exact modes against plain counting."""

import random
from collections import Counter

from pyspark.sql import functions as F

from nextbuy.operators import impute


def plain(values):
    c = Counter(v for v in values if v is not None)
    return min(c, key=lambda v: (-c[v], v)) if c else None


def test_modes_of_all_kinds_of_columns(spark):
    rnd = random.Random(6)
    n = 4000
    cols = {"code": [rnd.choice(["A", "B", "C", None]) for _ in range(n)],
            "tie": [["x", "y", "w"][i % 3] if i < 3999 else None for i in range(n)],
            "wide": [rnd.choice([5, 7]) if i % 9 == 0 else 10_000 + i for i in range(n)],       # a frequent value among many single ones
            "single": [n - i for i in range(n)],                                                # all values once: the lowest
            "rare": [3 if i in (17, 2900) else 10 + i for i in range(n)],                       # twice: no sketch can tell
            "none": [None] * n, "mostly null": [None if i % 50 else 1.5 for i in range(n)], "word s": ["a" * (i % 70) for i in range(n)]}
    rows = list(zip(*cols.values(), strict=True))
    schema = "code string, tie string, wide long, single int, rare long, none string, `mostly null` double, `word s` string"
    df = spark.createDataFrame(rows, schema).repartition(7)
    want = {c: plain(v) for c, v in cols.items()}
    assert impute.exact_modes(df, list(cols)) == want
    assert impute.exact_modes(df, list(cols), tracked=64, reported=16) == want    # sketches that overflow
    assert impute.exact_modes(df, list(cols), tracked=1000, reported=2) == want   # reports that are cut
    assert impute.exact_modes(df.limit(0), ["code", "wide"]) == {"code": None, "wide": None}
    assert impute.exact_modes(df, ["absent"]) == {}


def test_a_million_distinct_values(spark):
    d = spark.range(1_000_000).select(F.when(F.col("id") % 20 == 0, 77).otherwise(F.col("id") + 1000).alias("a"), (F.col("id") * 7919 % 1_000_003).alias("b"))
    got = impute.exact_modes(d, ["a", "b"])
    assert got == {"a": 77, "b": 0}


def test_code_columns_take_one_pass(spark):
    d = spark.createDataFrame([("u", 1, 2.0), ("u", 2, None), (None, 2, 4.0)], "code string, flag int, amount double")
    row = d.agg(F.count("*").alias("_n"), *impute._sketches(["code", "flag"], 64, 16)).first()

    class Unread:
        def __getattr__(self, name):
            raise AssertionError("a second pass")

    assert impute._settled(Unread(), row, ["code", "flag"], 3, 64, 16) == {"code": "u", "flag": 2}
    assert impute.impute_stats(d, ["code", "flag"], ["amount"]) == {"code": "u", "flag": 2, "amount": 3.0}
    assert impute.impute(d, mode_cols=["code", "flag"], mean_cols=["amount"]).filter("code is null or amount is null").count() == 0
