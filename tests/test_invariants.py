
from pyspark.sql import Window
from pyspark.sql import functions as F

from nextbuy.constants import COMMUNITIES
from nextbuy.operators import features, impute, metrics, recommend, scale, score, sequence
from nextbuy.plans import standin as S

from .conftest import SF_MEDIUM


def test_histories_one_row_per_customer(spark):
    h = S.trainset(spark, SF_MEDIUM)
    assert h.count() == h.select("id").distinct().count()
    assert h.filter(F.size("x") != F.col("n_obs") - 1).count() == 0
    assert h.filter(~F.col("n_obs").between(2, S.TRAIN_MONTH)).count() == 0
    assert h.filter(F.col("t_max") > S.TRAIN_MONTH).count() == 0


def test_padded_size(spark):
    h = sequence.pad_histories(S.trainset(spark, SF_MEDIUM, scale_time=True), S.PAD_LEN, 26)
    assert h.filter((F.size("x") != S.PAD_LEN) | F.exists("x", lambda s: F.size(s) != 26)).count() == 0


def test_ap_bounds_and_cross_form(spark):
    t = metrics.with_new_only(S.scored_testset(spark, SF_MEDIUM))
    ap = metrics.ap_table(t)
    assert ap.filter((F.col("ap") < 0) | (F.col("ap") > 1)).count() == 0
    # same AP from a long form with windows
    long = t.select("id", F.posexplode(F.arrays_zip("y", "p")).alias("k", "z")).select(
        "id", "k", F.col("z.y").alias("y"), F.col("z.p").alias("p"))
    w = Window.partitionBy("id").orderBy(F.col("p").desc(), F.col("k").asc())
    r = long.withColumn("r", F.row_number().over(w)).filter("r <= 7").withColumn("h", (F.col("y") > 0).cast("int"))
    r = r.withColumn("prec", F.col("h") * F.sum("h").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("r"))
    nt = long.groupBy("id").agg(F.count_if(F.col("y") > 0).alias("nt"))
    alt = r.groupBy("id").agg(F.sum("prec").alias("s")).join(nt, "id").select(
        "id", F.when(F.col("nt") == 0, 0.0).otherwise(F.col("s") / F.least("nt", F.lit(7))).alias("ap2"))
    diff = ap.join(alt, "id").filter(F.abs(F.col("ap") - F.col("ap2")) > 1e-12).count()
    assert diff == 0


def test_no_owned_product_recommended(spark):
    s = S.snap(spark, SF_MEDIUM)
    j = recommend.rank_products(recommend.join_owned(score.frequency_scores(s), recommend.owned_at_month(s, 78)))
    bad = j.filter(F.exists("ranked", lambda i: F.coalesce(F.get("owned", i) >= 1, F.lit(False))))
    assert bad.count() == 0
    ranks = recommend.ranked_table(j)
    dense = ranks.groupBy("id").agg(F.max("pos").alias("m"), F.count("*").alias("c"))
    assert dense.filter(F.col("m") != F.col("c")).count() == 0


def test_onehot_row_sum(spark):
    f = features.featurize(S.orders_clean(spark, SF_MEDIUM))
    total = sum(F.col(f"province_{c}") for c in COMMUNITIES)
    assert f.filter(total > 1).count() == 0


def test_zscore_train_slice(spark):
    df = S.orders_clean(spark, SF_MEDIUM).select("age", "seniority", "income")
    z = scale.apply_zscore(df, scale.zscore_stats(df))
    st = z.agg(*[F.avg(c).alias(f"m_{c}") for c in z.columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in z.columns]).first()
    for c in z.columns:
        assert abs(st[f"m_{c}"]) < 1e-9 and abs(st[f"s_{c}"] - 1) < 1e-9


def test_impute_leaves_no_gaps(spark):
    df = impute.impute(S.snapshots_clean(spark, SF_MEDIUM))
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("employee", "country", "sex", "age", "income",
                                                                       "channel_1", "is_active")]).first()
    assert all(v == 0 for v in nulls)


def test_metrics_refuse_missing_labels(spark):
    import pytest
    df = spark.createDataFrame([(1, 2, None, [0] * 24, [0.1] * 24)], "id long, n_obs int, y array<int>, y_last array<int>, p array<double>")
    with pytest.raises(Exception):
        metrics.map_at_k_new(df).collect()
