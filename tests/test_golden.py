"""Golden literal rows (FIXTURES.md section 4)."""

import pytest

from nextbuy.constants import Y_COLS
from nextbuy.functions import arrays as A
from nextbuy.functions import clean as C
from nextbuy.functions import features as FX
from nextbuy.functions.scale import circular_month
from nextbuy.operators import batches, impute, sequence


def col_values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_month_index(spark):
    df = spark.createDataFrame([("2015-01-28",), ("2016-05-28",), ("2016-06-28",)], "d string")
    assert col_values(df, C.month_index("d", 2015)) == [1, 17, 18]


def test_default_code(spark):
    df = spark.createDataFrame([("S",), (None,), ("A",)], "c string")
    assert col_values(df, C.default_code("c")) == ["N", "N", "A"]


def test_binary_map(spark):
    df = spark.createDataFrame([("H",), ("V",), ("X",), (None,)], "c string")
    assert col_values(df, C.binary_map("c", {"H": 1, "V": 0})) == [1, 0, None, None]


def test_try_number(spark):
    df = spark.createDataFrame([(" 35",), (" NA",), ("-999999",), ("   ",)], "c string")
    assert col_values(df, C.try_number("c", "int")) == [35, None, -999999, None]


def test_strip_point_zero(spark):
    df = spark.createDataFrame([("1.0",), ("1",), ("P",), (None,)], "c string")
    assert col_values(df, C.strip_point_zero("c")) == ["1", "1", "0", None]


@pytest.mark.parametrize("code,expected", [
    ("RED", (2, 0, 0)), ("007", (1, 1, 0)), ("002", (1, None, 0)), ("KAT", (0, 1, 20)),
    ("K00", (0, 0, 0)), (None, (None, None, None)), ("K", (0, None, None)),
])
def test_channel(spark, code, expected):
    df = spark.createDataFrame([(code,)], "c string")
    r = df.select(C.channel_family("c"), C.channel_code("c"), C.channel_subcode("c")).first()
    assert tuple(r) == expected


def test_mode_fill_lowest_on_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "employee string")
    assert col_values(impute.impute(df, mean_cols=()), "employee") == ["b", "a", "b", "a", "a"]


def test_country_num(spark):
    df = spark.createDataFrame([("ES",), ("FR",), ("US",), (None,)], "c string")
    assert col_values(df, FX.tiered_in("c")) == [1.0, 0.5, 0.0, 0.0]


def test_customer_type_parity_and_fix(spark):
    from nextbuy.operators.features import customer_type_flag
    df = spark.createDataFrame([("1",), ("2",), (None,)], "customer_type string")
    assert col_values(df, customer_type_flag(False)) == [1, 1, 1]
    assert col_values(df, customer_type_flag(True)) == [0, 1, 1]


def test_circular_month(spark):
    df = spark.createDataFrame([(m,) for m in range(1, 13)], "m int")
    got = [round(v, 3) for v in col_values(df, circular_month("m", 17))]
    assert got == [0.267, 0.433, 0.6, 0.767, 0.933, 1.1, 0.933, 0.767, 0.6, 0.433, 0.267, 0.1]
    assert round(col_values(spark.createDataFrame([(12,)], "m int"), circular_month("m", 11))[0], 3) == 1.1


def test_length_buckets_train(spark):
    rows = []
    for cid, n in ((1, 1), (2, 2), (3, 17), (4, 18)):
        rows += [(cid, t, (t - 1) % 12 + 1, *([1] + [0] * 23)) for t in range(1, n + 1)]
    df = spark.createDataFrame(rows, ["id", "t", "t_month", *Y_COLS])
    h = sequence.build_train(df, max_month=18, max_len=17)
    assert sorted(col_values(h, "id")) == [2, 3]


def test_left_pad(spark):
    df = spark.createDataFrame([([[5.0, 6.0]],)], "x array<array<double>>")
    assert col_values(df, A.left_pad("x", 3, 2)) == [[[-1.0, -1.0], [-1.0, -1.0], [5.0, 6.0]]]


@pytest.mark.parametrize("n,sizes", [(1000, [256, 256, 488]), (300, [300])])
def test_batch_sizes(spark, n, sizes):
    df = spark.createDataFrame([(i, 5) for i in range(n)], "id long, n_obs int")
    b = batches.assign_batches(df).groupBy("batch").count().orderBy("batch")
    assert [r["count"] for r in b.collect()] == sizes


def test_ap_at_k(spark):
    y = [0] * 24
    y[0], y[5] = 1, 1                      # two true labels
    p = [0.0] * 24
    p[0], p[9], p[5] = 0.9, 0.8, 0.7       # hits at ranks 1 and 3
    df = spark.createDataFrame([(y, p), ([0] * 24, p)], "y array<int>, p array<double>")
    got = col_values(df, A.ap_at_k("y", "p"))
    assert round(got[0], 4) == 0.8333 and got[1] == 0.0


def test_new_labels(spark):
    df = spark.createDataFrame([([1, 1, 0, 0], [1, 0, 1, 0])], "y array<int>, l array<int>")
    assert col_values(df, A.new_labels("y", "l")) == [[0, 1, 0, 0]]


def test_rank_ties_higher_index_first(spark):
    df = spark.createDataFrame([([0.5, 0.9, 0.5, 0.1], None)], "p array<double>, o array<int>")
    assert col_values(df, A.ranked_candidates("p", "o", n=4)) == [[1, 2, 0, 3]]


def test_impute_switch_off(spark):
    df = spark.createDataFrame([("b",), (None,)], "employee string")
    assert col_values(impute.impute(df, enabled=False), "employee") == ["b", None]


def test_duplicate_keys_rejected(spark):
    import pytest
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "id long, t int")
    assert sequence.duplicate_keys(df).count() == 1
    with pytest.raises(ValueError):
        sequence.require_unique_keys(df)
    sequence.require_unique_keys(df.distinct())


def test_observed_categories(spark):
    from nextbuy.operators import features
    df = spark.createDataFrame([(0, 20, 28, 1), (2, None, 8, 3), (None, 1, None, None)],
                               "channel_0 int, channel_1 int, province int, segment int")
    df = df.selectExpr("*", "'N' AS employee", "'ES' AS country", "'1' AS customer_type", "'A' AS customer_rel")
    out = features.featurize(df, categories="observed")
    cols = [c for c in out.columns if c.startswith(("channel_", "province_", "segment_")) and c != "province_pop"]
    assert cols == ["channel_0_0", "channel_0_2", "channel_1_1", "channel_1_20", "province_CAT", "province_MAD",
                    "segment_1", "segment_3"]
    assert out.select("channel_1_20", "province_MAD").first() == (1, 1)


def test_length_report_and_clamped_stats(spark):
    rows = []
    for cid, n in ((1, 1), (2, 2), (3, 17), (4, 18)):
        rows += [(cid, t, (t - 1) % 12 + 1, float(-5 if t == 1 else t), *([1] + [0] * 23)) for t in range(1, n + 1)]
    df = spark.createDataFrame(rows, ["id", "t", "t_month", "seniority", *Y_COLS])
    rep = {r["status"]: r["n_customers"] for r in sequence.length_report(df).collect()}
    assert rep == {"too_short": 1, "kept": 3}            # by default no customer is dropped for a long history
    rep = {r["status"]: r["n_customers"] for r in sequence.length_report(df, max_len=17).collect()}
    assert rep == {"too_short": 1, "kept": 2, "too_long": 1}
    assert {r["id"]: r["n_obs"] for r in sequence.build_train(df, 20, attr_cols=()).collect()} == {2: 2, 3: 17, 4: 18}
    assert {r["id"] for r in sequence.build_train(df, 20, attr_cols=(), max_len=17).collect()} == {2, 3}
    plain = sequence.build_test(df, None, 17, 18, attr_cols=("seniority",))
    clamped = sequence.build_test(df, None, 17, 18, attr_cols=("seniority",), clamp_before_stats=True)
    a = {r["id"]: r["attrs"][0] for r in plain.collect()}
    b = {r["id"]: r["attrs"][0] for r in clamped.collect()}
    assert a.keys() == b.keys() and all(a[k] != b[k] for k in a)


def test_trainlog_tie_rules(spark):
    from nextbuy.operators import trainlog
    log = spark.createDataFrame([(0, "m", 5.0), (1, "m", 5.0), (2, "m", 3.0), (3, "m", 3.0), (4, "m", 4.0),
                                 (0, "loss", 1.0), (2, "loss", 9.0), (4, "loss", 8.0), (7, "loss", 8.5), (9, "loss", 7.0), (10, "loss", 1.0)],
                                "epoch int, metric string, value double")
    imp = [(r["epoch"], r["is_best"]) for r in trainlog.improvements(log).orderBy("epoch").collect()]
    assert imp == [(0, 0), (2, 1)]                       # strict improvements only; the loss is excluded
    best = trainlog.best_and_last(log.filter("metric = 'm'")).first()
    assert (best["best_epoch"], best["best_value"], best["last_epoch"], best["last_value"]) == (2, 3.0, 4, 4.0)
    periodic = [(r["epoch"], r["is_best"]) for r in trainlog.periodic_improvements(log).orderBy("epoch").collect()]
    assert periodic == [(2, 0), (4, 0), (9, 1)]           # the loss alone, on epochs 2 and 4 of every 5


def test_history_outer_target_keeps_both_sides(spark):
    hist = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id long, t int")
    tgt = spark.createDataFrame([(1, 3), (3, 3)], "id long, t int")
    rows = {r["id"]: (r["t_count"], r["t_max"], r["target_t"])
            for r in sequence.history_outer_target(hist, tgt).collect()}
    assert rows == {1: (2, 2, 3), 2: (1, 1, None), 3: (None, None, 3)}


def test_feature_vectors_width_and_nulls(spark):
    from nextbuy.operators import score
    h = spark.createDataFrame([(1, [0.5, None], [[1.0, 2.0], [3.0, 4.0]], [1, 0])],
                              "id long, attrs array<double>, x array<array<double>>, y array<int>")
    v = score.feature_vectors(h).first()
    assert list(v["features"]) == [0.5, 0.0, 1.0, 2.0, 3.0, 4.0] and v["y"] == [1, 0]
