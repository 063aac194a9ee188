
from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MEAN_FILL_COLS, MODE_FILL_COLS, PRODUCT_LABELS, Y_COLS, ZSCORE_COLS
from ..functions import clean as C
from ..functions.scale import circular_month, time_fraction
from ..operators import clean, features, impute, scale
from ..sources.tables import read_table
from . import standin as S
from .registry import query

K = "o_orderkey"


def _orders(spark, sf_dir, *cols):
    return S.orders_clean(spark, sf_dir).select(K, *cols)


# --- 2.2 cleaning ------------------------------------------------------------------------------

@query("clean_month_index")
def clean_month_index(spark, sf_dir):
    """CL1/CL2: month index t and calendar month of each order date."""
    return _orders(spark, sf_dir, "t", "t_month")


@query("clean_select")
def clean_select(spark, sf_dir):
    """CL3/CL4/CL19: the whole cleaned snapshot table (renamed, consumed columns dropped)."""
    return S.snapshots_clean(spark, sf_dir)


@query("clean_default_code")
def clean_default_code(spark, sf_dir):
    """CL5: employee code, S or null -> N."""
    return _orders(spark, sf_dir, "employee")


@query("clean_binary_map")
def clean_binary_map(spark, sf_dir):
    """CL6: sex H -> 1, V -> 0, other -> null; S/N flags of the snapshot table."""
    return S.snapshots_clean(spark, sf_dir).select("id", "t", "sex", "is_domestic", "is_foreigner", "is_dead")


@query("clean_try_numeric")
def clean_try_numeric(spark, sf_dir):
    """CL7: text to number, bad text -> null (age, seniority, province, activity, new flag)."""
    return S.snapshots_clean(spark, sf_dir).select("id", "t", "age", "seniority", "province", "is_active",
                                                    "seniority_new")


@query("clean_sentinel")
def clean_sentinel(spark, sf_dir):
    """CL8: is_primary with the sentinel 99 -> 0."""
    return _orders(spark, sf_dir, "is_primary")


@query("clean_regex_strip")
def clean_regex_strip(spark, sf_dir):
    """CL9: customer type with '.0' regex-stripped and whole value P -> 0."""
    return _orders(spark, sf_dir, "customer_type")


@query("clean_merge_code")
def clean_merge_code(spark, sf_dir):
    """CL10: relation type N merged into A."""
    return _orders(spark, sf_dir, "customer_rel")


@query("clean_substring")
def clean_substring(spark, sf_dir):
    """CL11: characters 0/1/2 of the channel code and the segment digit."""
    raw = S.fixtures.raw_orders(spark, sf_dir)
    return raw.select(K, C.char_at("canal_entrada", 0).alias("ch_0"), C.char_at("canal_entrada", 1).alias("ch_1"),
                      C.char_at("canal_entrada", 2).alias("ch_2"), C.segment_digit("segmento", 0).alias("segment"))


@query("clean_channel")
def clean_channel(spark, sf_dir):
    """CL12-CL15: channel family, code and sub-code from the entry channel."""
    return _orders(spark, sf_dir, "channel_0", "channel_1", "channel_2")


@query("clean_income")
def clean_income(spark, sf_dir):
    """CL16: income text with NA removed, parsed, blank -> null."""
    return _orders(spark, sf_dir, "income")


@query("clean_products")
def clean_products(spark, sf_dir):
    """CL17/CL18: raw flag columns renamed to products, empty flags -> 0."""
    s = S.snap(spark, sf_dir)
    raw = s.select(F.col("id").alias("ncodpers"), "t",
                   *[F.when(F.col("t") % 10 == 0, F.lit(None).cast("int")).otherwise(F.col(y)).alias(l)
                     for y, l in zip(Y_COLS, PRODUCT_LABELS)])
    return raw.select(F.col("ncodpers").alias("id"), "t", *clean.clean_products(raw))


@query("clean_null_profile")
def clean_null_profile(spark, sf_dir):
    """CL20: null count and any-null flag of every cleaned column."""
    return clean.null_profile(S.snapshots_clean(spark, sf_dir))


@query("scale_clamp")
def scale_clamp(spark, sf_dir):
    """CL21: negative seniority clamped to 0."""
    return scale.clamp_negatives(_orders(spark, sf_dir, "seniority"))


# --- 2.3 imputation ------------------------------------------------------------------------------

@query("impute_mode")
def impute_mode(spark, sf_dir):
    """IM1: gaps of 16 columns filled with the column mode (lowest value on ties)."""
    df = S.snapshots_clean_once(spark, sf_dir)
    return impute.impute(df, mean_cols=()).select("id", "t", *MODE_FILL_COLS)


@query("impute_mode_wide")
def impute_mode_wide(spark, sf_dir):
    """IM1: exact modes of columns with many distinct values (part, day, price, customer) over all lineitems and orders."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("l_shipdate"), "l_extendedprice", "l_returnflag")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")
    modes = {**impute.exact_modes(li, li.columns), **impute.exact_modes(orders, orders.columns)}
    kinds = {f.name: f.dataType for d in (li, orders) for f in d.schema.fields}
    return spark.range(1).select(*[F.lit(v).cast("string" if c.endswith("date") else kinds[c]).alias(c) for c, v in modes.items()])


@query("impute_mean")
def impute_mean(spark, sf_dir):
    """IM2/IM3: age, seniority and income gaps filled with the column mean."""
    df = S.snapshots_clean_once(spark, sf_dir)
    return impute.impute(df, mode_cols=()).select("id", "t", *MEAN_FILL_COLS)


# --- 2.4 features --------------------------------------------------------------------------------

def _feat(spark, sf_dir, *cols, fix_types=False):
    return features.featurize(S.orders_clean(spark, sf_dir), fix_types=fix_types, keep=(K,)).select(K, *cols)


@query("feat_flag_ne")
def feat_flag_ne(spark, sf_dir):
    """FE1/FE3: employee != N; customer type != 1 (always 1, as in the original) and its text-typed fix."""
    df = S.orders_clean(spark, sf_dir)
    return df.select(K, features.derived_columns()[0], features.customer_type_flag(False).alias("customer_type_bit_not1"),
                     features.customer_type_flag(True).alias("customer_type_fixed"))


@query("feat_tiered_in")
def feat_tiered_in(spark, sf_dir):
    """FE2: country score, ES 1.0 / European list 0.5 / other 0.0."""
    return _feat(spark, sf_dir, "country_num")


@query("feat_group_flags")
def feat_group_flags(spark, sf_dir):
    """FE4: relation-type group flags (I or P; A or R)."""
    return _feat(spark, sf_dir, "customer_rel_I", "customer_rel_A")


@query("feat_onehot")
def feat_onehot(spark, sf_dir):
    """FE5/FE6/FE9: fixed-list one-hot of channel family, channel code and segment."""
    return _feat(spark, sf_dir, *[f"channel_0_{v}" for v in range(3)], *[f"channel_1_{v}" for v in range(9)],
                 *[f"segment_{v}" for v in range(1, 4)])


@query("feat_lookup_onehot")
def feat_lookup_onehot(spark, sf_dir):
    """FE7: province -> community lookup, then one-hot over the 18 communities."""
    from ..constants import COMMUNITIES
    return _feat(spark, sf_dir, *[f"province_{c}" for c in COMMUNITIES])


@query("feat_lookup_value")
def feat_lookup_value(spark, sf_dir):
    """FE8: province -> relative population lookup."""
    return _feat(spark, sf_dir, "province_pop")


@query("imp_off")
def imp_off(spark, sf_dir):
    """IM4: imputation switched off leaves the cleaned table as it is."""
    return impute.impute(S.snapshots_clean(spark, sf_dir), enabled=False)


@query("feat_table")
def feat_table(spark, sf_dir):
    """FE10: the feature table (base, derived, products) of the imputed snapshot table."""
    return features.featurize(impute.impute(S.snapshots_clean_once(spark, sf_dir)))


# --- 2.5 scaling ---------------------------------------------------------------------------------

@query("scale_zstats")
def scale_zstats(spark, sf_dir):
    """SC1: mean and sample standard deviation of age, seniority, income."""
    return scale.zscore_stats_frame(S.orders_clean(spark, sf_dir), ZSCORE_COLS)


@query("scale_zscore")
def scale_zscore(spark, sf_dir):
    """SC2: z-scored age, seniority, income."""
    df = _orders(spark, sf_dir, *ZSCORE_COLS)
    return scale.apply_zscore(df, scale.zscore_stats(df))


@query("scale_fit_apply")
def scale_fit_apply(spark, sf_dir):
    """SC3: statistics of months <= 78 applied to the rows of month 79."""
    df = _orders(spark, sf_dir, "t", *ZSCORE_COLS)
    stats = scale.zscore_stats(df.filter(F.col("t") <= S.TRAIN_MONTH))
    return scale.apply_zscore(df.filter(F.col("t") == S.TEST_MONTH), stats).drop("t")


@query("scale_time")
def scale_time(spark, sf_dir):
    """SC4: t / train month for the training months."""
    s = S.snap(spark, sf_dir).filter(F.col("t") <= S.TRAIN_MONTH)
    return s.select("id", "t", time_fraction("t", S.TRAIN_MONTH).alias("t_scaled"))


@query("scale_month_circular")
def scale_month_circular(spark, sf_dir):
    """SC5: circular closeness of each calendar month to the month after month 78."""
    s = S.snap(spark, sf_dir)
    return s.select("id", "t", "t_month", circular_month("t_month", S.TRAIN_MONTH).alias("t_month_scaled"))
