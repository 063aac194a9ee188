
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ATTR_COLS, MAX_SEQ_LEN, TOP_K, Y_COLS
from ..operators import metrics, sequence
from ..operators.history_store import HistoryStore, rolling_sets
from . import standin as S
from .registry import explode_steps, query, y_columns


# --- 2.6 filters, aggregations, joins, sequences ------------------------------------------------

@query("seq_month_filter")
def seq_month_filter(spark, sf_dir):
    """SQ1: snapshot rows with t <= train month."""
    return sequence.month_filter(S.snap(spark, sf_dir), S.TRAIN_MONTH)


@query("agg_nonbuyers")
def agg_nonbuyers(spark, sf_dir):
    """SQ2-SQ4: rows of customers who ever owned a product, with their product total."""
    s = sequence.month_filter(S.snap(spark, sf_dir), S.TRAIN_MONTH)
    return sequence.drop_non_buyers(s).select("id", "t", F.col("y_sum").cast("long").alias("y_sum"))


@query("agg_counts_maxs")
def agg_counts_maxs(spark, sf_dir):
    """SQ5-SQ6: months observed and last month per customer."""
    return sequence.counts_and_maxs(S.snap(spark, sf_dir))


@query("join_outer")
def join_outer(spark, sf_dir):
    """SQ7: full outer join of history statistics with target-month rows."""
    s = S.snap_once(spark, sf_dir)
    return sequence.history_outer_target(sequence.month_filter(s, S.TRAIN_MONTH), S.target_rows(s))


@query("join_latest_row")
def join_latest_row(spark, sf_dir):
    """SQ8/SQ16: the latest row (attributes and products) per customer."""
    return sequence.latest_rows(S.snap(spark, sf_dir), ["t_month", *Y_COLS])


@query("join_counts_to_rows")
def join_counts_to_rows(spark, sf_dir):
    """SQ9: every row with its customer's count and last month."""
    return sequence.with_group_stats(S.snap(spark, sf_dir)).select("id", "t", "t_count", "t_max")


@query("seq_length_buckets")
def seq_length_buckets(spark, sf_dir):
    """SQ10/SQ12: customers kept in the training length buckets (2 months or more)."""
    return S.trainset(spark, sf_dir).select("id", "n_obs")


@query("seq_build")
def seq_build(spark, sf_dir):
    """SQ11/SQ13/SQ15: ordered history steps (t, t_month, 24 products) before the last month."""
    return explode_steps(S.trainset(spark, sf_dir))


@query("seq_split_xy")
def seq_split_xy(spark, sf_dir):
    """SQ14: history length, target products and last-step products per customer."""
    h = S.trainset(spark, sf_dir)
    return h.select("id", F.size("x").alias("x_len"), *y_columns("y", "y_"), *y_columns("y_last", "last_"))


@query("seq_left_pad")
def seq_left_pad(spark, sf_dir):
    """SQ17/SQ18/SQ25: scaled training histories left-padded with -1 to the longest possible length."""
    h = S.trainset(spark, sf_dir, scale_time=True)
    return explode_steps(sequence.pad_histories(h, S.PAD_LEN, 26))


@query("seq_test_rows")
def seq_test_rows(spark, sf_dir):
    """IO9/SQ19: the rows of the month to score."""
    return S.target_rows(S.snap(spark, sf_dir))


@query("join_semi_history")
def join_semi_history(spark, sf_dir):
    """SQ20/SQ21: history rows (t <= test month - 1) of the customers of the test month."""
    s = S.snap_once(spark, sf_dir)
    return sequence.history_of(sequence.month_filter(s, S.TEST_MONTH - 1), S.target_rows(s))


@query("set_union_missing")
def set_union_missing(spark, sf_dir):
    """SQ22: history rows union test rows without products (products -> null)."""
    s = S.snap_once(spark, sf_dir)
    hist = sequence.month_filter(s, S.TRAIN_MONTH)
    return sequence.union_missing(hist, S.target_rows(s).select("id", "t", "t_month"))


def _summary(h: DataFrame) -> DataFrame:
    return h.select(
        "id", "n_obs", *[F.get("attrs", i).alias(f"a_{c}") for i, c in enumerate(ATTR_COLS)],
        F.size("x").alias("x_len"),
        F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, b: a + b).alias("x_total"),
        F.aggregate("y", F.lit(0), lambda a, b: a + b).alias("y_count"),
        F.aggregate("y_last", F.lit(0), lambda a, b: a + b).alias("last_count"))


@query("seq_trainset")
def seq_trainset(spark, sf_dir):
    """SQ16/SQ23: training set from the feature table (all 51 attributes, clamped, standardised,
    scaled time), attributes as they are and histories summarised per customer."""
    return _summary(S.full_trainset(spark, sf_dir))


@query("seq_trainset_buyers")
def seq_trainset_buyers(spark, sf_dir):
    """SQ4/SQ23: the training set without customers who never owned a product."""
    return _summary(S.full_trainset(spark, sf_dir, remove_non_buyers=True))


@query("seq_testset")
def seq_testset(spark, sf_dir):
    """SQ16/SQ24: test set for the held-out month 79 (all attributes, training statistics), as seq_trainset."""
    return _summary(S.full_testset(spark, sf_dir))


@query("seq_testset_file")
def seq_testset_file(spark, sf_dir):
    """SQ24/IO9: test set whose target rows come from a separate table without products (y is null)."""
    return _summary(S.full_testset(spark, sf_dir, own_file=True))


@query("seq_testset_padded")
def seq_testset_padded(spark, sf_dir):
    """SQ25: scaled test histories left-padded with -1 to the longest possible length."""
    return explode_steps(sequence.pad_histories(S.full_testset(spark, sf_dir), S.PAD_LEN, 26))


@query("seq_bucket_sizes")
def seq_bucket_sizes(spark, sf_dir):
    """SQ26: customers, steps and channels per training length bucket."""
    return sequence.bucket_sizes(S.trainset(spark, sf_dir))


# --- 2.7 evaluation ------------------------------------------------------------------------------

@query("eval_topk")
def eval_topk(spark, sf_dir):
    """EV4: top-7 products per test customer by owned-masked popularity."""
    return metrics.topk_table(metrics.with_new_only(S.scored_testset(spark, sf_dir)), k=TOP_K)


@query("eval_hits")
def eval_hits(spark, sf_dir):
    """EV6/EV7: hit flag and precision at each of the 7 ranks (new products)."""
    return metrics.hits_table(metrics.with_new_only(S.scored_testset(spark, sf_dir)))


@query("eval_ap7")
def eval_ap7(spark, sf_dir):
    """EV5/EV8: AP@7 per test customer on all products."""
    return metrics.ap_table(S.scored_testset(spark, sf_dir))


@query("eval_map7")
def eval_map7(spark, sf_dir):
    """EV9: MAP@7 on all products."""
    return metrics.map_at_k(S.scored_testset(spark, sf_dir))


@query("eval_new_labels")
def eval_new_labels(spark, sf_dir):
    """EV10: (id, k) of products that are new in the test month."""
    t = metrics.with_new_only(S.scored_testset(spark, sf_dir))
    z = t.select("id", F.posexplode("y").alias("pos", "v"))
    return z.filter(F.col("v") == 1).select("id", (F.col("pos") + 1).alias("k"))


@query("eval_map7_new")
def eval_map7_new(spark, sf_dir):
    """EV11/EV12: MAP@7 on new products with owned products masked."""
    return metrics.map_at_k_new(S.scored_testset(spark, sf_dir))


@query("eval_losses")
def eval_losses(spark, sf_dir):
    """EV13/EV15: mean BCE, MSE, CCE, true-only BCE per history length and overall."""
    return metrics.losses(S.scored_testset(spark, sf_dir))


@query("eval_bce_true_only")
def eval_bce_true_only(spark, sf_dir):
    """EV14: true-only cross-entropy per test customer."""
    t = S.scored_testset(spark, sf_dir)
    return t.select("id", metrics.loss_columns()["bce_true_only"].alias("bce_true_only"))


@query("seq_length_report")
def seq_length_report(spark, sf_dir):
    """SQ10 report: training customers kept (2 months or more) or too short (never scored)."""
    return sequence.length_report(sequence.month_filter(S.snap(spark, sf_dir), S.TRAIN_MONTH), 2)


@query("seq_drop_long")
def seq_drop_long(spark, sf_dir):
    """SQ10 option: training customers left when histories of more than 17 months are dropped on request."""
    h = sequence.build_train(S.snap(spark, sf_dir), S.TRAIN_MONTH, attr_cols=(), max_len=MAX_SEQ_LEN)
    return h.select("id", "n_obs")


# --- histories that grow and roll --------------------------------------------------------------------

def _grown_store(spark, sf_dir, first: int, last: int):
    feats = S.features_once(spark, sf_dir)
    store = HistoryStore.build(feats.filter(F.col("t") <= first), "histories", ATTR_COLS, dealt=True)
    for month in range(first + 1, last + 1):
        store = store.append(feats.filter(F.col("t") == month))
    return store


@query("seq_incremental_train")
def seq_incremental_train(spark, sf_dir):
    """SQ23: the training set from stored histories up to month 75 with months 76 to 78 appended one by one."""
    return _summary(_grown_store(spark, sf_dir, S.TRAIN_MONTH - 3, S.TRAIN_MONTH).training(spark))


@query("seq_incremental_test")
def seq_incremental_test(spark, sf_dir):
    """SQ24: the test set of month 79 from stored histories up to month 77 with months 78 and 79 appended."""
    return _summary(_grown_store(spark, sf_dir, S.TRAIN_MONTH - 1, S.TEST_MONTH).testing(spark, S.TRAIN_MONTH))


@query("seq_rolling_sets")
def seq_rolling_sets(spark, sf_dir):
    """SQ23/SQ24/EV19: training and test sets of two (train month, test month) pairs cut from one stored scan."""
    sets = rolling_sets(S.features_once(spark, sf_dir), [(S.TRAIN_MONTH - 6, S.TEST_MONTH - 6), (S.TRAIN_MONTH, S.TEST_MONTH)])
    parts = [_summary(h).select(F.lit(t).alias("test_month"), F.lit(part).alias("part"), "*")
             for (_, t), pair in sets.items() for part, h in zip(("train", "test"), pair, strict=True)]
    return reduce(DataFrame.unionByName, parts)
