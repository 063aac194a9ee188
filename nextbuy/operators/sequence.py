"""Per-customer month histories: filters, group statistics, sequences, padding.

A history is one row per customer with ``x`` = the earlier months as
``array<array<double>>`` (channels: optional scaled t, t_month, then the
24 products), ``y`` = the products of the customer's last month and
``attrs`` = the attribute vector of that last month.

Since (id, t) is unique, a customer group holds at most one row per
month, so collecting a history never gathers an unbounded group; the
length filter runs on the count of the same aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PAD_VALUE, Y_COLS
from ..functions.arrays import left_pad
from .scale import apply_zscore, clamp_negatives, scale_time, zscore_stats


# --- filters and group statistics -------------------------------------------------------------

def month_filter(df: DataFrame, max_month: int | None) -> DataFrame:
    """Rows with t <= max_month (no filter when max_month is not positive)."""
    return df.filter(F.col("t") <= max_month) if max_month and max_month > 0 else df


def product_row_sum(ys=Y_COLS) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in ys])


def drop_non_buyers(df: DataFrame, ys=Y_COLS) -> DataFrame:
    """Keep customers who owned any product in any month; adds their total ``y_sum``.

    The totals are pre-aggregated and joined back, so no customer's rows are sorted in one task.
    """
    total = df.groupBy("id").agg(F.sum(product_row_sum(ys)).alias("y_sum")).filter(F.col("y_sum") > 0)
    return df.join(total, "id")


def duplicate_keys(df: DataFrame, keys=("id", "t")) -> DataFrame:
    """(keys..., n) for keys that occur more than once; histories assume none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def require_unique_keys(df: DataFrame, keys=("id", "t")) -> DataFrame:
    """Raise when a (customer, month) appears twice; returns the table unchanged."""
    dup = duplicate_keys(df, keys).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {tuple(dup[0][k] for k in keys)} ({dup[0]['n']} rows)")
    return df


def counts_and_maxs(df: DataFrame) -> DataFrame:
    """(id, t_count, t_max) in one aggregate."""
    return df.groupBy("id").agg(F.count("t").alias("t_count"), F.max("t").alias("t_max"))


def latest_rows(df: DataFrame, cols) -> DataFrame:
    """(id, t_count, t_max, cols of the row at t_max) - the latest row per customer."""
    latest = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col("t"))
    g = df.groupBy("id").agg(F.count("t").alias("t_count"), F.max("t").alias("t_max"), latest.alias("_r"))
    return g.select("id", "t_count", "t_max", *[F.col(f"_r.{c}").alias(c) for c in cols])


def with_group_stats(df: DataFrame) -> DataFrame:
    """Every row with its customer's t_count and t_max (aggregated, then joined back)."""
    return df.join(counts_and_maxs(df), "id")


def history_outer_target(history: DataFrame, target: DataFrame) -> DataFrame:
    """Full outer join of per-customer history statistics with target-month rows."""
    stats = counts_and_maxs(history)
    tgt = target.select(F.col("id").alias("tid"), F.col("t").alias("target_t"))
    j = stats.join(tgt, stats.id == tgt.tid, "full")
    return j.select(F.coalesce("id", "tid").alias("id"), "t_count", "t_max", "target_t")


def history_of(history: DataFrame, target: DataFrame) -> DataFrame:
    """History rows of the customers present in ``target`` (left semi join)."""
    return history.join(target.select("id"), "id", "left_semi")


def union_missing(history: DataFrame, target: DataFrame) -> DataFrame:
    """Union by name; columns missing in ``target`` become null; history column order kept."""
    return history.unionByName(target, allowMissingColumns=True).select(*history.columns)


def select_target_rows(train: DataFrame, test: DataFrame | None, test_month: int,
                       last_file_month: int) -> DataFrame:
    """Rows of the month to score: the test file past the training file, else that month of it.

    (``build_test`` also accepts ``target=None`` for the second case and then
    reads both from one scan.)
    """
    if test_month > last_file_month:
        if test is None:
            raise ValueError("test_month is past the training file; a test table is required")
        return test
    return train.filter(F.col("t") == test_month)


# --- sequences --------------------------------------------------------------------------------

def collect_histories(rows: DataFrame, ys=Y_COLS, attr_cols=(), include_time: bool = True,
                      max_obs: int | None = None) -> DataFrame:
    """Group month rows into one history row per customer.

    ``rows`` holds ``id``, integer ``_t`` (order), channel columns ``t``,
    ``t_month`` (possibly scaled), the product columns and one copy
    ``_a_<name>`` per attribute (see ``with_attr_copies``).

    With ``max_obs``, customers with more rows are dropped *before* the
    collect (counted with partial aggregation, then anti-joined). Without it
    every customer stays; a history has at most one step per month.
    """
    if max_obs is not None:
        long = rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > max_obs)
        rows = rows.join(long.select("id"), "id", "left_anti")
    time_ch = [F.col("t").cast("double"), F.col("t_month").cast("double")] if include_time else []
    step = F.struct(F.col("_t").alias("o"),
                    F.array(*time_ch).cast("array<double>").alias("ch"),
                    F.array(*[F.col(c).cast("int") for c in ys]).alias("y"))
    aggs = [F.count("_t").alias("n_obs"), F.max("_t").alias("t_max"),
            F.array_sort(F.collect_list(step)).alias("steps")]
    if attr_cols:
        aggs.append(F.max_by(F.struct(*[F.col(f"_a_{c}").cast("double").alias(c) for c in attr_cols]), F.col("_t"))
                    .alias("_a"))
    g = rows.groupBy("id").agg(*aggs)
    n = F.size("steps")
    x = F.transform(F.slice("steps", 1, n - 1),
                    lambda s: F.concat(s["ch"], F.transform(s["y"], lambda v: v.cast("double"))))
    out = [F.col("id"), F.col("n_obs"), F.col("t_max"),
           (F.array(*[F.col(f"_a.{c}") for c in attr_cols]) if attr_cols else F.array().cast("array<double>"))
           .alias("attrs"),
           F.when(n >= 2, x).otherwise(F.array().cast("array<array<double>>")).alias("x"),
           F.element_at("steps", -1)["y"].alias("y"),
           F.when(n >= 2, F.element_at("steps", -2)["y"]).alias("y_last")]
    return g.select(*out)


def length_report(rows: DataFrame, min_len: int = 2, max_len: int | None = None) -> DataFrame:
    """(status, n_customers): customers kept, too short (never scored) or, with ``max_len``, too long (dropped)."""
    n = rows.groupBy("id").agg(F.count("*").alias("n"))
    too_long = F.col("n") > max_len if max_len is not None else F.lit(False)
    status = F.when(F.col("n") < min_len, "too_short").when(too_long, "too_long").otherwise("kept")
    return n.groupBy(status.alias("status")).agg(F.count("*").alias("n_customers"))


def length_filter(h: DataFrame, min_len: int = 2, max_len: int | None = None) -> DataFrame:
    """Keep histories of at least ``min_len`` observed months and, only on request, at most ``max_len``."""
    h = h.filter(F.col("n_obs") >= min_len)
    return h.filter(F.col("n_obs") <= max_len) if max_len is not None else h


def pad_histories(h: DataFrame, seq_len: int, width: int, value: float = PAD_VALUE) -> DataFrame:
    """Left-pad ``x`` to ``seq_len`` steps of ``width`` channels with ``value``."""
    return h.withColumn("x", left_pad("x", seq_len, width, value))


def bucket_sizes(h: DataFrame) -> DataFrame:
    """Per history length: customers, steps of x, channels per step."""
    return (h.groupBy("n_obs")
             .agg(F.count("*").alias("n_customers"),
                  F.max(F.size("x")).alias("n_steps"),
                  F.max(F.size(F.element_at("x", 1))).alias("n_channels")))


def with_attr_copies(df: DataFrame, attr_cols) -> DataFrame:
    """Copy attributes to ``_a_<name>`` (null when the table lacks them)."""
    return df.withColumns({f"_a_{c}": (F.col(c) if c in df.columns else F.lit(None)).cast("double")
                           for c in attr_cols})


def _prepare(df: DataFrame, month: int, scale: bool, attr_cols) -> DataFrame:
    df = df.withColumn("_t", F.col("t"))
    df = scale_time(df, month) if scale else df
    return with_attr_copies(df, attr_cols)


def build_train(df: DataFrame, max_month: int, attr_cols=("t",), ys=Y_COLS,
                remove_non_buyers: bool = False, scale_time_dim: bool = False,
                include_time: bool = True, max_len: int | None = None, min_len: int = 2) -> DataFrame:
    """Training histories ending at each customer's own last month <= max_month.

    Steps: month filter, clamp seniority, z-score age/seniority/income,
    optional non-buyer removal, optional time scaling, histories, length filter.
    ``max_len`` is an option that drops customers with more months; by default
    none are dropped.
    """
    df = month_filter(df, max_month)
    df = clamp_negatives(df)
    df = apply_zscore(df, zscore_stats(df))
    if remove_non_buyers:
        df = drop_non_buyers(df, ys)
    df = _prepare(df, max_month, scale_time_dim, attr_cols)
    h = collect_histories(df, ys, list(attr_cols), include_time, max_obs=max_len)
    return length_filter(h, min_len, max_len)


def build_test(history: DataFrame, target: DataFrame | None, train_month: int, test_month: int,
               attr_cols=("t",), ys=Y_COLS, scale_time_dim: bool = False, include_time: bool = True,
               max_len: int | None = None, min_len: int = 2, clamp_before_stats: bool = False) -> DataFrame:
    """Histories ending at ``test_month`` for the customers of the target rows.

    History months <= test_month - 1; z-score statistics from history
    months <= train_month (seniority not clamped there, as in the original;
    ``clamp_before_stats`` clamps it first, like the training statistics);
    target rows clamped and standardised.

    ``target=None`` means the target rows are the ``test_month`` rows of
    ``history`` itself (a held-out month). With a separate ``target`` table (a
    test file past the training months) the two are unioned; ``y`` is null when
    the target rows carry no products. Either way history rows are first
    reduced to the customers that have a target row (semi join; no exchange when the
    tables are bucketed by id), then collected. Attributes travel on target rows only.
    """
    most = None if max_len is None else max_len + 1
    last_month = test_month - 1
    if last_month < 1:
        raise ValueError("test_month must be at least 2")
    stats_rows = month_filter(month_filter(history, last_month), train_month)
    stats = zscore_stats(clamp_negatives(stats_rows) if clamp_before_stats else stats_rows)
    if target is None:
        rows = history_of(history.filter(F.col("t") <= test_month), history.filter(F.col("t") == test_month))
        rows = apply_zscore(clamp_negatives(rows), stats)
        rows = _prepare(rows, last_month, scale_time_dim, attr_cols)
        rows = rows.withColumns({f"_a_{c}": F.when(F.col("_t") == test_month, F.col(f"_a_{c}")) for c in attr_cols})
        return length_filter(collect_histories(rows, ys, list(attr_cols), include_time, max_obs=most), min_len, most)
    hist = history_of(month_filter(history, last_month), target)
    tgt = apply_zscore(clamp_negatives(target), stats)
    hist = _prepare(hist, last_month, scale_time_dim, attr_cols)
    tgt = _prepare(tgt, last_month, scale_time_dim, attr_cols)
    has_y = all(c in tgt.columns for c in ys)
    base, copies = ["id", "_t", "t", "t_month"], [f"_a_{c}" for c in attr_cols]
    t_rows = tgt.select(*base, *copies, *ys) if has_y else tgt.select(*base, *copies)
    columns = [*base, *copies, *ys]
    rows = hist.select(*base, *ys).unionByName(t_rows, allowMissingColumns=True).select(*columns)
    h = length_filter(collect_histories(rows, ys, list(attr_cols), include_time, max_obs=most), min_len, most)
    return h if has_y else h.withColumn("y", F.lit(None).cast("array<int>"))
