"""Evaluation: top-k, AP@K / MAP@K (all or new products only) and losses.

Inputs are history rows (``id``, ``n_obs``, ``y``, ``y_last``) with a
score array ``p``. Everything is row-local array math plus global
averages (partial aggregation), so no step shuffles customer rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TOP_K
from ..functions.arrays import (ap_at_k, bce_true_only, binary_crossentropy, categorical_crossentropy,
                                count_true, hits_at, mask_owned, mean_squared_error, new_labels,
                                precision_on_hits, topk_indices)


def with_new_only(df: DataFrame, y_col: str = "y", last_col: str = "y_last", p_col: str = "p") -> DataFrame:
    """Replace labels by new products and mask the scores of owned products."""
    return df.withColumns({y_col: new_labels(y_col, last_col), p_col: mask_owned(p_col, last_col)})


def require_labels(df: DataFrame, y_col: str = "y") -> DataFrame:
    """Metrics need known targets: rows without labels are an error, not a zero."""
    bad = F.col(y_col).isNull() | F.exists(y_col, lambda v: v.isNull())
    return df.withColumn(y_col, F.when(bad, F.raise_error(F.lit("metric on rows without labels")))
                         .otherwise(F.col(y_col)))


def topk_table(df: DataFrame, p_col: str = "p", k: int = TOP_K) -> DataFrame:
    """(id, rank, k): the k best products per row (1-based product number)."""
    return (df.select("id", F.posexplode(topk_indices(p_col, k)).alias("pos", "idx"))
              .select("id", (F.col("pos") + 1).alias("rank"), (F.col("idx") + 1).alias("k")))


def hits_table(df: DataFrame, y_col: str = "y", p_col: str = "p", k: int = TOP_K) -> DataFrame:
    """(id, rank, hit, prec): hit flag and precision-on-hit at each of the k ranks."""
    hits = hits_at(y_col, topk_indices(p_col, k))
    z = df.select("id", hits.alias("h")).select("id", "h", precision_on_hits("h").alias("pr"))
    return z.select("id", F.posexplode(F.arrays_zip("h", "pr")).alias("pos", "z")).select(
        "id", (F.col("pos") + 1).alias("rank"), F.col("z.h").alias("hit"), F.col("z.pr").alias("prec"))


def ap_table(df: DataFrame, y_col: str = "y", p_col: str = "p", k: int = TOP_K) -> DataFrame:
    """(id, n_true, ap): average precision at k per row."""
    return df.select("id", count_true(y_col).alias("n_true"), ap_at_k(y_col, p_col, k).alias("ap"))


def map_at_k(df: DataFrame, y_col: str = "y", p_col: str = "p", k: int = TOP_K) -> DataFrame:
    """One row: (n, map) - mean AP over all rows, rows without true labels count as 0."""
    ap = ap_table(require_labels(df, y_col), y_col, p_col, k)
    return ap.agg(F.count("*").alias("n"), F.avg("ap").alias("map"))


def map_at_k_new(df: DataFrame, k: int = TOP_K) -> DataFrame:
    """MAP@K on products that are new compared with the last observed month."""
    return map_at_k(with_new_only(require_labels(df)), k=k)


def loss_columns(y_col: str = "y", p_col: str = "p") -> dict:
    return {
        "bce": binary_crossentropy(y_col, p_col),
        "mse": mean_squared_error(y_col, p_col),
        "cce": categorical_crossentropy(y_col, p_col),
        "bce_true_only": bce_true_only(y_col, p_col),
    }


def losses(df: DataFrame, y_col: str = "y", p_col: str = "p") -> DataFrame:
    """Mean losses per history length and overall (rollup; n_obs null = all)."""
    per_row = require_labels(df, y_col).select("n_obs", *[v.alias(k) for k, v in loss_columns(y_col, p_col).items()])
    return (per_row.rollup("n_obs")
                   .agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("bce", "mse", "cce", "bce_true_only")]))
