"""Ranked recommendation lists from product scores.

Scores and owned products are per-customer arrays, so candidate selection,
the set difference and the ranking are row-local (no shuffle). The only
exchange is the left join of the scores with the month snapshot; the
per-product tallies are single aggregates with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import NUM_PRODUCTS, P_COLS, PRODUCT_LABELS, TOP_K, Y_COLS
from ..functions.arrays import ranked_candidates


def owned_at_month(snapshots: DataFrame, month: int, ys=Y_COLS) -> DataFrame:
    """(id, y...) of the snapshot rows of exactly ``month`` (the filter reaches the scan)."""
    return snapshots.filter(F.col("t") == month).select("id", *ys)


def join_owned(pred: DataFrame, owned: DataFrame, p_cols=P_COLS, ys=Y_COLS) -> DataFrame:
    """(id, p array, owned array): scores left-joined with the month snapshot; none -> null."""
    o = owned.select("id", F.array(*[F.col(c).cast("int") for c in ys]).alias("owned"))
    p = pred.select("id", F.array(*[F.col(c).cast("double") for c in p_cols]).alias("p"))
    return p.join(o, "id", "left")


def _labels():
    return F.array(*[F.lit(x) for x in PRODUCT_LABELS])


def product_counts(joined: DataFrame) -> DataFrame:
    """(k, label, n_pos, n_new): customers with score > 0, and with score > 0 while not owning it.

    A customer without a snapshot row is not counted as "new".
    """
    aggs = []
    for i in range(NUM_PRODUCTS):
        p, o = F.nanvl(F.get("p", i), F.lit(0.0)), F.get("owned", i)  # a NaN score is not above 0
        aggs += [F.count_if(p > 0).alias(f"pos_{i}"), F.count_if((p > 0) & (o == 0)).alias(f"new_{i}")]
    wide = joined.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.col(f"pos_{i}").alias("n_pos"),
                              F.col(f"new_{i}").alias("n_new")) for i in range(NUM_PRODUCTS)])
    return (wide.select(F.inline(rows))
                .select("k", F.element_at(_labels(), F.col("k")).alias("label"), "n_pos", "n_new"))


def rank_products(joined: DataFrame) -> DataFrame:
    """Adds ``ranked``: 0-based candidates (score > 0, not owned) by score, ties -> higher index first."""
    return joined.withColumn("ranked", ranked_candidates("p", "owned"))


def candidates_table(ranked: DataFrame) -> DataFrame:
    """(id, k): candidate products after removing owned ones (1-based k)."""
    return ranked.select("id", F.explode("ranked").alias("i")).select("id", (F.col("i") + 1).alias("k"))


def ranked_table(ranked: DataFrame) -> DataFrame:
    """(id, pos, k, score) for every ranked candidate."""
    z = ranked.select("id", "p", F.posexplode("ranked").alias("pos", "i"))
    return z.select("id", (F.col("pos") + 1).alias("pos"), (F.col("i") + 1).alias("k"), F.get("p", F.col("i")).alias("score"))


def top_tally(ranked: DataFrame, k: int = TOP_K) -> DataFrame:
    """(k, label, n_top): how often each product is among the first ``k`` places (all 24 listed)."""
    top = F.slice("ranked", 1, k)
    wide = ranked.agg(*[F.count_if(F.array_contains(top, i)).alias(f"n_{i}") for i in range(NUM_PRODUCTS)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.col(f"n_{i}").alias("n_top")) for i in range(NUM_PRODUCTS)])
    return wide.select(F.inline(rows)).select("k", F.element_at(_labels(), F.col("k")).alias("label"), "n_top")


def format_lists(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """(ncodpers, added_products): labels joined by spaces; no candidate -> empty text.

    The original writes the whole ranked list; ``limit`` cuts it (e.g. 7).
    """
    idx = F.slice("ranked", 1, limit) if limit else F.col("ranked")
    labels = F.concat_ws(" ", F.transform(idx, lambda i: F.element_at(_labels(), i + 1)))
    return ranked.select(F.col("id").alias("ncodpers"), labels.alias("added_products"))


def recommend(pred: DataFrame, snapshots: DataFrame, month: int, limit: int | None = None) -> DataFrame:
    """Scores + snapshot of ``month`` -> ranked lists per customer."""
    return format_lists(rank_products(join_owned(pred, owned_at_month(snapshots, month))), limit)
