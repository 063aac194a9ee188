"""Cleaned table -> feature table (fixed category lists, so a static schema)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (BASE_COLS, CHANNEL_0_VALUES, CHANNEL_1_VALUES, COMMUNITIES, SEGMENT_VALUES, Y_COLS)
from ..functions import features as FX


def customer_type_flag(fix_types: bool = False):
    """``customer_type != 1``. The original compared text with the number 1,
    which is always true; ``fix_types`` compares with the text "1" instead."""
    if fix_types:
        return FX.flag_ne("customer_type", "1")
    return F.lit(1)


FIXED_CATEGORIES = {"channel_0": CHANNEL_0_VALUES, "channel_1": CHANNEL_1_VALUES,
                    "province": COMMUNITIES, "segment": SEGMENT_VALUES}


def observed_categories(df: DataFrame) -> dict:
    """Categories present in the table, sorted (one small aggregate; code domains are tiny)."""
    row = df.agg(F.array_sort(F.collect_set("channel_0")).alias("channel_0"),
                 F.array_sort(F.collect_set("channel_1")).alias("channel_1"),
                 F.array_sort(F.collect_set(FX.province_community("province"))).alias("province"),
                 F.array_sort(F.collect_set("segment")).alias("segment")).first()
    return {k: list(row[k]) for k in FIXED_CATEGORIES}


def derived_columns(fix_types: bool = False, categories: dict | None = None) -> list:
    cats = {**FIXED_CATEGORIES, **(categories or {})}
    return [
        FX.flag_ne("employee", "N").alias("employee_bit_notN"),
        FX.tiered_in("country").alias("country_num"),
        customer_type_flag(fix_types).alias("customer_type_bit_not1"),
        FX.member_flag("customer_rel", ["I", "P"]).alias("customer_rel_I"),
        FX.member_flag("customer_rel", ["A", "R"]).alias("customer_rel_A"),
        *FX.one_hot("channel_0", cats["channel_0"], "channel_0"),
        *FX.one_hot("channel_1", cats["channel_1"], "channel_1"),
        *FX.one_hot(FX.province_community("province"), cats["province"], "province"),
        FX.province_population("province").alias("province_pop"),
        *FX.one_hot("segment", cats["segment"], "segment"),
    ]


def featurize(df: DataFrame, fix_types: bool = False, ys=Y_COLS, keep=(), categories="fixed") -> DataFrame:
    """Base attributes, derived features, then products (when present), in fixed order.

    ``categories``: "fixed" (the lists the model's attribute vector names;
    static schema, unseen codes -> all zeros), "observed" (one column per
    value present in this table, like dummy encoding of the data), or a
    dict overriding some of the lists.
    """
    cats = observed_categories(df) if categories == "observed" else (None if categories == "fixed" else categories)
    base = [c for c in BASE_COLS if c in df.columns]
    return df.select(*keep, *base, *derived_columns(fix_types, cats), *[c for c in ys if c in df.columns])
