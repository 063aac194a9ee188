"""Column expressions for the derived (categorical and lookup) features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EU_COUNTRIES, PROVINCE_COMMUNITY, PROVINCE_POP
from .clean import _c, lookup


def flag_ne(c, value) -> Column:
    """1 when the value differs from ``value``; a null also counts as different."""
    return F.coalesce((_c(c) != F.lit(value)).cast("int"), F.lit(1))


def tiered_in(c, top: str = "ES", group=EU_COUNTRIES, top_value=1.0, group_value=0.5, other=0.0) -> Column:
    c = _c(c)
    return (F.when(c == top, F.lit(float(top_value)))
             .when(c.isin(*group), F.lit(float(group_value)))
             .otherwise(F.lit(float(other))))


def member_flag(c, members) -> Column:
    """1 when the value is one of ``members``, else 0 (null -> 0)."""
    return F.coalesce(_c(c).isin(*members).cast("int"), F.lit(0))


def one_hot(c, values, prefix: str) -> list[Column]:
    """Fixed-list one-hot: one 0/1 column per value; null or unseen -> all zeros."""
    c = _c(c)
    return [F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]


def province_community(c) -> Column:
    return lookup(_c(c).try_cast("int"), PROVINCE_COMMUNITY)


def province_population(c) -> Column:
    return lookup(_c(c).try_cast("int"), PROVINCE_POP).cast("double")
