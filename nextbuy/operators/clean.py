"""Raw snapshot rows -> cleaned table (one projection, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..constants import BASE_YEAR, CLEAN_COLS, PRODUCT_LABELS, Y_COLS
from ..functions import clean as C


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, StringType)


def _date(df: DataFrame, c: str, fmt: str):
    return F.to_date(F.col(c), fmt) if _is_text(df, c) else F.to_date(F.col(c))


def _number(df: DataFrame, c: str, to: str):
    """``try_number``; a column that holds integers already is only cast (a value out of range -> null), not written as text and parsed."""
    return F.col(c).try_cast(to) if isinstance(df.schema[c].dataType, IntegralType) else C.try_number(c, to)


def cleaning_columns(df: DataFrame, base_year: int = BASE_YEAR, segment_pos: int = 1,
                     date_fmt: str = "yyyy-MM-dd") -> dict:
    """Output column -> expression, for every output whose raw source column is present."""
    has = set(df.columns)
    out = {}
    if "fecha_dato" in has:
        d = _date(df, "fecha_dato", date_fmt)
        out["t"] = 12 * (F.year(d) - base_year) + F.month(d)
        out["t_month"] = F.month(d)
    if "ncodpers" in has:
        out["id"] = F.col("ncodpers")
    rules = {
        "employee": ("ind_empleado", lambda c: C.default_code(c, "N", ("S",))),
        "country": ("pais_residencia", F.col),
        "sex": ("sexo", lambda c: C.binary_map(c, {"H": 1, "V": 0})),
        "age": ("age", lambda c: _number(df, c, "double")),
        "seniority_new": ("ind_nuevo", lambda c: _number(df, c, "int")),
        "seniority": ("antiguedad", lambda c: _number(df, c, "double")),
        "is_primary": ("indrel", lambda c: C.sentinel(_number(df, c, "int"), 99, 0)),
        "customer_type": ("indrel_1mes", lambda c: C.strip_point_zero(F.col(c).cast("string"))),
        "customer_rel": ("tiprel_1mes", lambda c: C.merge_code(c, "N", "A")),
        "is_domestic": ("indresi", C.binary_map),
        "is_foreigner": ("indext", C.binary_map),
        "is_dead": ("indfall", C.binary_map),
        "channel_0": ("canal_entrada", C.channel_family),
        "channel_1": ("canal_entrada", C.channel_code),
        "channel_2": ("canal_entrada", C.channel_subcode),
        "province": ("cod_prov", lambda c: _number(df, c, "int")),
        "is_active": ("ind_actividad_cliente", lambda c: _number(df, c, "int")),
        "income": ("renta", lambda c: C.income(c) if _is_text(df, c) else F.col(c).cast("double")),
        "segment": ("segmento", lambda c: C.segment_digit(c, segment_pos)),
    }
    for name, (src, rule) in rules.items():
        if src in has:
            out[name] = rule(src)
    return out


def clean_products(df: DataFrame, labels=PRODUCT_LABELS, names=Y_COLS) -> list:
    """The 24 raw flag columns renamed to product names, missing flags -> 0."""
    return [F.coalesce(_number(df, l, "int"), F.lit(0)).alias(n) for l, n in zip(labels, names) if l in df.columns]


def clean(df: DataFrame, base_year: int = BASE_YEAR, segment_pos: int = 1, date_fmt: str = "yyyy-MM-dd",
          keep=(), labels=PRODUCT_LABELS) -> DataFrame:
    """Raw snapshot rows to the cleaned table.

    Output columns follow the cleaned-table order; attributes whose raw
    column is absent are skipped, and product flags (train file only) are
    appended. ``keep`` passes extra columns through unchanged.
    """
    cols = cleaning_columns(df, base_year, segment_pos, date_fmt)
    exprs = [F.col(k) for k in keep] + [cols[c].alias(c) for c in CLEAN_COLS if c in cols]
    return df.select(*exprs, *clean_products(df, labels))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_null, has_null) for every column, from one aggregate."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column", "n_null")
    return long.select("column", "n_null", (F.col("n_null") > 0).cast("int").alias("has_null"))
