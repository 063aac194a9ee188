"""Column expressions for cleaning raw snapshot attributes.

All are built-in Spark expressions (whole-stage codegen, no Python per row).
ANSI mode is on in Spark 4, so text -> number goes through ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CHANNEL_ZERO_CODES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: dict) -> Column:
    """A literal map column built from a small fixed dictionary."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def lookup(c, mapping: dict) -> Column:
    """Dictionary lookup; a missing key or a null gives null."""
    return F.try_element_at(literal_map(mapping), _c(c))


def month_index(date_text, base_year: int, fmt: str = "yyyy-MM-dd") -> Column:
    """t = 12 * (year - base_year) + month of a date (text or date/timestamp)."""
    d = _c(date_text)
    d = F.to_date(d, fmt) if fmt else F.to_date(d)
    return 12 * (F.year(d) - base_year) + F.month(d)


def calendar_month(date_text, fmt: str = "yyyy-MM-dd") -> Column:
    d = _c(date_text)
    return F.month(F.to_date(d, fmt) if fmt else F.to_date(d))


def default_code(c, default: str = "N", replaced=("S",)) -> Column:
    """Replace null and the listed codes by ``default``."""
    c = _c(c)
    return F.when(c.isNull() | c.isin(*replaced), F.lit(default)).otherwise(c)


def binary_map(c, mapping: dict | None = None) -> Column:
    """S/N style flags (or any dictionary) to integers, other values to null."""
    return lookup(c, mapping or {"S": 1, "N": 0}).cast("int")


#: A plain decimal number, blanks around it allowed (no NaN, no infinities, no type suffixes).
NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


#: Digits that surely fit 64 bits: parsed at once.
_DIGITS = r"^[+-]?[0-9]{1,18}$"
#: Other integers are parsed as decimals with room for all 64-bit values, never through floating point.
_EXACT = "decimal(38,18)"


def try_integer(c, to: str = "bigint") -> Column:
    """Text to an exact integer: ``9007199254740993``, ``1.0``, ``1.375586e+06``; a fraction, a value out of range or bad text -> null."""
    text = F.trim(_c(c).cast("string"))
    d = F.when(text.rlike(NUMBER), text.try_cast(_EXACT))
    # digits beyond the decimal's scale would be rounded away: only zeros may stand there
    exact = ~text.rlike(r"[.][0-9]{18}[0-9]*[1-9]") & (d == F.floor(d))
    return F.when(text.rlike(_DIGITS), text.try_cast("bigint").try_cast(to)).when(exact, d.try_cast(to))


def try_number(c, to: str = "double") -> Column:
    """Text to number; what is not a finite decimal number (``NaN``, ``1d``, ``Infinity``) -> null.

    Integer targets are exact (see ``try_integer``): ``"1.0"`` reads as 1, ``"1.7"`` as null.
    """
    if to in ("tinyint", "smallint", "int", "bigint"):
        return try_integer(c, to)
    text = F.trim(_c(c).cast("string"))
    value = text.try_cast("double")
    d = F.when(text.rlike(NUMBER) & (F.abs(value) < float("inf")), value)  # the text is matched once
    return d if to == "double" else d.try_cast(to)


def why_not_number(c, to: str) -> Column:
    """Why a text is not read as a number of the type: ``not a number``, ``not an integer`` or ``out of range``; null if it is read, or blank."""
    text = F.trim(_c(c).cast("string"))
    whole = to in ("tinyint", "smallint", "int", "bigint")
    wide = text.try_cast(_EXACT)
    reason = F.when(~text.rlike(NUMBER), "not a number")
    if whole:
        fraction = text.rlike(r"[.][0-9]{18}[0-9]*[1-9]") | (wide != F.floor(wide))
        reason = reason.when(wide.isNull(), "out of range").when(fraction, "not an integer")
    return F.when((text != "") & try_number(c, to).isNull(), reason.otherwise("out of range"))


def sentinel(c, value, replacement) -> Column:
    c = _c(c)
    return F.when(c == value, F.lit(replacement)).otherwise(c)


def strip_point_zero(c) -> Column:
    """Regex-remove ``.0`` (dot = any character), then the whole value ``P`` -> ``0``."""
    x = F.regexp_replace(_c(c), ".0", "")
    return F.when(x == "P", F.lit("0")).otherwise(x)


def merge_code(c, code: str, into: str) -> Column:
    return sentinel(c, code, into)


def char_at(c, pos: int) -> Column:
    """0-based character slice [pos, pos+1); past the end gives ''."""
    return F.substring(_c(c), pos + 1, 1)


def letter_rank(ch: Column) -> Column:
    """A=1 .. Z=26, anything else null."""
    return F.when(ch.rlike("^[A-Z]$"), F.ascii(ch) - 64)


def channel_family(c) -> Column:
    """channel_0: null -> null, RED -> 2, starts with 0 -> 1, else 0."""
    c = _c(c)
    return (F.when(c.isNull(), F.lit(None).cast("int"))
             .when(c.startswith("0"), F.lit(1))
             .when(c == "RED", F.lit(2))
             .otherwise(F.lit(0)))


def channel_code(c) -> Column:
    """channel_1: codes starting with 0 via a fixed map (unknown -> null);
    K with a second character other than 0 -> its letter rank; else 0."""
    c = _c(c)
    c0, c1 = char_at(c, 0), char_at(c, 1)
    return (F.when(c.isNull(), F.lit(None).cast("int"))
             .when(c.startswith("0"), lookup(c, CHANNEL_ZERO_CODES).cast("int"))
             .when((c0 == "K") & (c1 != "0"), letter_rank(c1))
             .otherwise(F.lit(0)))


def channel_subcode(c) -> Column:
    """channel_2: K with a third character other than 0 -> its letter rank; else 0."""
    c = _c(c)
    c0, c2 = char_at(c, 0), char_at(c, 2)
    return (F.when(c.isNull(), F.lit(None).cast("int"))
             .when((c0 == "K") & (c2 != "0"), letter_rank(c2))
             .otherwise(F.lit(0)))


def income(c) -> Column:
    """Text income: drop ``NA``, then parse; blank or bad -> null."""
    return try_number(F.replace(_c(c).cast("string"), F.lit("NA"), F.lit("")))


def segment_digit(c, pos: int = 1) -> Column:
    """The segment digit at 0-based ``pos`` of the segment text."""
    return char_at(c, pos).try_cast("int")


def clamp_negative(c) -> Column:
    """Negative -> 0; null stays null."""
    c = _c(c)
    return F.when(c < 0, F.lit(0)).otherwise(c)
