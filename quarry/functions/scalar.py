"""Scalar column expressions.

Everything here builds a ``Column`` from built-in functions, so it stays inside
whole-stage codegen; nothing is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- arithmetic
def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / NULLIF(den, 0)`` - NULL instead of an ANSI divide-by-zero."""
    return _c(num) / F.nullif(_c(den), F.lit(0))


def pct(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den * 100`` with NULL for a zero or NULL denominator."""
    return F.try_divide(_c(num), _c(den)) * F.lit(100.0)


def half_point_round(x: ColumnOrName) -> Column:
    """Round to the nearest half point with banker's rounding (R ``round(x*2)/2``)."""
    return F.bround(_c(x) * 2, 0) / 2


def clip(x: ColumnOrName, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


# ---------------------------------------------------------------- odds
def american_to_decimal(odds: ColumnOrName) -> Column:
    """Decimal odds from American odds: ``+o -> 1 + o/100``, ``-o -> 1 + 100/|o|``."""
    o = _c(odds).cast("double")
    return F.when(o > 0, 1.0 + o / 100.0).otherwise(1.0 + 100.0 / F.nullif(F.abs(o), F.lit(0.0)))


# ---------------------------------------------------------------- nulls, booleans
def to_bool(x: ColumnOrName) -> Column:
    """Boolean normalisation: TRUE stays TRUE, NULL or anything else is FALSE."""
    return F.coalesce(_c(x) == F.lit(True), F.lit(False))


def blank_to_null(x: ColumnOrName) -> Column:
    """``NULLIF(x, '')`` (H1, H6)."""
    return F.nullif(_c(x), F.lit(""))


def signed_by_side(key: ColumnOrName, home: ColumnOrName, away: ColumnOrName, x: ColumnOrName) -> Column:
    """``key = home -> x``, ``key = away -> -x``, else NULL."""
    return F.when(_c(key) == _c(home), _c(x)).when(_c(key) == _c(away), -_c(x))


# ---------------------------------------------------------------- dates (H7, H8)
def parse_date(x: ColumnOrName) -> Column:
    """Tolerant date parse: ISO first, then ``M/d/yyyy``; garbage gives NULL."""
    s = _c(x).cast("string")
    return F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(s, "M/d/yyyy"))


def month_start(x: ColumnOrName) -> Column:
    """``DATE_TRUNC('month', x)`` as a DATE (avoids the session-zone timestamp, P1)."""
    return F.trunc(F.to_date(_c(x)), "month")


# ---------------------------------------------------------------- text
def week_to_number(week_text: ColumnOrName) -> Column:
    """Week label to number: digits -> int, wild/division/champ/super -> 19..22."""
    w = F.lower(_c(week_text))
    return (
        F.when(w.rlike("^[0-9]+$"), w.try_cast("int"))
        .when(w.like("%wild%"), F.lit(19))
        .when(w.like("%division%"), F.lit(20))
        .when(w.like("%champ%"), F.lit(21))
        .when(w.like("%super%"), F.lit(22))
    )


def year_from_release(x: ColumnOrName) -> Column:
    """``split(x, ', ')[-1][:4]`` (H4)."""
    return F.substring(F.element_at(F.split(_c(x), ", "), -1), 1, 4)


# ---------------------------------------------------------------- formatting
def fmt_pct(x: ColumnOrName, digits: int = 2) -> Column:
    return F.concat(F.format_number(_c(x) * 100, digits), F.lit("%"))


def fmt_money(x: ColumnOrName) -> Column:
    v = _c(x)
    return F.concat(F.when(v < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(v), 0))


def money_compact(x: ColumnOrName) -> Column:
    """``$1.2M``, ``$3.4K`` or ``$56``; the exact value is rounded half-even, as Python formats."""
    v = _c(x)
    a = F.abs(v)

    def digits(y: Column, pattern: str) -> Column:
        return F.call_function("format_number", y, F.lit(pattern))

    return (
        F.when(a >= 1_000_000, F.concat(F.lit("$"), digits(v / 1_000_000, "0.0"), F.lit("M")))
        .when(a >= 1_000, F.concat(F.lit("$"), digits(v / 1_000, "0.0"), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), digits(v, "0")))
    )


def week_label(week: ColumnOrName, is_playoff: ColumnOrName) -> Column:
    """``W{week}-PO`` / ``W{week}-REG``."""
    return F.concat(F.lit("W"), _c(week).cast("string"), F.when(_c(is_playoff), F.lit("-PO")).otherwise(F.lit("-REG")))


# ---------------------------------------------------------------- portable draws
HASH_PRIME = (1 << 31) - 1


def replicate_hash(key, replicate, seed: int):
    """Two quadratic steps modulo a prime, in 64-bit integers that every engine has; spread over 0..prime - 1 (keys from 0)."""
    x = (key % HASH_PRIME * 1103 + replicate * 7919 + seed) % HASH_PRIME
    x = (x * x + 12345 * x + 1) % HASH_PRIME
    return (x * x + 54321 * x + 7) % HASH_PRIME
