"""Aggregate expressions shared by the operators.

Money is summed exactly: a double sum depends on the order partial sums are
combined in, i.e. on the partitioning, so two runs of the same query on
different cluster layouts could disagree in the last cent. ``exact_sum``
splits every amount into whole units and micro-units (both LONG, exact for
amounts with up to six decimals) and sums the two parts separately - plain
long additions inside whole-stage codegen and the partial aggregate, with no
overflow for realistic totals (whole units up to 9.2e18) - and only the one
result per group is combined into a DECIMAL(38,6). Casting every row to a
wide DECIMAL instead costs about 8x the CPU (string-based conversion and
BigDecimal accumulation).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_TYPE = "decimal(24,6)"
MONEY_DIGITS = 2
RATIO_DIGITS = 6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exact_sum(x) -> Column:
    """Order-independent sum as DECIMAL(38,6) (amounts rounded half-up to 6 decimals), NULL for no rows."""
    v = _c(x).cast("double")
    whole = F.floor(v)
    micro = F.floor((v - whole) * 1_000_000.0 + 0.5)
    return (F.sum(whole).cast("decimal(38,6)")
            + F.sum(micro).cast("decimal(38,6)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,6)")


def money_sum(x, digits: int = MONEY_DIGITS) -> Column:
    """Exact sum rounded half-up to ``digits``, returned as DOUBLE."""
    return F.round(exact_sum(x), digits).cast("double")


def money(x, digits: int = MONEY_DIGITS) -> Column:
    """A single (already aggregated) amount rounded half-up, as DOUBLE."""
    return F.round(_c(x).cast(MONEY_TYPE), digits).cast("double")


def exact_ratio(num_sum: Column, den_sum: Column, digits: int = RATIO_DIGITS) -> Column:
    """``num / NULLIF(den, 0)`` on two exact sums, rounded, as DOUBLE."""
    return F.round(num_sum.cast("double") / F.nullif(den_sum.cast("double"), F.lit(0.0)), digits)


def ratio_of_sums(num, den, digits: int = RATIO_DIGITS) -> Column:
    return exact_ratio(exact_sum(num), exact_sum(den), digits)


def money_div(total, n, digits: int = MONEY_DIGITS) -> Column:
    """An exact DECIMAL amount divided by a count, rounded half-up once, as DOUBLE."""
    return F.round(_c(total).cast(MONEY_TYPE) / F.nullif(_c(n), F.lit(0)).cast("decimal(20,0)"), digits).cast("double")


def exact_avg(x, digits: int = MONEY_DIGITS) -> Column:
    """Mean as exact sum / count, rounded half-up once (NULL for no non-null values)."""
    return money_div(exact_sum(x), F.count(_c(x)), digits)


def rate(flag, digits: int = RATIO_DIGITS) -> Column:
    """Mean of a 0/1 flag, rounded."""
    return F.round(F.avg(_c(flag).cast("double")), digits)


# ---------------------------------------------------------------- the same in DuckDB SQL
def sql_exact_sum(x: str) -> str:
    return f"sum(CAST({x} AS DECIMAL(24,6)))"


def sql_money_sum(x: str, digits: int = MONEY_DIGITS) -> str:
    return f"CAST(round({sql_exact_sum(x)}, {digits}) AS DOUBLE)"


def sql_money(x: str, digits: int = MONEY_DIGITS) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(24,6)), {digits}) AS DOUBLE)"


def sql_ratio_of_sums(num: str, den: str, digits: int = RATIO_DIGITS) -> str:
    return (f"round(CAST({sql_exact_sum(num)} AS DOUBLE) / "
            f"nullif(CAST({sql_exact_sum(den)} AS DOUBLE), 0.0), {digits})")


def sql_money_div(total: str, n: str, digits: int = MONEY_DIGITS) -> str:
    """Half-up rounding of total/n in integer arithmetic (DuckDB divides decimals in DOUBLE)."""
    s = f"CAST(CAST({total} AS DECIMAL(38,6)) * 1000000 AS HUGEINT)"
    unit = 10 ** (6 - digits)
    c = f"CAST(nullif({n}, 0) AS HUGEINT)"
    q = (f"(CASE WHEN {s} >= 0 THEN (2 * {s} + {c} * {unit}) // (2 * {c} * {unit}) "
         f"ELSE -((-2 * {s} + {c} * {unit}) // (2 * {c} * {unit})) END)")
    return f"(CAST({q} AS DOUBLE) / {10 ** digits}.0)"


def sql_exact_avg(x: str, digits: int = MONEY_DIGITS) -> str:
    return sql_money_div(sql_exact_sum(x), f"count({x})", digits)


def sql_rate(flag: str, digits: int = RATIO_DIGITS) -> str:
    return f"round(avg(CAST({flag} AS DOUBLE)), {digits})"
