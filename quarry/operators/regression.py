"""Least squares by distributed normal equations.

All cross products of the terms, the response and the intercept are sums of ONE
aggregate over the complete rows (map-side combined; its size is the square of the
number of terms, whatever the table holds). The driver solves that small system in
exact rational arithmetic, so near-collinear terms lose nothing beyond the sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def treatment_coded(df: DataFrame, terms: Sequence[str]) -> list[tuple[str, Column]]:
    """(name, column) per coefficient: text terms become one 0/1 column per level but the first in sorted order.

    Levels are read from the data (one grouped aggregate for all text terms; a factor's
    levels are few by nature); booleans count 0/1; nulls stay null.
    """
    kinds = dict(df.dtypes)
    texts = [t for t in terms if kinds[t] == "string"]
    levels = df.agg(*[F.array_sort(F.collect_set(t)).alias(t) for t in texts]).first() if texts else {}
    out = []
    for t in terms:
        if t in texts:
            out += [(f"{t}={level}", (F.col(t) == level).cast("double")) for level in levels[t][1:]]
        else:
            out.append((t, F.col(t).cast("double")))
    return out


def t_two_sided(t: float, df: int) -> float:
    """Two-sided p-value of Student's t: the regularised incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(x, a, b):
        f = 1.0
        for m in range(300, 0, -1):
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            f = 1.0 + even / (1.0 + odd / f)
        return 1.0 / (1.0 - (a + b) * x / (a + 1) / f)

    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1.0 - front * fraction(1.0 - x, b, a) / b


def _solved(products: list[list[Fraction]], right: list[Fraction]) -> tuple[list[Fraction | None], list[Fraction | None]]:
    """Solution and diagonal of the inverse; a term that the ones before it determine gets None."""
    n = len(right)
    rows = [[*products[i], *[Fraction(int(i == j)) for j in range(n)], right[i]] for i in range(n)]
    used = []
    for k in range(n):
        pivot = rows[k][k]
        if pivot <= products[k][k] * Fraction(1, 10 ** 12):
            continue
        used.append(k)
        rows[k] = [x / pivot for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                f = rows[i][k]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[k], strict=True)]
    return [rows[k][-1] if k in used else None for k in range(n)], [rows[k][n + k] if k in used else None for k in range(n)]


def least_squares(df: DataFrame, response: str, terms: Sequence[str]) -> DataFrame:
    """Term, estimate, std_error, t_value, p_value; then n, residual degrees of freedom, sigma, r2 and adjusted r2 as rows.

    Rows with a null in any term or the response take no part. A term that earlier terms
    determine has null figures (an alias). Without a residual degree of freedom errors are null.
    """
    coded = [("(intercept)", F.lit(1.0)), *treatment_coded(df, terms)]
    kept = df.where(F.col(response).isNotNull()).dropna(subset=list(terms))
    x = kept.select(*[c.alias(f"x{i}") for i, (_, c) in enumerate(coded)], F.col(response).cast("double").alias("y"))
    p = len(coded)
    names = [f"x{i}" for i in range(p)] + ["y"]
    sums = x.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]).first()
    s = lambda i, j: Fraction(sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0)
    estimates, inverse = _solved([[s(i, j) for j in range(p)] for i in range(p)], [s(i, p) for i in range(p)])
    n, used = int(s(0, 0)), sum(e is not None for e in estimates)
    left = n - used
    rss = s(p, p) - sum((e * s(i, p) for i, e in enumerate(estimates) if e is not None), Fraction(0))
    tss = s(p, p) - s(0, p) ** 2 / n if n else Fraction(0)
    variance = float(rss / left) if left > 0 else None
    rows = []
    for (name, _), e, v in zip(coded, estimates, inverse, strict=True):
        error = math.sqrt(variance * float(v)) if e is not None and variance is not None else None
        t = float(e) / error if error else None
        rows.append((name, *[None if z is None else round(float(z), DIGITS) for z in (e, error, t, None if t is None else t_two_sided(t, left))]))
    r2 = float(1 - rss / tss) if tss else None
    adjusted = 1 - (1 - r2) * (n - 1) / left if r2 is not None and left > 0 else None
    for name, z in (("(n)", n), ("(df)", left), ("(sigma)", None if variance is None else math.sqrt(variance)), ("(r2)", r2), ("(adjusted r2)", adjusted)):
        rows.append((name, None if z is None else round(float(z), DIGITS), None, None, None))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, t_value double, p_value double")
