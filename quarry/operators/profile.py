"""Descriptive statistics, correlations and encodings.

Plan notes.
* Every multi-column statistic is ONE aggregate with one expression per
  column or column pair (partial aggregation, no per-column queries).
* Pearson correlation is ``covar_pop / (stddev_pop * stddev_pop)`` with each
  side masked to the rows where the other side is present (pairwise complete,
  as pandas) and ``try_divide`` so a constant column gives NULL instead of an
  ANSI divide-by-zero (pitfalls P3).
* Category codes are dense ranks over the DISTINCT values, numbered by one
  range-partitioned sort of (column, value) and joined back; no column and no
  common prefix is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.prefix import keyed_running, range_numbered

DIGITS = 6


def _r(c):
    return F.round(c, DIGITS)


def quantiles(df: DataFrame, columns: Sequence[str], q: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles (as pandas and ``quantile_cont``) of many columns: (column_name, q0, q1, ...).

    Distributed selection: all columns' values are counted by (column, value) with map-side
    partial counts, one segmented scan in (column, value) order gives the counts up to each
    value, and per quantile the two values around its rank are picked by a grouped
    aggregate. No column's values meet in one task. Nulls take no part.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns]))
    counts = df.select(cells.alias("c")).select("c.*").where("v IS NOT NULL").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = keyed_running(counts, ["column_name"], ["v"], {"upto": F.col("n")})
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    ranked = upto.join(F.broadcast(totals), "column_name")  # one row a column
    picks = []
    for i, share in enumerate(q):
        at = (F.col("total") - 1) * F.lit(float(share))
        for name, rank in ((f"lo{i}", F.floor(at)), (f"hi{i}", F.ceil(at))):
            picks.append(F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v"))).alias(name))
        picks.append(F.max(at - F.floor(at)).alias(f"part{i}"))
    found = ranked.groupBy("column_name").agg(*picks)
    return found.select("column_name", *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}")).alias(f"q{i}") for i in range(len(q))])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles, max per numeric column; a column without values has nulls."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    one = x.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"), _r(F.col(f"m{i}")).alias("mean"),
                     _r(F.col(f"s{i}")).alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")) for i, c in enumerate(columns)]
    moments = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    quartiles = quantiles(x, columns, [0.25, 0.5, 0.75])
    return moments.join(quartiles, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", _r("q0").alias("p25"), _r("q1").alias("p50"), _r("q2").alias("p75"), "max")


def null_counts(df: DataFrame) -> DataFrame:
    """NULL count per column in one pass, sorted descending."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column_name", "null_count").orderBy(F.desc("null_count"), "column_name")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlation of numeric columns as (x, y, corr) rows, self-pairs included.

    One aggregate over the upper triangle (the matrix is symmetric); the
    diagonal is 1 for a non-constant column and NULL for a constant one. The
    aggregation buffer is wide (a few fields per pair), so the session raises
    ``spark.sql.codegen.maxFields`` to keep it in whole-stage codegen.
    """
    cols = list(columns)
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    aggs = [F.stddev_pop(F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]
    upper = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    for i, j in upper:
        a, b = cols[i], cols[j]
        xa = F.when(F.col(b).isNotNull(), F.col(a))
        xb = F.when(F.col(a).isNotNull(), F.col(b))
        aggs.append(F.try_divide(F.covar_pop(xa, xb), F.stddev_pop(xa) * F.stddev_pop(xb)).alias(f"c{i}_{j}"))
    one = x.agg(*aggs)

    def cell(i, j):
        if i == j:
            return F.when(F.col(f"s{i}") > 0, F.lit(1.0))
        lo, hi = min(i, j), max(i, j)
        return _r(F.col(f"c{lo}_{hi}"))

    rows = [F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y"), cell(i, j).alias("corr"))
            for i in range(len(cols)) for j in range(len(cols))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def strong_pairs(corr: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs with correlation above ``threshold`` (self-pairs kept), strongest first."""
    return corr.where(F.col("corr") > threshold).orderBy(F.desc("corr"), "x", "y")


def category_codes(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Sorted-category integer code (0-based) per column, NULL -> -1, like pandas ``cat.codes``.

    All columns are numbered in ONE distributed sort of the distinct (column,
    value) pairs; a column's codes start at its first number, and each column
    is then joined to its own slice of that code table.
    """
    cols = [columns] if isinstance(columns, str) else list(columns)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in cols]))
    values = df.select(pairs.alias("p")).select("p.col", "p.v").where(F.col("v").isNotNull()).distinct()
    numbered = range_numbered(values, ["col", "v"], "at")
    starts = numbered.groupBy("col").agg(F.min("at").alias("start"))
    codes = numbered.join(starts, "col").select("col", "v", (F.col("at") - F.col("start")).alias("code"))
    out = df
    for c in cols:
        cc = codes.where(F.col("col") == c).select(F.col("v").alias(f"__v_{c}"),
                                                   F.col("code").cast("int").alias(f"__code_{c}"))
        out = out.join(cc, F.col(c).cast("string") == F.col(f"__v_{c}"), "left") \
            .withColumn(c, F.coalesce(F.col(f"__code_{c}"), F.lit(-1))).drop(f"__v_{c}", f"__code_{c}")
    return out


def value_shares(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """``value_counts(normalize=True) * 100`` globally or within ``by``."""
    keys = [by, column] if by else [column]
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if by:
        t = df.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__total"))
        c = c.join(t, F.col(by).eqNullSafe(F.col("__by"))).withColumn("__total", F.col("__total").cast("double"))
    else:
        c = c.withColumn("__total", df.agg(F.count(F.lit(1)).cast("double")).scalar())
    return c.select(*keys, "n", _r(F.col("n") * 100.0 / F.col("__total")).alias("pct")).orderBy(*keys)


def conditional_rates(df: DataFrame, features: Sequence[str], label: str, positive) -> DataFrame:
    """Share of ``label == positive`` for every value of every feature, one pass after unpivot."""
    long = df.select(F.col(label), *[F.col(f).cast("string").alias(f) for f in features]) \
        .unpivot([label], list(features), "feature", "value")
    return long.groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg((F.col(label) == F.lit(positive)).cast("double")) * 100).alias("win_pct")
    ).orderBy("feature", "value")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b) pairs in long form."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).orderBy(a, b)


# ------------------------------------------------------------------ G8, G9
CHAMPION_SCHEMA = "struct<data: map<string, struct<id: int, name: string>>>"


def merge_maps_last_wins(left, right):
    """G8 within one row: ``{**left, **right}`` (needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``)."""
    return F.map_concat(left, right)


def champion_list(docs: DataFrame, json_col: str = "json", priority_col: str = "priority") -> DataFrame:
    """G8 + G9 across rows: parse ``{"data": {key: {id, name}}}`` documents, later documents win per key,
    then distinct (id, name) with id > 0."""
    parsed = docs.select(F.col(priority_col), F.from_json(F.col(json_col), CHAMPION_SCHEMA).alias("d"))
    entries = parsed.select(priority_col, F.explode("d.data").alias("key", "v"))
    merged = entries.groupBy("key").agg(F.max_by("v", priority_col).alias("v"))
    return merged.select(F.col("v.id").alias("id"), F.col("v.name").alias("name")).distinct() \
        .where(F.col("id") > 0).orderBy("id", "name")
