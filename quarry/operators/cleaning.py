"""Data cleaning of a sales table.

The reference mutates a SQL Server table step by step (ALTER/UPDATE/DELETE).
Here each step is a DataFrame-to-DataFrame function; ``clean_sales`` chains
them in the reference's order.

Plan notes.
* ``fill_from_peer`` replaces the self-join ``a.key = b.key AND a.id <> b.id``
  (quadratic in the size of a key's group) by a grouped ``min_by`` - one
  partial aggregate - and one equi-join back on the key; AQE splits a hot key
  on the big side of that join.
* ``drop_duplicate_rows`` keeps the lowest id per business key with a grouped
  ``min_by`` over the whole row instead of ``row_number`` in a window, so a
  heavily duplicated key is combined map-side rather than sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.prefix import bounded

# Recode of the vacancy flag.
VACANT_RECODE = {"Y": "Yes", "N": "No"}
DEDUP_KEYS = ("ParcelID", "PropertyAddress", "SalePrice", "SaleDate", "LegalReference")
UNUSED_COLUMNS = ("OwnerAddress", "TaxDistrict", "PropertyAddress", "SaleDate")


def standardize_date(df: DataFrame, col: str = "SaleDate", out: str = "SaleDateConverted") -> DataFrame:
    """I-DC1: ``CONVERT(Date, col)`` as a new column."""
    return df.withColumn(out, F.to_date(col))


def fill_from_peer(df: DataFrame, key: str, col: str, order: str) -> DataFrame:
    """I-DC2: fill NULL ``col`` from another row with the same ``key`` (lowest ``order`` that has a value).

    The rows are dealt by the key to as many partitions as their number needs: the sorts
    behind the join and behind a later grouping by the key hold one partition each.
    """
    donors = (df.where(F.col(col).isNotNull())
              .groupBy(key).agg(F.min_by(col, order).alias("__peer_value")))
    rows = df.count()
    return (bounded(df, rows, key).join(bounded(donors, rows, key), key, "left")
            .withColumn(col, F.coalesce(F.col(col), F.col("__peer_value")))
            .drop("__peer_value")
            .select(*df.columns))


def split_first(x: Column | str, delimiter: str = ",") -> tuple[Column, Column]:
    """``SUBSTRING(x, 1, CHARINDEX(d, x) - 1)`` and ``SUBSTRING(x, CHARINDEX(d, x) + 1, LEN(x))``.

    Without a delimiter the first part is the whole text (T-SQL would raise)
    and the second is the whole text, as ``CHARINDEX`` returns 0 there.
    No trimming: the reference keeps the blank after the comma.
    """
    s = F.col(x) if isinstance(x, str) else x
    pos = F.instr(s, delimiter)
    first = F.when(pos > 0, F.substring_index(s, delimiter, 1)).otherwise(s)
    rest = F.when(pos > 0, F.substr(s, pos + F.lit(len(delimiter)))).otherwise(s)
    return first, rest


def parse_name(x: Column | str, part: int, delimiter: str = ",") -> Column:
    """``PARSENAME(REPLACE(x, d, '.'), part)``: part counted from the right; NULL if absent, empty or > 4 parts."""
    s = F.regexp_replace(F.col(x) if isinstance(x, str) else x, F.lit(delimiter), F.lit("."))
    n_parts = F.size(F.split(s, r"\."))
    piece = F.split_part(s, F.lit("."), F.lit(-part))
    return F.when(n_parts <= 4, F.nullif(piece, F.lit("")))


def split_addresses(df: DataFrame) -> DataFrame:
    """I-DC3: property address into (address, city), owner address into (address, city, state)."""
    addr, city = split_first("PropertyAddress")
    return df.withColumns({
        "PropertySplitAddress": addr,
        "PropertySplitCity": city,
        "OwnerSplitAddress": parse_name("OwnerAddress", 3),
        "OwnerSplitCity": parse_name("OwnerAddress", 2),
        "OwnerSplitState": parse_name("OwnerAddress", 1),
    })


def recode_vacant(df: DataFrame, col: str = "SoldAsVacant") -> DataFrame:
    """I-DC4: ``Y -> Yes``, ``N -> No``, anything else unchanged."""
    c = F.col(col)
    expr = c
    for k, v in reversed(list(VACANT_RECODE.items())):
        expr = F.when(c == k, F.lit(v)).otherwise(expr)
    return df.withColumn(col, expr)


def value_frequency(df: DataFrame, col: str) -> DataFrame:
    """I-DC4 check: distinct values and their counts, ascending by count."""
    return df.groupBy(col).agg(F.count(col).alias("n")).orderBy("n", col)


def drop_duplicate_rows(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS, order: str = "UniqueID") -> DataFrame:
    """I-DC5: keep the row with the lowest ``order`` per business key (``row_number() ... = 1``)."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others])
    kept = df.groupBy(*keys).agg(F.min_by(row, F.col(order)).alias("__row"))
    return kept.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others]).select(*df.columns)


def drop_unused(df: DataFrame, columns: Sequence[str] = UNUSED_COLUMNS) -> DataFrame:
    """I-DC6: drop columns no longer needed (B2)."""
    return df.drop(*columns)


def clean_sales(df: DataFrame) -> DataFrame:
    """All steps in the reference's order."""
    x = standardize_date(df)
    x = fill_from_peer(x, "ParcelID", "PropertyAddress", "UniqueID")
    x = split_addresses(x)
    x = recode_vacant(x)
    x = drop_duplicate_rows(x)
    return drop_unused(x)
