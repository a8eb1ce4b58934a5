"""Parquet scans of the input tables.

Every read names only the columns the caller needs, so the scan's
``ReadSchema`` is pruned even before Catalyst's own column pruning runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan ``name`` under ``sf_dir``; restrict to ``columns`` when given."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(path(sf_dir, name))
    return df.select(*columns) if columns else df
