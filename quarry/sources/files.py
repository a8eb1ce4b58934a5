"""File sources and sinks.

Readers take an explicit schema (``inferSchema`` is an opt-in: it costs an
extra pass over the data). Writers are plain DataFrameWriter calls; tables
meant to be joined repeatedly on one key can be written bucketed so later
joins on that key need no shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.session import ensure_checkpoint_dir

#: Removes the shuffle files of a query when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# ------------------------------------------------------------------ A1, A3
def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True,
             infer: bool = False) -> DataFrame:
    """A1: CSV with a header; an explicit schema, or inferred types when ``infer``."""
    r = spark.read.option("header", header)
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True)
    return r.csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, multiline: bool = True) -> DataFrame:
    """A3: JSON documents (one per file when ``multiline``)."""
    r = spark.read.option("multiLine", multiline)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


# ------------------------------------------------------------------ A2, A6
def register(df: DataFrame, name: str) -> DataFrame:
    """Expose a frame (or a stored query) to SQL as a temp view."""
    df.createOrReplaceTempView(name)
    return df


# ------------------------------------------------------------------ A4
def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, path: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """A4: ``CREATE OR REPLACE TABLE t AS SELECT ...`` - write Parquet (overwrite) and read it back.

    Reading the written files cuts the lineage: later stages restart from
    the table, not from the original plan, also after executor loss. So the
    shuffle files behind the table are of no more use, and Spark removes them
    when the write ends.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "table")
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)  # the schema is known: no job reads footers for it


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table written by :func:`materialize` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, sort: bool = True) -> None:
    """Persist a fact table bucketed (and sorted) by its join key for shuffle-free joins."""
    w = df.write.mode("overwrite").bucketBy(buckets, key)
    if sort:
        w = w.sortBy(key)
    w.saveAsTable(table)


# ------------------------------------------------------------------ A5
def typed_table(df: DataFrame, schema: StructType) -> DataFrame:
    """A5: project to a declared schema (drop-and-recreate + INSERT ... SELECT)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


# ------------------------------------------------------------------ A7, A8, A10
def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A7 (overwrite) / A8 (``mode='append'``): CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A10: JSON lines."""
    df.write.mode(mode).json(path)


def to_json_row(df: DataFrame, name: str = "json") -> DataFrame:
    """A10: each row as one JSON text (``to_json(struct(*))``)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


# ------------------------------------------------------------------ A11
def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """``INSERT INTO ... VALUES`` rows as a small DataFrame (union it with ``unionByName``)."""
    return spark.createDataFrame(list(rows), schema)
