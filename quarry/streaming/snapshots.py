"""Snapshot ingest and price alerts as Structured Streaming.

The reference polls a page once a day, appends (title, price, date) to a CSV
and mails an alert when the price drops below a threshold. Here new page
files arriving in a folder are the stream: the same A9 extraction runs per
micro-batch; ``run_with_alerts`` writes snapshots and alerts of a batch to two
sinks under the batch's id, so a repeated batch replaces itself. ``trigger(availableNow=True)`` processes what is
there and stops, so a daily scheduler replaces the polling loop; the
checkpoint makes reruns skip files already ingested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.sources.pages import DOLLAR_AMOUNT, DOCUMENT_TITLE, PRICE_SPAN, PRODUCT_TITLE, extract_fields

PAGE_SCHEMA = StructType([StructField("page_id", LongType()), StructField("url", StringType()),
                          StructField("html", StringType())])


def page_stream(spark: SparkSession, source_dir: str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """New Parquet page files under ``source_dir`` as a stream (optionally only names matching ``glob``)."""
    r = spark.readStream.schema(PAGE_SCHEMA)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(source_dir)


def snapshots(pages: DataFrame, snapshot_date: str, title_pattern: str = DOCUMENT_TITLE,
              price_pattern: str = DOLLAR_AMOUNT) -> DataFrame:
    """N1 transformation (identical for batch and stream)."""
    return extract_fields(pages, snapshot_date, title_pattern, price_pattern)


def price_alerts(snaps: DataFrame, threshold: float) -> DataFrame:
    """Snapshot rows whose price is below ``threshold`` (numeric comparison, Q11)."""
    return snaps.where(F.col("price") < F.lit(threshold))


def write_batch(snaps: DataFrame, batch_id: int, snapshot_dir: str, alert_dir: str, threshold: float) -> None:
    """One micro-batch into both sinks, each under its batch id.

    The batch is extracted once, into the snapshot sink; the alerts are read from what was
    written there. A batch that runs again after a failure overwrites its own folders, so
    both sinks hold every row once.
    """
    at = f"{snapshot_dir}/batch={batch_id}"
    snaps.write.mode("overwrite").parquet(at)
    written = snaps.sparkSession.read.schema(snaps.schema).parquet(at)
    price_alerts(written, threshold).write.mode("overwrite").parquet(f"{alert_dir}/batch={batch_id}")


def run_with_alerts(pages: DataFrame, snapshot_date: str, snapshot_dir: str, alert_dir: str, checkpoint_dir: str, threshold: float,
                    title_pattern: str = PRODUCT_TITLE, price_pattern: str = PRICE_SPAN) -> StructType:
    """N1 + N2 from one stream: every new page becomes a snapshot row, those below ``threshold`` an alert; returns the rows' schema."""
    snaps = snapshots(pages, snapshot_date, title_pattern, price_pattern)
    q = (snaps.writeStream.foreachBatch(lambda batch, i: write_batch(batch, i, snapshot_dir, alert_dir, threshold))
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return snaps.schema


def read_sink(spark: SparkSession, sink_dir: str, schema: StructType) -> DataFrame:
    """All batches of a sink, without their ids."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(sink_dir).drop("batch")


def run_available(df: DataFrame, sink_dir: str, checkpoint_dir: str) -> None:
    """Append ``df`` (a streaming frame) to a Parquet sink, processing everything available, then stop."""
    q = (df.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True)
         .start(sink_dir))
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
