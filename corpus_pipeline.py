"""The corpus pipeline: five stages over ``documents``, each one operator of ``quarry.llm``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents``; the last one adds the token ids. :func:`run` writes each
stage as Parquet to the shared folder and reads it back for the next.

toxicity      documents with a toxicity of 0.5 or more go; all others stay as they are.
line_dedup    later copies of line runs of 50 words or more are cut; a document whose
              lines are cut without a word left goes, one that was empty before stays.
near_dedup    of documents whose 5-word shingles are linked at a similarity of 0.8, the
              smallest doc_id stays; empty texts are linked with nothing.
source_mix    documents are repeated so that the sources come nearer to each other, no
              source more than twice as often as the largest one; none is left out.
bpe           token ids of every text.

Nulls, empty tables and repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, line_dedup, mixing, near_dedup, queries
from quarry.plans.registry import register
from quarry.session import configure
from quarry.sources.files import materialize
from quarry.sources.tables import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = queries.scored_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.where("toxicity < 0.5").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs)
    gone = (F.col("n_deleted") > 0) & ~F.col("text").rlike(mixing.WORDS)
    length = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", length).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def source_mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.realise(mixing.mix(docs)).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs, queries.BPE_FILE)
    return coded.withColumn("n_tokens", F.expr("octet_length(token_ids) div 4"))


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage),
          ("source_mix", source_mix_stage), ("bpe", bpe_stage)]

#: SQL can express neither the toxicity model nor the near-duplicate components and the merges.
ORACLE_SQL = None


@register("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
