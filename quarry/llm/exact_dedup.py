"""Exact de-duplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Equal texts (after :func:`normalised`) are combined in three stages, each of
    which compares whole texts, because the text itself is a grouping key beside
    its digest: (1) each task reduces its own rows (the partial aggregate),
    (2) the reduced rows of a (digest, salt) meet, so a text that a third of all
    rows share is spread over ``salts`` tasks, (3) at most ``salts`` winners of a
    text meet. The rows learn their winner by digest, a second hash and the
    length; should two different texts ever agree in all three, the job fails
    instead of merging them.

    Null and empty texts are one group. Rows without an id stay behind rows with
    one; a group whose ids are all null has a null ``keep_id`` and keeps its
    rows. Repeated rows with the same id and text all count in ``group_size`` and
    share ``kept``. Other columns of ``docs`` play no part. An empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")) \
        .select("id", "norm", F.sha2("norm", 256).alias("sha"))
    salted = rows.groupBy("sha", "norm", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")) \
        .agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("sha", "norm").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    identity = ["sha", "check", "chars"]
    check, chars = F.xxhash64("norm").alias("check"), F.length("norm").alias("chars")
    clash = F.raise_error(F.lit("two different texts share digest, hash and length")).cast("bigint")
    groups = winners.select("sha", check, chars, "low", "n").groupBy(*identity) \
        .agg(F.min("low").alias("keep_id"), F.min("n").alias("n"), F.count(F.lit(1)).alias("texts")) \
        .select(*identity, "keep_id", F.when(F.col("texts") == 1, F.col("n")).otherwise(clash).alias("group_size"))
    return rows.select("id", "sha", check, chars).join(groups, identity) \
        .select(F.col("id").alias(id_col), "keep_id", "group_size",
                F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the row with the smallest id.

    Rows are told apart by id and text, so an id with several texts keeps those that stay;
    of rows with the same id and text one stays, the one whose columns hash lowest.
    """
    keep = exact_duplicates(docs, id_col, text_col, salts).where("kept").select(F.col(id_col).alias("__keep"), F.col("text_sha256").alias("__sha")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("__id"), F.sha2(normalised(F.col(text_col)), 256).alias("__digest"),
                       F.xxhash64(*docs.columns).alias("__hash"))
    stay = rows.join(keep, rows["__id"].eqNullSafe(keep["__keep"]) & (F.col("__digest") == F.col("__sha")), "left_semi")
    return stay.groupBy("__id", "__digest").agg(F.min_by("row", "__hash").alias("row")).select("row.*")
