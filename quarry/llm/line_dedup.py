"""Line de-duplication with a suffix array over line ids.

The suffixes of the corpus as sequences of lines are ranked by prefix doubling:
ranks of length 1 number the distinct lines in order, and the ranks of length
2k come from sorting the pairs (rank at i, rank at i + k). A suffix that shares its
first k lines with no other is out, because it can't begin a longer repeat. Two
suffixes share m lines exactly if their ranks of length k = 2^floor(log2 m) agree
at the first line and at line m - k, so these two ranks name the interval of the
suffix array with a longest common prefix of at least m. A run counts once it has
``min_words`` words, so ranks of more than ``min_words`` lines are never needed.

A repeated run is the union of its shortest windows of ``min_words`` words, seen
from each of its lines forwards and backwards. All windows of an interval but the
first one in order (id, line) are later copies; their lines are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.exact_dedup import SPACES
from quarry.plans.prefix import range_numbered
from quarry.sources.files import materialize

#: Words of a repeated run that is deleted.
MIN_WORDS = 50


def line_table(docs: DataFrame) -> DataFrame:
    """(key, id, seq, line, h1, h2, words) of every line with a word: ``line`` counts all lines of a text, ``seq`` these."""
    lines = F.transform(F.split("text", "\n", -1),
                        lambda x, i: F.struct(i.alias("line"), F.trim(F.regexp_replace(x, SPACES, " ")).alias("norm")))
    rows = docs.select("key", "id",
                       F.posexplode(F.filter(lines, lambda s: s["norm"] != "")).alias("seq", "s"))
    norm = F.col("s.norm")
    return rows.select("key", "id", "seq", F.col("s.line").alias("line"), F.xxhash64(norm).alias("h1"),
                       F.xxhash64(F.lit(1), norm).alias("h2"),
                       (F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).alias("words"))


def suffix_ranks(lines: DataFrame, max_lines: int) -> list[DataFrame]:
    """For k = 0, 1, ..: (key, seq, rank) of the suffixes that share their first 2^k lines with another one."""
    ids = range_numbered(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"),
                         ["h1", "h2"], "rank")
    levels = [materialize(lines.join(ids, ["h1", "h2"]).drop("h1", "h2").dropDuplicates(["key", "seq"]))]
    size = 1
    while 2 * size <= max_lines and not levels[-1].isEmpty():
        now = levels[-1].select("key", "seq", "rank")
        after = now.select("key", (F.col("seq") - size).alias("seq"), F.col("rank").alias("next"))
        both = materialize(now.join(after, ["key", "seq"]))
        pairs = range_numbered(both.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                               .select("rank", "next"), ["rank", "next"], "longer")
        levels.append(materialize(both.join(pairs, ["rank", "next"]).select("key", "seq", F.col("longer").alias("rank"))))
        size *= 2
    return levels


def windows(active: DataFrame, min_words: int) -> DataFrame:
    """(key, id, first, last): the shortest windows of ``min_words`` words over neighbouring repeated lines."""
    run = F.col("seq") - F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    rows = active.select("key", "id", "seq", "words", run.alias("run"))
    per = Window.partitionBy("key", "run")
    upto = F.sum("words").over(per.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    ahead = per.orderBy("before").rangeBetween(0, min_words - 1)
    back = per.orderBy("upto").rangeBetween(1 - min_words, 0)
    rows = rows.select("key", "id", "seq", F.max("seq").over(ahead).alias("last"),
                       (F.max("upto").over(ahead) - F.col("before") >= min_words).alias("on"),
                       F.min("seq").over(back).alias("first"),
                       (F.col("upto") - F.min("before").over(back) >= min_words).alias("off"))
    return rows.where("on").select("key", "id", F.col("seq").alias("first"), "last") \
        .unionByName(rows.where("off").select("key", "id", "first", F.col("seq").alias("last"))).distinct()


def later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, gone): the line numbers to delete from each text of ``docs`` (key, id, text)."""
    lines = materialize(line_table(docs))
    levels = suffix_ranks(lines, min_words)
    ranks = reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("k"), "key", "seq", "rank") for k, x in enumerate(levels)])
    found = windows(levels[0], min_words).withColumn("m", F.col("last") - F.col("first") + 1) \
        .withColumn("k", F.floor(F.log2("m")).cast("int"))
    shift = F.expr("last + 1 - CAST(shiftleft(1, k) AS INT)")
    named = found.join(ranks.select("k", "key", F.col("seq").alias("first"), F.col("rank").alias("r1")), ["k", "key", "first"]) \
        .withColumn("seq", shift).join(ranks.withColumnRenamed("rank", "r2"), ["k", "key", "seq"])
    named = materialize(named.select("key", "first", "last", "m", "r1", "r2",
                                     F.struct(F.col("id").isNull().alias("none"), "id", "key", "first").alias("place")))
    intervals = named.groupBy("m", "r1", "r2").agg(F.min("place").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = named.join(intervals, ["m", "r1", "r2"]).where(F.col("place") != F.col("origin"))
    gone = copies.select("key", F.explode(F.sequence("first", "last")).alias("seq")).distinct()
    return gone.join(levels[0].select("key", "seq", "line"), ["key", "seq"]).groupBy("key").agg(F.collect_list("line").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut from ``text_col``, and ``n_lines``, ``n_deleted``.

    Lines are equal when identical after trimming and joining white space (128-bit
    hashes); lines without words stand in no run and stay. Null texts stay null
    and have no lines, an empty text has one. Rows with the same id and text are
    treated as one row and get the same result; texts without an id come last in
    the order. Other columns stay, those of the added names are replaced; an empty
    table gives an empty result.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col)).alias("key")
    own = docs.select(F.struct(*docs.drop("n_lines", "n_deleted").columns).alias("doc"), key, F.col(text_col).alias("text"))
    gone = later_copies(docs.select(key, F.col(id_col).alias("id"), F.col(text_col).alias("text")), min_words)
    lines = F.split("text", "\n", -1)
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    cut = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(cut).alias(text_col)
    return own.join(gone, "key", "left").select(
        *[text if c == text_col else F.col("doc")[c].alias(c) for c in docs.drop("n_lines", "n_deleted").columns],
        count.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted"))
