"""URL filters: given rules first, then association rules mined by FP-growth.

A url becomes a set of tokens: scheme, host labels and endings, path segments,
query keys. FP-growth finds the token combinations that are frequent among the
urls labelled bad; how often a combination is bad among all labelled urls is its
confidence, and combinations below ``min_confidence`` are dropped, as are those
with a part that is at least as sure. Rules stand in an inverted index under
their rarest token: a url's token set meets only the rules of its own tokens, and
matches those whose tokens it holds entirely. Equal token sets are matched once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.files import literal_rows, materialize

#: Share of the bad urls that hold a combination, and the share of bad urls among those that hold it.
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url, sorted; runs of digits count as one sign, so numbered pages share their tokens."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    endings = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(3))),
                          lambda n: F.concat(F.lit("ends:"), F.array_join(F.slice(labels, -n, n), ".")))
    plain = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1)))
    scheme = F.when(F.instr(url, "://") > 0, F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)))) \
        .otherwise(F.array().cast("array<string>"))
    mark = F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    each = F.concat(scheme, F.transform(labels, lambda x: F.concat(F.lit("label:"), x)),
                    F.when(F.size(labels) > 0, endings).otherwise(F.array().cast("array<string>")),
                    F.transform(plain, lambda x: F.concat(F.lit("segment:"), x)), keys, F.coalesce(mark, F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.coalesce(each, F.array().cast("array<string>"))))


def given_verdicts(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``pages`` (row, host, path) with ``rule`` and its ``verdict``: the longest rule of the host or a parent whose path fits."""
    spark = pages.sparkSession
    table = literal_rows(spark, [(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, v) for v, r in rules],
                         "on string, start string, rule string, verdict string")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    hits = pages.select("row", "path", F.explode(F.array_distinct(parents)).alias("on")).join(F.broadcast(table), "on") \
        .where(F.expr("startswith(path, start)"))
    longest = hits.groupBy("row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    return pages.join(longest, "row", "left").select(*pages.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def holds(sets: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``sets`` (with ``tokens``) joined with every rule (``items``) whose tokens it holds, by the rule's rarest token."""
    spread = rules.select("*", F.explode("items").alias("token")).join(counts, "token", "left")
    index = spread.groupBy("items").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = rules.join(index, "items")
    return sets.withColumn("token", F.explode("tokens")).join(index, "token") \
        .where(F.size(F.array_except("items", "tokens")) == 0).drop("token")


def without_implied(items: Column) -> Column:
    """Whether no ending among ``items`` implies another one: with a label or a shorter ending of it, a combination is as sure as without."""
    ends = F.transform(F.filter(items, lambda x: x.startswith("ends:")), lambda x: F.substring(x, 6, 1 << 30))
    labels = F.transform(F.flatten(F.transform(ends, lambda x: F.split(x, r"\."))), lambda x: F.concat(F.lit("label:"), x))
    shorter = F.exists(ends, lambda x: F.exists(ends, lambda y: y.endswith(F.concat(F.lit("."), x))))
    return ~F.arrays_overlap(items, labels) & ~shorter


def mined_rules(sets: DataFrame, min_support: float, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Rules (items, support, confidence) from labelled token sets (tokens, bad, n), and the tokens' counts."""
    full = materialize(sets.where(F.size("tokens") > 0))
    counts = materialize(full.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n")))
    bad = full.where("bad > 0").select(F.explode(F.expr("array_repeat(tokens, CAST(bad AS INT))")).alias("items"))
    bad = bad.repartition(int(bad.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(bad)
    sets_found = model.freqItemsets.where(without_implied(F.col("items"))).select(F.array_sort("items").alias("items"))
    found = materialize(sets_found)
    sure = materialize(holds(full, found, counts).groupBy("items").agg((F.sum("bad") / F.sum("n")).alias("confidence"), F.sum("bad").alias("support")))
    # A rule is spare if a part of it is at least as sure; all parts were found, so each size looks at those with one token less.
    kept, below = [], None
    for n in range(1, sure.agg(F.max(F.size("items"))).first()[0] + 1 if not sure.isEmpty() else 1):
        level = sure.where(F.size("items") == n)
        if below is None:
            level = level.withColumn("of_part", F.lit(-1.0))
        else:
            parts = level.select("items", F.explode("items").alias("x")).select("items", F.expr("array_remove(items, x)").alias("part"))
            most = parts.join(below.select(F.col("items").alias("part"), "best"), "part").groupBy("items").agg(F.max("best").alias("of_part"))
            level = level.join(most, "items", "left")
        below = materialize(level.withColumn("best", F.greatest("confidence", "of_part")))
        kept.append(below.where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.coalesce("of_part", F.lit(-1.0)))).select(*sure.columns))
    return materialize(reduce(DataFrame.unionByName, kept, sure.limit(0))), counts


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
          label_id: str = "doc_id", bad: Column | None = None, min_support: float = MIN_SUPPORT,
          min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, mined_rule, confidence.

    ``rules``: (verdict, ``host/path``). Labels to learn from are the verdicts of
    these rules and, for other pages, ``bad`` over the columns of ``labels`` (of
    several labels of an id the worst). A page without a rule is blocked if a
    mined rule matches, else allowed; ``mined_rule`` is the surest one, its tokens
    joined by blanks. Null urls and urls without ``://`` have an empty host and
    path, no tokens but those of their query, and are matched as such. Repeated
    rows and null ids get a row each; other columns play no part; without bad
    labels nothing is mined; an empty table gives an empty result.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url")) \
        .withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url")
    judged = materialize(given_verdicts(rows, rules))
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")) \
        .agg(F.max(F.coalesce(bad, F.lit(False)).cast("int")).alias("label"))
    labelled = judged.join(known, "id", "left") \
        .withColumn("label", F.when(F.col("rule").isNotNull(), (F.col("verdict") == "block").cast("int")).otherwise(F.col("label")))
    sets = materialize(labelled.where("label IS NOT NULL").groupBy("tokens").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")))
    if sets.where("bad > 0 AND size(tokens) > 0").isEmpty():
        best = judged.select("tokens", F.lit("").alias("mined_rule"), F.lit(0.0).alias("confidence")).limit(0)
    else:
        mined, counts = mined_rules(sets, min_support, min_confidence)
        matched = holds(judged.select("tokens").distinct(), mined, counts)
        best = matched.groupBy("tokens").agg(F.max(F.struct("confidence", "support", F.array_join("items", " ").alias("rule"))).alias("b")) \
            .select("tokens", F.col("b.rule").alias("mined_rule"), F.col("b.confidence").alias("confidence"))
    out = judged.join(best, "tokens", "left")
    verdict = F.coalesce("verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "mined_rule", "confidence")
