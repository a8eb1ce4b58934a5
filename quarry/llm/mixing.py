"""Mixing of sources to target weights by temperature.

A source with token share s gets the weight s^a / sum(s^a). The exponent a is
bisected between 1 (shares as they are) and 0 (all sources alike) until the
weights have the wanted entropy, or until no source repeats more often than a
limit. The weights are realised by whole epochs of a source and a part of one
more, taken from a permutation of its documents: documents fall into blocks by
hash, blocks and the documents in them are ordered by hash, and the part ends
where the source's token budget is used up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.files import materialize

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents of a block on average; a block's documents meet in one task.
BLOCK = 1000
STEPS = 60


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("bigint")


def _bisect(far_enough) -> float:
    """The largest exponent, to the last bit but a few, at which ``far_enough`` holds; it does at 0 or 0 is the answer."""
    low, high = 0.0, 1.0
    if far_enough(high):
        return high
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if far_enough(mid) else (low, mid)
    return low


def exponent_for_repeats(shares: DataFrame, limit: float) -> float:
    """The largest exponent at which, with the largest share used once, no source repeats more than ``limit`` times."""
    top, low = shares.where("tokens > 0").agg(F.max("tokens"), F.min("tokens")).first()
    return 1.0 if top is None else _bisect_up(float(top) / float(low), limit)


def _bisect_up(ratio: float, limit: float) -> float:
    """The smallest exponent a in [0, 1] with ratio^(1 - a) <= limit."""
    low, high = 0.0, 1.0
    if ratio <= limit:
        return low
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if ratio ** (1 - mid) <= limit else (mid, high)
    return high


def exponent_for_entropy(shares: DataFrame, entropy: float) -> float:
    """The largest exponent at which the weights have at least ``entropy`` (nats); each step is one aggregate over the sources."""
    full = shares.where("tokens > 0")

    def enough(a: float) -> bool:
        p = F.pow(F.col("tokens").cast("double"), F.lit(a))
        z, s = full.agg(F.sum(p), F.sum(p * F.log(F.col("tokens").cast("double")))).first()
        return z is None or math.log(z) - a * s / z >= entropy

    return _bisect(enough)


def source_weights(shares: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """``shares`` with ``weight``, ``repeats``, whole ``epochs`` and the ``rest`` of tokens.

    Without a ``budget`` of tokens the budget is the one that uses the source of
    the largest share exactly once, so that no document is lost. Sources without
    tokens have no weight and are used once.
    """
    top, total = shares.agg(F.max("tokens"), F.sum(F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent))))).first()
    t = F.col("tokens").cast("double")
    if not top:
        weight, repeats = F.lit(0.0), F.lit(1.0)
    else:
        weight = F.when(F.col("tokens") > 0, F.pow(t, F.lit(exponent)) / F.lit(float(total))).otherwise(0.0)
        repeats = F.pow(F.lit(float(top)) / t, F.lit(1 - exponent)) if budget is None else weight * F.lit(float(budget)) / t
        repeats = F.when(F.col("tokens") > 0, repeats).otherwise(1.0)
    return shares.withColumn("weight", weight).withColumn("repeats", repeats) \
        .withColumn("epochs", F.floor("repeats")) \
        .withColumn("rest", F.floor((F.col("repeats") - F.col("epochs")) * t))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: float | None = 2.0,
        entropy: float | None = None, budget: float | None = None, seed: str = "mix") -> DataFrame:
    """``docs`` with ``n_tokens`` (words), ``weight`` of the source and ``copies``, how often a document is used.

    Give ``entropy`` (nats) or ``max_repeats``. A document is used ``epochs`` times,
    once more if the permutation reaches it before the source's rest of the
    budget is used up, and not at all only if a ``budget`` asks for less than a
    source has. Null sources are a source of their own; null and empty texts
    have no tokens; repeated rows count each; null ids are hashed as an empty
    string; columns of the added names are replaced. An empty table gives an empty result.
    """
    key = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.struct(*docs.drop("n_tokens", "weight", "copies").columns).alias("doc"), n_words(F.col(text_col)).alias("n_tokens"),
                       key.alias("hash"), F.coalesce(source_col, F.lit("")).alias("source"), F.col(source_col).isNull().alias("none"))
    shares = rows.groupBy("source", "none").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    shares = materialize(shares)
    exponent = exponent_for_entropy(shares, entropy) if entropy is not None else exponent_for_repeats(shares, max_repeats)
    plan = source_weights(shares, exponent, budget).select("source", "none", "weight", "epochs", "rest",
                                                           F.ceil(F.col("docs") / BLOCK).alias("blocks"))
    rows = rows.join(materialize(plan), ["source", "none"])  # written, so its size is known when the join is planned
    part = F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("block", F.shiftright(part * F.col("blocks"), 32))
    block = ["source", "none", "block"]
    totals = rows.groupBy(*block).agg(F.sum("n_tokens").alias("sum"))
    earlier = Window.partitionBy("source", "none").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*block, F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy(*block).orderBy("hash", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    used = F.col("before") + F.sum("n_tokens").over(within)
    return rows.join(totals, block).withColumn("copies", F.col("epochs") + F.when(used <= F.col("rest"), 1).otherwise(0)) \
        .select("doc.*", "n_tokens", "weight", "copies")


def realise(mixed: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` say."""
    return mixed.withColumn("copies", F.explode(F.expr("array_repeat(copies, CAST(copies AS INT))")))
