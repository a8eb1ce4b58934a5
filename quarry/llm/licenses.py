"""License scans by diagonal voting.

Word k-grams of the texts meet the k-grams of license templates; a match at text
word p and template word q votes for the diagonal p - q. Votes on one diagonal
that lie together are one place; neighbouring diagonals merge, so an inserted or
lost word does not split a place; a place counts once enough of its template's
words are covered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.words import ALNUM_FOLD, grams, hash_words, text_bytes
from quarry.sources.files import materialize

# The phrases that the base counts, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Beginnings and notices of public licenses, lower case, words only.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "dedicated to the public domain under the creative commons cc0 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]
#: Words of a k-gram of a template; a shorter phrase is one k-gram of its own length.
GRAM = 3
#: Diagonals that differ by at most this much merge.
DRIFT = 3
#: Part of a template's words that a place must cover.
COVER = 0.75


def template_table(templates=None, phrases=None) -> list[tuple]:
    """(template, label, phrase?, words, k, position, gram) of every template k-gram."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    rows = []
    listed = [(label, text, False) for label, text in templates] + [(label, text, True) for text, label in phrases.items()]
    for t, (label, text, phrase) in enumerate(listed):
        words = text.split()
        k = len(words) if phrase else min(GRAM, len(words))
        rows += [(t, label, phrase, len(words), k, i, " ".join(words[i:i + k])) for i in range(len(words) - k + 1)]
    return rows


def gram_hits(docs: DataFrame, text_col: str, rows: list[tuple]) -> DataFrame:
    """``docs`` with ``n_words`` and ``hits``: the places (word, k, gram) of k-grams that a template has.

    The k-grams of all words are hashed; the words of a hit are written out, so
    the join with the templates verifies the words themselves.
    """
    wanted: dict[int, np.ndarray] = {}
    for k in sorted({r[4] for r in rows}):
        texts = pa.array(sorted({r[6] for r in rows if r[4] == k}))
        h, at = hash_words(texts, ALNUM_FOLD)
        wanted[k] = np.sort(grams(h, at, k)[0])

    hit = "array<struct<word: bigint, k: int, gram: string>>"

    def run(batches):
        for batch in batches:
            column = batch.column(text_col)
            h, at = hash_words(column, ALNUM_FOLD)
            first = np.searchsorted(at, np.arange(len(column) + 1))
            found: dict[int, list] = {}
            for k, keys in wanted.items():
                g, start = grams(h, at, k)
                spot = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                for i in start[keys[spot] == g].tolist():
                    found.setdefault(int(at[i]), []).append((i - int(first[at[i]]), k))
            hits = [[] for _ in range(len(column))]
            for row, places in found.items():
                words = split_words(column[row].as_py())
                hits[row] = [{"word": p, "k": k, "gram": " ".join(words[p:p + k])} for p, k in places]
            names = [c for c in batch.schema.names if c != text_col]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(np.diff(first), pa.int64()),
                 pa.array(hits, pa.list_(pa.struct([("word", pa.int64()), ("k", pa.int32()), ("gram", pa.string())])))],
                names=[*names, "n_words", "hits"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col]
    return docs.mapInArrow(run, ", ".join([*kept, "n_words bigint", f"hits {hit}"]))


def split_words(text: str) -> list[str]:
    """The words of one text, as the hashes see them."""
    raw, _ = text_bytes(pa.array([text]))
    folded = ALNUM_FOLD[raw]
    folded[folded == 0] = 32
    return [w for w in folded.tobytes().decode("utf-8").split(" ") if w]


def license_spans(hits: DataFrame, rows: list[tuple], key: str, cover: float = COVER) -> DataFrame:
    """(key, template, label, phrase, first_word, last_word, votes, coverage) of every verified place.

    ``hits``: ``key`` and the ``hits`` of :func:`gram_hits`. Groups never go
    beyond one document and template.
    """
    spark = hits.sparkSession
    templates = spark.createDataFrame(rows, "template int, label string, phrase boolean, words int, k int, spot int, gram string")
    places = hits.select(key, F.explode("hits").alias("h")).select(key, "h.*")
    votes = places.join(F.broadcast(templates), ["k", "gram"]) \
        .withColumn("diagonal", F.col("word") - F.col("spot"))
    # Phrases are single k-grams: each vote is a place.
    whole = votes.where("phrase").select(key, "template", "label", "phrase", F.col("word").alias("first_word"),
                                         (F.col("word") + F.col("k") - 1).alias("last_word"),
                                         F.lit(1).cast("bigint").alias("votes"), F.lit(1.0).alias("coverage"))
    # One template can stand in a text many times: runs of votes on a diagonal, then neighbouring diagonals.
    per = [key, "template"]
    lines = votes.where("NOT phrase").groupBy(*per, "label", "phrase", "words", "diagonal") \
        .agg(F.count(F.lit(1)).alias("votes"), F.collect_set(F.struct("spot", "k")).alias("spots"))
    order = Window.partitionBy(*per).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    merged = lines.withColumn("new", F.when(gap <= DRIFT, 0).otherwise(1)) \
        .withColumn("place", F.sum("new").over(order)) \
        .groupBy(*per, "label", "phrase", "words", "place") \
        .agg(F.sum("votes").alias("votes"), F.flatten(F.collect_list("spots")).alias("spots"),
             F.min("diagonal").alias("diagonal"), F.max("diagonal").alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s["spot"], s["spot"] + s["k"] - 1)))))
    spots = F.transform("spots", lambda s: s["spot"])
    ends = F.transform("spots", lambda s: s["spot"] + s["k"] - 1)
    long = merged.withColumn("coverage", covered / F.col("words")).where(F.col("coverage") >= cover) \
        .select(*per, "label", "phrase", (F.col("diagonal") + F.array_min(spots)).alias("first_word"),
                (F.col("last") + F.array_max(ends)).alias("last_word"), "votes", "coverage")
    return whole.select(long.columns).unionByName(long)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_places.

    ``n_base`` counts the places of :data:`PHRASES`, ``first_word`` and
    ``last_word`` are their smallest and largest start (null without any),
    ``labels`` adds those of the templates, ``score`` is the largest part of a
    template that a verified place covers (1 for a phrase, 0 without a place).
    Null and empty texts have no words and empty labels. Rows are told apart by
    a number of their own, so repeated rows and null ids get a row each; other
    columns play no part; an empty table gives an empty result.
    """
    rows = template_table()
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = materialize(gram_hits(own, "text", rows))
    spans = license_spans(hits.where(F.size("hits") > 0), rows, "row", cover)
    base = F.col("phrase")
    found = spans.groupBy("row").agg(
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"), F.count(F.lit(1)).alias("n_places"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"))
    return hits.select("row", "id", "n_words").join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_places", F.lit(0)).cast("bigint").alias("n_places"))
