"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are gathered from the training texts by Spark,
quantised on a geometric scale, and stored in a Bloom filter: an n-gram of
quantised count q is in the filter once for each level 1..q, so a reader probes
level after level until a probe fails. The filter is built in segments by the
reducers, collected by segment and broadcast; a filter beyond ``max_filter_mb``
is broadcast in several passes over the texts, each with a part of the pair
segments, so that no broadcast goes beyond the bound.

The model is a bigram model smoothed towards the word distribution:
``P(w | h) = (min(c(h w), C(h)) + mu * P(w)) / (C(h) + mu)`` with
``P(w) = (c(w) + 1) / (N + V + 1)``. ``c`` is the lower end of the quantised
count and ``C`` the upper one, so the probabilities after a word sum to at most
one but for the filter's false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import hash_words, mix, seeded, signed
from quarry.sources.files import materialize

#: Ratio of neighbouring count levels.
RATIO = 1.5
#: Bits of filter for each (n-gram, level), and probes of each.
BITS, PROBES = 10, 4
#: Pseudo-count of the word distribution after each word.
MU = 100.0
#: Words whose exact counts are broadcast; the others meet their counts in a join.
HEAD = 1 << 18
#: Tokens that a task counts before it passes on their sums.
FLUSH = 3_000_000

END, START = (int(x) for x in seeded(11, 2))
_LEVEL = seeded(12, 128)
#: Smallest count of each level.
LEVELS = np.unique(np.ceil(RATIO ** np.arange(0, 108)).astype(np.float64)).astype(np.uint64).astype(np.int64)
LEVELS = LEVELS[LEVELS > 0][:100]


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, the token before, row): the words of each text and then its end."""
    words, rows = hash_words(column)
    n = len(column)
    size = np.bincount(rows, minlength=n).astype(np.int64)
    tokens = np.empty(len(words) + n, np.uint64)
    tokens[np.arange(len(words)) + rows] = words
    ends = np.cumsum(size + 1) - 1
    tokens[ends] = np.uint64(END)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    if n:
        before[np.concatenate([[0], ends[:-1] + 1])] = np.uint64(START)
    return tokens, before, np.repeat(np.arange(n), size + 1)


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0xD6E8FEB86659FD93) + tokens)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(segments)).astype(np.int32)


def ngram_counts(texts: DataFrame, pairs: bool, segments: int) -> DataFrame:
    """(seg, key, n): the count of every word, or pair of neighbouring words, of the single column of ``texts``."""

    def run(batches):
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for i in range(0, len(keys), 200_000):
                k = keys[i:i + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment_of(k, segments)), pa.array(signed(k)), pa.array(n[i:i + 200_000].astype(np.int64))],
                    names=["seg", "key", "n"])

        for batch in batches:
            tokens, before, _ = sequences(batch.column(0))
            held.append(pair_keys(before, tokens) if pairs else tokens)
            if sum(map(len, held)) >= FLUSH:
                yield from flush()
        if held:
            yield from flush()

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.mapInArrow(run, "seg int, key long, n long").repartition(parts, "seg") \
        .groupBy("seg", "key").agg(F.sum("n").alias("n"))


def _probes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the segment (as a 32-bit fraction), and which bits of that 64-bit word."""
    x = mix(keys ^ _LEVEL[level])
    bits = np.zeros(len(x), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    return x >> np.uint64(32), bits


def filter_segments(counts: DataFrame) -> DataFrame:
    """(seg, words, filter): the log-frequency filter of each segment. A segment's rows meet in one task."""

    def run(batches):
        segs, keys, ns = [], [], []
        for b in batches:
            segs.append(b.column(0).to_numpy(zero_copy_only=False))
            keys.append(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            ns.append(b.column(2).to_numpy(zero_copy_only=False))
        if not segs:
            return
        seg, key, n = map(np.concatenate, (segs, keys, ns))
        order = np.argsort(seg, kind="stable")
        seg, key, level = seg[order], key[order], np.searchsorted(LEVELS, n[order], "right")
        edges = np.flatnonzero(np.diff(seg, prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(seg)], strict=True):
            k, q = key[lo:hi], level[lo:hi]
            size = max(1, -(-int(q.sum()) * BITS // 64))
            words = np.zeros(size, np.uint64)
            for j in range(int(q.max())):
                k, q = k[q > j], q[q > j]
                at, bits = _probes(k, j)
                np.bitwise_or.at(words, ((at * np.uint64(size)) >> np.uint64(32)).astype(np.int64), bits)
            yield pa.RecordBatch.from_arrays([pa.array([int(seg[lo])], pa.int32()), pa.array([size], pa.int64()),
                                              pa.array([words.tobytes()], pa.binary())], names=["seg", "words", "filter"])

    return counts.mapInArrow(run, "seg int, words long, filter binary")


@dataclass
class LogFilter:
    """A part of a log-frequency filter: ``size`` and ``start`` of each segment (size 0: not in this part)."""

    size: np.ndarray
    start: np.ndarray
    words: np.ndarray

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key: probes of level after level until one fails."""
        seg = segment_of(keys, len(self.size))
        out = np.zeros(len(keys), np.int64)
        at = np.flatnonzero(self.size[seg] > 0)
        j = 0
        while len(at) and j < len(LEVELS) - 1:
            spot, bits = _probes(keys[at], j)
            s = seg[at]
            word = self.words[self.start[s] + ((spot * self.size[s].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)]
            at = at[(word & bits) == bits]
            j += 1
            out[at] = j
        return out


def low(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, LEVELS[np.maximum(level, 1) - 1], 0)


def high(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, LEVELS[level] - 1, 0)


def _load(parts: DataFrame, segments: int, sizes: dict[int, int]) -> LogFilter:
    """The filter of the segments in ``sizes`` (seg -> words), read one partition at a time; the sum is within the bound."""
    size = np.zeros(segments, np.int64)
    for seg, n in sizes.items():
        size[seg] = n
    start = np.cumsum(size) - size
    words = np.zeros(int(size.sum()) + 1, np.uint64)
    if sizes:
        for r in parts.where(F.col("seg").isin(list(sizes))).select("seg", "filter").toLocalIterator():
            words[start[r[0]]:start[r[0]] + size[r[0]]] = np.frombuffer(r[1], np.uint64)
    return LogFilter(size, start, words)


def _passes(sizes: dict[int, int], bound: int) -> list[list[int]]:
    """Segments in groups of at most ``bound`` words."""
    out, total = [[]], 0
    for seg, n in sorted(sizes.items()):
        if n > bound:
            raise ValueError("one filter segment goes beyond max_filter_mb; raise it or spark.sql.shuffle.partitions")
        if total + n > bound:
            out.append([])
            total = 0
        out[-1].append(seg)
        total += n
    return out


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None,
          mu: float = MU, max_filter_mb: int = 256, head: int = HEAD) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` marks the rows to learn from (null: not). ``base_score`` is the
    exact add-one word model, ``score`` the model's log10 probability of the
    whole text and its end. Null and empty texts have one token, the end.
    Without training rows every count is 0. Rows get a number of their own, so
    repeated rows and null ids are scored one by one; other columns play no part;
    an empty table gives an empty result.

    The ``head`` most frequent words meet their exact counts by broadcast
    (16 bytes a word), the others in a join on (text, word) pairs.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    segments = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    learned = F.coalesce(train, F.lit(False))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                      (~learned if held_out is None else held_out).alias("held_out"), learned.alias("train"),
                      F.col(text_col).alias("text"))
    texts = own.where("train").select("text")
    singles = materialize(ngram_counts(texts, False, segments))
    n_train, v, n_texts = singles.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)),
                                      F.coalesce(F.max(F.when(F.col("key") == int(np.uint64(END).view(np.int64)), F.col("n"))),
                                                 F.lit(0))).first()
    top = singles.select("key", "n").orderBy(F.desc("n"), "key").limit(head).toArrow()
    common = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(common)
    common, common_n = common[order], top["n"].to_numpy()[order]
    one = materialize(filter_segments(singles.select("seg", "key", "n").repartition(segments // 4, "seg")))
    two = materialize(filter_segments(ngram_counts(texts, True, segments)))
    sizes = {r.seg: r.words for r in two.select("seg", "words").collect()}
    single_sizes = {r.seg: r.words for r in one.select("seg", "words").collect()}
    bound = max_filter_mb * (1 << 17) - sum(single_sizes.values())
    if bound <= 0:
        raise ValueError("the filter of single words goes beyond max_filter_mb")
    share = sc.broadcast((common, common_n))
    words = sc.broadcast(_load(one, segments, single_sizes))
    total = n_train + v + 1

    def with_common(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, n = share.value
        if not len(keys):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        spot = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
        known = keys[spot] == tokens
        return np.where(known, n[spot], 0), known

    def model_pass(part, first: bool):
        def run(batches):
            for batch in batches:
                tokens, before, row = sequences(batch.column("text"))
                n = batch.num_rows
                single, at = np.unique(tokens, return_inverse=True)
                level = words.value.level(single)
                p = (low(level) + 1) / total
                after = high(level).astype(np.float64)
                context = np.empty(len(tokens))
                context[1:] = after[at[:-1]]
                context[before == np.uint64(START)] = n_texts
                pair, pair_at = np.unique(pair_keys(before, tokens), return_inverse=True)
                c = low(part.value.level(pair)).astype(np.float64)[pair_at]
                logs = np.log10((np.minimum(c, context) + mu * p[at]) / (context + mu))
                logs[part.value.size[segment_of(pair, segments)][pair_at] < 0] = 0
                size = np.bincount(row, minlength=n)
                count, known = with_common(single)
                out = [np.bincount(row, weights=logs, minlength=n)]
                if first:
                    base = np.bincount(row, weights=np.where(known, np.log10(count + 1.0), 0)[at], minlength=n)
                    out += [size, np.bincount(row, weights=(known & (count > 0))[at], minlength=n).astype(np.int64), base]
                else:
                    out += [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("id"), batch.column("held_out"), pa.array(out[0]),
                     pa.array(out[1].astype(np.int64)), pa.array(out[2]), pa.array(out[3])],
                    names=["row", "id", "held_out", "score", "n_tokens", "n_known", "base"])

        kind = own.schema["id"].dataType.simpleString()
        return own.select("row", "id", "held_out", "text").mapInArrow(
            run, f"row long, id {kind}, held_out boolean, score double, n_tokens long, n_known long, base double")

    def rest(batches):
        for batch in batches:
            tokens, _, row = sequences(batch.column("text"))
            single, at = np.unique(tokens, return_inverse=True)
            _, known = with_common(single)
            rare = np.flatnonzero(~known[at])
            pairs, tf = np.unique(row[rare] * np.int64(len(single)) + at[rare], return_counts=True)
            numbers = batch.column("row").to_numpy(zero_copy_only=False)
            for i in range(0, len(pairs), 200_000):
                p = pairs[i:i + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[p // len(single)]), pa.array(signed(single[p % len(single)])),
                     pa.array(tf[i:i + 200_000].astype(np.int32))], names=["row", "key", "tf"])

    groups = _passes(sizes, bound)
    every = None
    for i, group in enumerate(groups):
        loaded = _load(two, segments, {s: sizes[s] for s in group})
        absent = np.setdiff1d(np.fromiter((s for g in groups for s in g), np.int64, len(sizes)), group)
        loaded.size[absent] = -1  # scored in another pass; a segment without any pair (size 0) in the first
        if i:
            loaded.size[np.setdiff1d(np.arange(segments), group)] = -1
        part = model_pass(sc.broadcast(loaded), i == 0)
        del loaded
        every = part if every is None else every.unionByName(part)
    if len(groups) > 1:
        every = every.groupBy("row").agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"),
                                         *[F.sum(c).alias(c) for c in ("score", "n_tokens", "n_known", "base")])
    rare = own.select("row", "text").mapInArrow(rest, "row long, key long, tf int") \
        .join(singles.select("key", "n"), "key") \
        .groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("log"))
    return every.join(rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total))).alias("base_score"), "score")
