"""Spelling variants by blocked Gram matrices of letter counts.

Words one edit apart have letter counts whose squared distance is 1 (a letter more)
or 2 (a letter replaced). Words are dealt into blocks of equal length and equal
letter-group counts: the alphabet is cut into a few groups, and a word's signature
holds how many letters it has of each. One edit changes the signature by one letter
of a group, or by one letter less here and one more there, so near words meet under
the signature without the edited letter:

* a block under its own signature meets itself (replacement inside a group) and the
  blocks that have one letter more (insertion), and
* blocks that have one letter more, of different groups, meet each other.

Two blocks that meet are compared by one NumPy product of their letter counts; the
pairs at squared distance 1 (adjacent lengths) or 2 (equal lengths) are verified
letter by letter. The number of groups grows with the vocabulary, so blocks stay
small; a block beyond ``CHUNK`` words is cut into chunks that meet pair by pair in
rows of their own. All comparisons are exact, nothing is capped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.files import drop_table, materialize, scratch_path

#: Words of a chunk, on average; words that the most frequent signature should hold.
CHUNK, CROWD = 1024, 2000
#: Letters are Latin-1 characters, so a word is one byte a letter inside the tasks.
LETTERS = r"A-Za-zÀ-ÿ"


def lowered(word: Column) -> Column:
    """A-Z lower-cased, all other letters as they are."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6) -> DataFrame:
    """(doc_id, word) of every maximal run of at least ``least`` letters of the whole texts, A-Z lower-cased; null: no runs."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("word")).withColumn("word", lowered(F.col("word")))


def frequent_words(words: DataFrame, least: int = 5) -> DataFrame:
    """(word, n) of the words that occur ``least`` times or more; counted inside the tasks first."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def groups_for(words: int, length: float) -> int:
    """Letter groups, so that the most frequent signature holds about ``CROWD`` of a quarter of the words."""
    n = max(1, round(length))
    for m in range(1, 25):
        each, more = divmod(n, m)
        peak = math.lgamma(n + 1) - more * math.lgamma(each + 2) - (m - more) * math.lgamma(each + 1) - n * math.log(m)
        if words / 4 * math.exp(peak) <= CROWD:
            return m
    return 24


def letter_groups(words: DataFrame, m: int) -> np.ndarray:
    """Group of each Latin-1 character; letters are dealt by frequency so that the groups are about even."""
    def run(batches):
        seen = np.zeros(256, np.int64)
        for batch in batches:
            raw = np.frombuffer("".join(batch.column("word").to_pylist()).encode("latin-1"), np.uint8)
            seen += np.bincount(raw, minlength=256)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["letter", "n"])

    out, load = np.zeros(256, np.int64), np.zeros(m)
    counts = words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    for r in sorted(counts.collect(), key=lambda r: (-r.n, r.letter)):  # 256 rows at most
        out[r.letter] = load.argmin()
        load[out[r.letter]] += r.n
    return out


def _signatures(groups: np.ndarray, m: int):
    """(sig, word, n): the counts of the groups as big-endian 32-bit integers."""
    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            raw = groups[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
            row = np.repeat(np.arange(len(words)), [len(w) for w in words])
            raw = np.bincount(row * m + raw, minlength=len(words) * m).astype(">u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[i * 4 * m:(i + 1) * 4 * m] for i in range(len(words))], pa.binary()),
                                              batch.column("word"), batch.column("n")], names=["sig", "word", "n"])

    return run


def _meetings(m: int):
    """Each chunk under its own signature (kind 0) and under those with one letter of a group (kind 1..m) less."""
    def run(batches):
        for batch in batches:
            sigs = [np.frombuffer(s, ">u4") for s in batch.column("sig").to_pylist()]
            for kind in range(m + 1):
                some = [i for i, s in enumerate(sigs) if not kind or s[kind - 1]]
                if some:
                    step = np.eye(m, dtype=np.int64)[kind - 1] if kind else np.zeros(m, np.int64)
                    part = batch.take(pa.array(some))
                    at = [(sigs[i].astype(np.int64) - step).astype(">u4").tobytes() for i in some]
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array([kind] * len(some), pa.int32()), part.column("chunk"),
                                                      part.column("words"), part.column("ns")], names=["at", "kind", "chunk", "words", "ns"])

    return run


class Block:
    """Words of one length as letters and letter counts."""

    def __init__(self, words: str, ns: list[int]):
        n = len(ns)
        raw = np.frombuffer((words + "\n").encode("latin-1"), np.uint8).reshape(n, -1)
        self.words, self.letters, self.ns = words.split("\n"), raw[:, :-1], np.array(ns, np.int64)
        size = self.letters.shape[1]
        kind = np.float32 if size <= 2000 else np.float64  # products are exact
        flat = (np.arange(n)[:, None] * 256 + self.letters).ravel()
        self.counts = np.bincount(flat, minlength=n * 256).reshape(n, 256).astype(kind)
        self.used = np.flatnonzero(self.counts.any(0))
        self.square = (self.counts * self.counts).sum(1)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of equal length that differ in exactly one letter."""
    return (a != b).sum(1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of ``long`` that are those of ``short`` with one letter more."""
    front = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return front + back >= short.shape[1]


def near_pairs(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the words of two blocks that are one edit apart; ``b`` has the length of ``a`` or one letter more."""
    used = np.intersect1d(a.used, b.used, assume_unique=True)
    longer = b.letters.shape[1] - a.letters.shape[1]
    gram = a.counts[:, used] @ b.counts[:, used].T
    gram *= -2
    gram += a.square[:, None]
    gram += b.square[None, :]
    i, j = np.nonzero(gram == (1 if longer else 2))
    if same:
        i, j = i[i < j], j[i < j]
    ok = []
    for at in range(0, len(i), 1 << 16):
        x, y = a.letters[i[at:at + (1 << 16)]], b.letters[j[at:at + (1 << 16)]]
        ok.append(one_inserted(x, y) if longer else one_replaced(x, y))
    ok = np.concatenate(ok) if ok else np.zeros(0, bool)
    return i[ok], j[ok]


def _best(words: Block, of: np.ndarray, other: Block, near: np.ndarray):
    """Per word: how many near words, and the most frequent of them (ties: smallest; a block's words ascend)."""
    order = np.lexsort((near, -other.ns[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    best = near[first]
    return ([words.words[i] for i in of[first]], np.diff(np.r_[first, len(of)]), other.ns[best], [other.words[j] for j in best])


def _compared(batches):
    for batch in batches:
        held, rows = {}, ([], [], [], [])

        def block(side, r):
            key = (side, r["words"])
            if held.get(side, (None,))[0] != key:
                held[side] = key, Block(r["words"], r["ns"])
            return held[side][1]

        for i in range(batch.num_rows):
            get = lambda s: {c: batch.column(f"{s}_{c}")[i].as_py() for c in ("words", "ns")}  # noqa: E731, B023
            a, b = block("a", get("a")), block("b", get("b"))
            same = batch.column("same")[i].as_py()
            x, y = near_pairs(a, a if same else b, same)
            if len(x):
                for found in (_best(a, x, b, y), _best(b, y, a, x)):
                    for column, values in zip(rows, found, strict=True):
                        column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()),
                                          pa.array(rows[3], pa.string())], names=["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of the words (word, n) with a near word: their number and the most frequent (ties: smallest)."""
    total, length = words.agg(F.count(F.lit(1)), F.avg(F.char_length("word"))).first()
    m = groups_for(total, length or 1)
    signed = words.mapInArrow(_signatures(letter_groups(words, m), m), "sig binary, word string, n long")
    path = scratch_path(words.sparkSession, "signatures")
    signed = materialize(signed, path)
    crowded = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CHUNK) \
        .select("sig", F.ceil(F.col("k") / CHUNK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("word"), F.coalesce("chunks", F.lit(1)))
    held = signed.join(crowded, "sig", "left").groupBy("sig", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("x")) \
        .select("sig", "chunk", F.array_join("x.word", "\n").alias("words"), F.col("x.n").alias("ns"))
    met = materialize(held.mapInArrow(_meetings(m), "at binary, kind int, chunk long, words string, ns array<long>"))
    drop_table(words.sparkSession, path)
    side = lambda s: met.select("at", *[F.col(c).alias(f"{s}_{c}") for c in ("kind", "chunk", "words", "ns")])
    inside = (F.col("a_kind") == 0) & (F.col("b_kind") == 0) & (F.col("a_chunk") <= F.col("b_chunk"))
    across = F.col("a_kind") < F.col("b_kind")
    pairs = side("a").join(side("b"), "at").where(inside | across) \
        .select("a_words", "a_ns", "b_words", "b_ns", (inside & (F.col("a_chunk") == F.col("b_chunk"))).alias("same"))
    found = pairs.mapInArrow(_compared, "word string, n_near long, near_n long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near"))).alias("best")) \
        .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last, by doubling the steps; forms are ever more frequent, so they end."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variant_groups(words: DataFrame, factor: int = 5) -> DataFrame:
    """Per word of (word, n): ``form``, its near word of largest n if that is ``factor`` times its own or more, and the ``root`` of its forms.

    Near words differ by exactly one inserted, deleted or replaced letter; of equally
    frequent ones the smallest counts. ``n_near`` is the number of near words, ``form_n``
    the form's n. A word without such a form is its own root. Words are distinct strings
    of Latin-1 letters; rows whose word is null or empty, or whose n is null, take no part.
    Very long words are compared like any other; other columns play no part. An empty
    table gives an empty result.
    """
    words = materialize(words.where("word <> '' AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    near = materialize(near_words(words).join(words, "word").select(
        "word", "n", "n_near", *[F.when(F.col("near_n") >= factor * F.col("n"), F.col(c)).alias(a) for c, a in (("near", "form"), ("near_n", "form_n"))]))
    last = roots(near.where("form IS NOT NULL"))
    found = near.join(last, "word", "left").select("word", "form", "root", "n_near", "form_n")
    return words.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5,
                      factor: int = 5) -> DataFrame:
    """:func:`variant_groups` of the words of whole texts: runs of letters, A-Z lower-cased, of enough letters and occurrences.

    Null and empty texts hold no words; repeated rows count each time; ids may be null.
    """
    return variant_groups(frequent_words(letter_runs(docs, id_col, text_col, least_length), least_count), factor)
