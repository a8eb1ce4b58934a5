"""Toxicity scores after noisy-channel deobfuscation.

Learning: words and word beginnings of all labelled training texts are
counted by label, near copies once; those that stand almost only in toxic texts
and there often enough, and shorter beginnings before longer ones, make the
lexicon. Scoring: words of the lexicon are searched in the text, and tokens that look
disguised (digits or signs between letters, letters written apart, a letter three
times running) are restored first: a lattice of the letters that each character
may stand for, and of the signs at which a word may end, is decoded by Viterbi under
a character trigram model, and each restored word is looked up. The score is one minus the product of (1 - precision)
over the distinct entries found, or the rate of toxic texts without any.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.bpe import df_broadcast
from quarry.llm.words import grams, hash_words, mix, signed
from quarry.sources.files import materialize

#: Entries that a task counts before it hands its counts on.
MOST_COUNTED = 400_000
#: Bits of the mask that keeps texts without a label out of the shuffle by id.
MASK = 1 << 25
#: Toxic texts that hold an entry, and the share of toxic ones among its texts, at least.
SUPPORT, PRECISION = 5, 0.97
#: Lengths of word beginnings that can be entries.
STEMS = (4, 5, 6, 7, 8)

# Letters that a character is commonly written for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "ß": "ßb"}
# Signs that are put between letters.
BETWEEN = set(" .-_*~^'`,:;/\\#%&=)\"<>")
SUBSTITUTE, SKIP, REPEAT, MISREAD = 1.5, 0.7, 0.7, 12.0

_LETTERS = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\W\d_][0-9@$!|+€£(¡*~^_.\-'`]+[^\W\d_]|[0-9@$!|+€£(¡]+[^\W\d_]|[^\W\d_][0-9@$|+€£]|([^\W\d_])\1\1")
# Signs around a word that take no part in a match of ``_ODD``.
_BEFORE, _AFTER = ".,;:?-'\"`*~^_)[]{}<>%&=#/\\", ".,;:?!-'\"`*~^_()[]{}<>%&=#/\\"
_TWICE = re.compile(r"(.)\1+")
_SIGNS = r"[\s" + re.escape("".join(sorted(BETWEEN))) + "]"
_APART = re.compile(rf"(?<![^\W_])(?:(?:[^\W_]|[@$!|+€£(¡]){_SIGNS}{{1,3}}){{2,}}(?:[^\W_]|[@$!|+€£(¡])(?![^\W_])")
_INNER = re.compile(_SIGNS + "+")
_GAP = re.compile(r"\s{2,}")


def words(text: str) -> list[str]:
    return _LETTERS.findall(text)


@lru_cache(100_000)
def entries(word: str) -> tuple[str, ...]:
    """What a word can match: itself (marked by a final blank) and its beginnings."""
    return (word + " ", *[word[:n] for n in STEMS if len(word) >= n])


def _thrice(text: str) -> bool:
    """Whether a letter or digit stands three times running."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((a[2:] == a[1:-1]) & (a[1:-1] == a[:-2]))
    return any(chr(x).isalnum() for x in np.unique(a[at]))


def odd_tokens(text: str) -> set[str]:
    """What looks disguised in a lower-case text: tokens and their parts between signs, runs of letters apart and their parts between gaps."""
    out = set()
    thrice = _thrice(text)
    for token in set(text.split()):
        plain = token.lstrip(_BEFORE).rstrip(_AFTER).isalpha()  # only a letter three times running is odd then
        if (thrice or not plain) and _ODD.search(token):
            out.update(x for x in (token, *_INNER.split(token)) if _ODD.search(x))
    for m in _APART.finditer(text):
        run = m.group()
        parts = {run, *_GAP.split(run), *run.split()}
        out.update(x for x in parts if len(x) > 6 or sum(map(str.isalnum, x)) > 1 and any(map(str.isalpha, x)))
    return out


class Restorer:
    """Viterbi decoding of disguised tokens under a character trigram model (``^`` begins and ``$`` ends a word)."""

    def __init__(self, trigrams: dict[str, int]):
        self.tri, self.bi, self.uni = trigrams, Counter(), Counter()
        self.pair, self.total = Counter(), 0
        for g, n in trigrams.items():
            self.bi[g[:2]] += n
            self.pair[g[1:]] += n
            self.uni[g[1]] += n
            self.total += n
        self.seen: dict[tuple[str, bool], str] = {}
        self.costs: dict[str, float] = {}

    def cost(self, before: str, c: str) -> float:
        key = before + c
        if key not in self.costs:
            p = (self.pair[before[1] + c] + 0.5) / (self.uni[before[1]] + 20)
            self.costs[key] = -math.log((self.tri.get(key, 0) + 5 * p) / (self.bi[before] + 5))
        return self.costs[key]

    def restored(self, token: str) -> set[str]:
        """The words of a token, read as one word and as words that end at signs."""
        apart = any(c in BETWEEN or c.isspace() for c in token)
        return {self.restore(token), *(self.restore(token, True).split() if apart else ())}

    def restore(self, token: str, ends: bool = False) -> str:
        """The likeliest letters of a whole token; with ``ends``, words may end at its signs and come with blanks between them."""
        if (token, ends) in self.seen:
            return self.seen[token, ends]
        costs = self.costs
        paths: dict[str, tuple[float, tuple]] = {"^^": (0.0, ("", None))}  # the letters read: the last one, and those before it
        for c in token:
            new: dict[str, tuple[float, tuple]] = {}
            options = [(c, 0.0)] if c.isalpha() else []
            options += [(x, SUBSTITUTE) for x in LEET.get(c, "") if x != c]
            sign = c in BETWEEN or c.isspace()
            skip = SKIP if sign else MISREAD if c.isalnum() else 2 * SUBSTITUTE
            for state, (cost, text) in paths.items():
                k, at = cost + skip, new.get(state)
                if at is None or k < at[0]:
                    new[state] = (k, text)
                if ends and sign and state != "^^":
                    k, at = cost + skip + self.cost(state, "$"), new.get("^^")
                    if at is None or k < at[0]:
                        new["^^"] = (k, (" ", text))
                for letter, extra in options:
                    if text[0] == letter and cost + REPEAT < new[state][0]:
                        new[state] = (cost + REPEAT, text)
                    step = costs.get(state + letter)
                    k, s = cost + extra + (self.cost(state, letter) if step is None else step), state[1] + letter
                    at = new.get(s)
                    if at is None or k < at[0]:
                        new[s] = (k, (letter, text))
            paths = new if len(new) <= 60 else dict(sorted(new.items(), key=lambda x: x[1][0])[:60])
        _, text = min((cost + self.cost(s, "$"), i, t) for i, (s, (cost, t)) in enumerate(paths.items()))[::2]
        letters = []
        while text is not None:
            letters.append(text[0])
            text = text[1]
        best = "".join(reversed(letters))
        if len(self.seen) > 100_000:
            self.seen.clear()
        if len(token) <= 200:
            self.seen[token, ends] = best
        return best


class Lexicon:
    """Entries with their precision, searched by an Aho-Corasick automaton."""

    def __init__(self, precision: dict[str, float], trigrams: dict[str, int], rest: float):
        self.precision, self.rest, self.restorer = precision, rest, Restorer(trigrams)
        self.automaton = ahocorasick.Automaton()
        for e in precision:
            self.automaton.add_word(e.rstrip(" "), e.rstrip(" "))
        if precision:
            self.automaton.make_automaton()
        self.once = {_TWICE.sub(r"\1", e): e for e in sorted(precision)}  # a restored word may have lost a double letter
        self.stems = {len(x) for x in self.once if not x.endswith(" ")}

    def found(self, text: str) -> set[str]:
        """The entries of the words of a lower-case text, disguised ones included."""
        out: set[str] = set()
        if not self.precision:
            return out
        for end, e in self.automaton.iter(text):
            start = end - len(e) + 1
            if start and text[start - 1].isalpha():
                continue
            if e in self.precision:
                out.add(e)
            if e + " " in self.precision and not text[end + 1:end + 2].isalpha():
                out.add(e + " ")
        for token in odd_tokens(text):
            for word in self.restorer.restored(token):
                once = _TWICE.sub(r"\1", word)
                out.update(self.once[x] for x in [once + " ", *[once[:n] for n in self.stems]] if x in self.once)
        return out

    def score(self, text: str) -> float:
        found = self.found(text.lower())
        return 1 - math.prod(1 - self.precision[e] for e in found) if found else self.rest


def _perhaps_known(docs: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id falls on a bit of ``known``: all that are known and a few others, told without a shuffle.

    The mask has a fixed size; ids of kinds that might be equal with unequal hashes are not filtered.
    """
    if docs.schema[id_col].dataType != known.schema["known"].dataType or docs.schema[id_col].dataType not in (T.LongType(), T.IntegerType(), T.StringType()):
        return docs
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MASK))
    bit = lambda h: F.expr(f"shiftleft(1L, CAST({h} & 63 AS INT))")
    bits = known.select(spot(F.col("known")).alias("__h")).groupBy(F.expr("shiftright(__h, 6)").alias("__word")).agg(F.bit_or(bit("__h")).alias("__bits"))
    marked = docs.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__doc_{c}") for c in docs.columns if c != id_col], spot(F.col(id_col)).alias("__h")) \
        .withColumn("__word", F.expr("shiftright(__h, 6)"))
    return marked.join(F.broadcast(bits), "__word").where(F.col("__bits").bitwiseAND(bit("__h")) != 0) \
        .select(*[F.col("__id").alias(c) if c == id_col else F.col(f"__doc_{c}").alias(c) for c in docs.columns])


def labelled_texts(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic) of all labelled training rows."""
    known = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("known")).agg(F.max(label_col).alias("toxic"))
    docs = _perhaps_known(docs.select(*dict.fromkeys([id_col, text_col])), known, id_col)
    return docs.join(known, docs[id_col] == known["known"]).select(F.col(text_col).alias("text"), "toxic")


def without_copies(sample: DataFrame) -> DataFrame:
    """One text (the smallest) of those with the same label and the same smallest hash of five words: near copies mostly share it.

    The survivors do not depend on how the rows are dealt.
    """

    def run(batches):
        for batch in batches:
            h, rows = hash_words(batch.column("text"))
            g, at = grams(h, rows, 5)
            short = np.flatnonzero(np.bincount(rows, minlength=batch.num_rows) < 5)
            with np.errstate(over="ignore"):
                total = np.zeros(batch.num_rows, np.uint64)
                np.add.at(total, rows, mix(h))
            low = np.full(batch.num_rows, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(low, rows[at], g)
            low[short] = total[short]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(low))], names=[*batch.schema.names, "low"])

    return sample.mapInArrow(run, "text string, toxic int, low long").groupBy("toxic", "low").agg(F.min("text").alias("text")).select("text", "toxic")


def learn(sample: DataFrame) -> Lexicon:
    """The lexicon of the labelled texts (text, toxic)."""
    sample = materialize(without_copies(sample.select("text", F.col("toxic").cast("int").alias("toxic"))))

    def count(batches):
        toxic, clean, texts = Counter(), Counter(), Counter()

        def counted():
            keys = chain(clean, (x for x in toxic if x not in clean))
            while k := list(islice(keys, 100_000)):
                yield pa.RecordBatch.from_arrays([pa.array(["entry"] * len(k)), pa.array(k), pa.array([toxic.get(x, 0) for x in k], pa.int64()),
                                                  pa.array([clean.get(x, 0) for x in k], pa.int64())], names=["kind", "key", "t", "c"])
            chars: Counter = Counter()
            for w, n in texts.items():
                padded = f"^^{w}$"
                for i in range(len(padded) - 2):
                    chars[padded[i:i + 3]] += n
            yield pa.RecordBatch.from_arrays([pa.array(["chars"] * len(chars), pa.string()), pa.array(list(chars), pa.string()),
                                              pa.array(list(chars.values()), pa.int64()), pa.array([0] * len(chars), pa.int64())],
                                             names=["kind", "key", "t", "c"])
            for held in (toxic, clean, texts):
                held.clear()

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic"), strict=True):
                ws = set(words((text.as_py() or "").lower()))
                texts.update(ws)
                (toxic if label.as_py() == 1 else clean).update(set().union(*map(entries, ws)))
                if len(toxic) + len(clean) > MOST_COUNTED:
                    yield from counted()
        yield from counted()
        entries.cache_clear()  # the worker goes on to other stages

    sums = materialize(sample.mapInArrow(count, "kind string, key string, t long, c long").groupBy("kind", "key")
                       .agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    likely = sums.where((F.col("kind") == "entry") & (F.col("t") >= SUPPORT) & (F.col("t") >= PRECISION * (F.col("t") + F.col("c"))))
    chosen: dict[str, tuple[int, int]] = {}
    for r in sorted(likely.collect(), key=lambda r: (len(r.key), r.key)):
        if not any(r.key[:n] in chosen for n in STEMS if n < len(r.key)):
            chosen[r.key] = (r.t, r.c)
    trigrams = {r.key: r.t for r in sums.where((F.col("kind") == "chars") & (F.col("t") >= 3) & (F.length("key") == 3)).collect()}
    grams_of = [p[i:i + 3] for e in chosen for p in ["^^" + e.replace(" ", "$")] for i in range(len(p) - 2)]
    share = sum(trigrams.values()) // max(1, len(grams_of))
    for g in grams_of:  # half of what the channel expects are words of the lexicon
        trigrams[g] = trigrams.get(g, 0) + share
    shared = df_broadcast(sample, set(chosen))

    def rest(batches):
        known = shared.value
        unknown = lru_cache(100_000)(lambda w: known.isdisjoint(entries(w)))
        for batch in batches:
            left = [y.as_py() for x, y in zip(batch.column("text"), batch.column("toxic"), strict=True)
                    if all(map(unknown, set(words((x.as_py() or "").lower()))))]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32())], names=["toxic"])
        entries.cache_clear()

    missed, left = sample.mapInArrow(rest, "toxic int").agg(F.sum("toxic"), F.count(F.lit(1))).first()
    rate = ((missed or 0) + 0.1) / (left + 1)
    return Lexicon({e: (t + 0.5) / (t + c + 1) for e, (t, c) in chosen.items()}, trigrams, min(0.49, rate))


def score(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1).

    ``train`` says, over the columns of ``labels``, which labels may be learned
    from; of several labels of an id the largest holds, null labels and ids are
    left out. Null and empty texts get the rate of toxic texts without an entry;
    without labelled rows nothing is toxic. Rows and other columns stay, a column
    ``toxicity`` is replaced; an empty table gives an empty result.
    """
    docs = docs.drop("toxicity")
    lexicon = learn(labelled_texts(docs, labels, train, id_col, text_col, label_col))
    shared = df_broadcast(docs, (lexicon.precision, lexicon.restorer.tri, lexicon.rest))

    def run(batches):
        own = Lexicon(*shared.value)
        for batch in batches:
            scores = [own.score(x.as_py() or "") for x in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())]))
