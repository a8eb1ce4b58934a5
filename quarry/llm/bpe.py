"""Byte-level BPE encoding and decoding inside Spark tasks.

Texts are cut into words by the tokenizer's pattern; each distinct word of a
batch is encoded once. A word's parts and the ranks of its adjacent pairs lie in
contiguous arrays: repeatedly the smallest rank is found by a scan, the boundary
behind it is deleted and the two neighbouring ranks are looked up anew. Words of
one length share a matrix, one word a row, so a step of the scan is one numpy
call for all of them. Words beyond ``SHORT`` bytes, for which repeated scans
would take quadratic time, keep their pairs in a heap and give the same merges.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of a word that is encoded by scans.
SHORT = 48
#: Distinct words that a Python worker remembers; beyond, it starts afresh.
REMEMBERED = 60_000
#: Characters of text that are cut into words at once.
AT_ONCE = 1 << 19
NO_RANK = np.iinfo(np.int32).max

# Letters and numbers of later Unicode versions, which the tokenizer's tables count as neither.
LATER = (
    "՘֋֌࢏౜೜₏₝-₟꟎꟏꟒꟔꟝꟢꟱꭬꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")

_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_WORDS = regex.compile(rf"{_SUFFIXES}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+")
#: The same for texts of ASCII characters only, on the faster engine.
_WORDS_ASCII = re.compile(rf"{_SUFFIXES}| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_LATER = regex.compile(f"[{LATER}]")
_WORDS_LATER = regex.compile(
    rf"(?V1){_SUFFIXES}| ?[\p{{L}}--[{LATER}]]+| ?[\p{{N}}--[{LATER}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{LATER}]]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, as character -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and tokens of a byte-level BPE file (``tokenizers`` JSON without normaliser or prefix space).

    Read once on the driver; tasks get the arrays: a hash table of pairs and the tokens' bytes
    in one piece. What only long words or decoding need is made from them when first used.
    """

    def __init__(self, spec: dict):
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("only plain byte-level vocabularies are supported")
        self.first = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.first[b] = ids[c]
        keys, merged = [], []
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            keys.append(ids[a] << 32 | ids[b])
            merged.append(ids[a + b])
        self.merged = np.array([*merged, 0], np.int32)
        self.size = 1 << max(4, (4 * len(keys)).bit_length())
        self._fill(np.array(keys, np.int64))
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that strip, normalise or need word ends are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") \
            if self.added else None
        n = max([*ids.values(), *self.added.values()]) + 1
        tokens = [b""] * n
        for t, i in ids.items():
            tokens[i] = bytes(letters[c] for c in t)
        for t, i in self.added.items():
            tokens[i] = t.encode()
        self.raw, self.ends = b"".join(tokens), np.cumsum([len(t) for t in tokens], dtype=np.int64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rank", "bytes")}

    @cached_property
    def rank(self) -> dict[int, int]:
        """Pair -> rank."""
        held = self.keys != -1
        return dict(zip(self.keys[held].tolist(), self.ranks[held].tolist(), strict=True))

    @cached_property
    def bytes(self) -> list[bytes]:
        """The bytes of each token."""
        ends = self.ends.tolist()
        return [self.raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (self.size - 1)

    def _fill(self, keys: np.ndarray) -> None:
        """An open hash table of pair -> rank."""
        self.keys = np.full(self.size, -1, np.int64)
        self.ranks = np.full(self.size, NO_RANK, np.int32)
        for r, (k, s) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[s] != -1 and self.keys[s] != k:
                s = (s + 1) & (self.size - 1)
            if self.keys[s] == -1:
                self.keys[s], self.ranks[s] = k, r

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, ``NO_RANK`` where two parts never merge."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        out = np.full(keys.shape, NO_RANK, np.int32)
        left_over = np.arange(keys.size)
        flat, slot, res = keys.ravel(), slot.ravel(), out.ravel()
        while len(left_over):
            at = self.keys[slot[left_over]]
            hit = at == flat[left_over]
            res[left_over[hit]] = self.ranks[slot[left_over[hit]]]
            left_over = left_over[~hit & (at != -1)]
            slot[left_over] = (slot[left_over] + 1) & (self.size - 1)
        return res.reshape(keys.shape)

    def short_words(self, words: list[bytes], size: int) -> list[bytes]:
        """Token ids (little-endian uint32) of words of ``size`` bytes each, by scans of the rank array."""
        ids = self.first[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)]
        ranks = self.ranks_of(ids[:, :-1], ids[:, 1:])
        out: list[bytes] = [b""] * len(words)
        row = np.arange(len(words))
        while True:
            width = ids.shape[1]
            if width > 1:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(row)), at]
                done = best == NO_RANK
            else:
                done = np.ones(len(row), bool)
            if done.any():
                raw, step = ids[done].astype("<u4").tobytes(), 4 * width
                for i, r in enumerate(row[done].tolist()):
                    out[r] = raw[i * step:(i + 1) * step]
                if done.all():
                    return out
                more = ~done
                ids, ranks, row, at, best = ids[more], ranks[more], row[more], at[more], best[more]
            every = np.arange(len(row))
            ids[every, at] = self.merged[best]
            column = np.arange(width - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            column = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.ranks_of(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < width - 2)
            ranks[after, at[after]] = self.ranks_of(ids[after, at[after]], ids[after, at[after] + 1])

    def long_word(self, word: bytes) -> bytes:
        """The same merges for a long word: the pair of smallest rank, leftmost first, from a heap."""
        ids = [int(self.first[b]) for b in word]
        n = len(ids)
        after, before, get = [*range(1, n), -1], [-1, *range(n - 1)], self.rank.get
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (q := get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (q, a))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Token ids of distinct words."""
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        out = {}
        for w in words:
            b = w.encode("utf-8")
            if len(b) > SHORT:
                out[w] = self.long_word(b)
            else:
                names, raw = by_size.setdefault(len(b), ([], []))
                names.append(w)
                raw.append(b)
        for size, (names, raw) in by_size.items():
            out.update(zip(names, self.short_words(raw, size), strict=True))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of token ids (little-endian uint32); bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


class Encoder:
    """Encodes texts, remembering the words met so far in this worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.seen = vocabulary, {}

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return _WORDS_ASCII.findall(text)
        return (_WORDS_LATER if _LATER.search(text) else _WORDS).findall(text)

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, whether it is an added token)."""
        split = self.vocabulary.split
        if split is None or not split.search(text):
            yield text, False
            return
        for i, part in enumerate(split.split(text)):
            if part:
                yield part, bool(i % 2)

    def many(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text; the words of many texts are looked up together."""
        cut = [[(self.words(p), None) if not added else (None, self.vocabulary.added[p]) for p, added in self.pieces(t)]
               for t in texts]
        seen = self.seen
        words = {w for parts in cut for ws, _ in parts if ws for w in ws}
        new = words.difference(seen)
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = words
        seen.update(self.vocabulary.encode_words(new))
        number = lambda i: i.to_bytes(4, "little")
        return [b"".join(number(i) if ws is None else b"".join(map(seen.__getitem__, ws)) for ws, i in parts) for parts in cut]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read on the driver; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


def _batches(column: pa.Array) -> Iterator[list[str]]:
    group, size = [], 0
    for x in column:
        text = x.as_py() or ""
        group.append(text)
        size += len(text)
        if size >= AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _with_column(batch: pa.RecordBatch, values: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def _extended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``ids_col``: the token ids of each whole text as little-endian unsigned 32-bit integers.

    As the ``tokenizers`` library encodes with ``add_special_tokens=False`` and no
    truncation or padding: an added token's string in a text becomes its id.
    Null counts as empty, an empty text has no ids (an empty binary). Rows and
    other columns stay as they are, repeated rows too; a column of the new name
    is replaced.
    """
    docs = docs.drop(ids_col)
    shared = df_broadcast(docs, vocabulary(path))

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = [x for group in _batches(batch.column(text_col)) for x in encoder.many(group)]
            yield _with_column(batch, pa.array(ids, pa.binary()), ids_col)

    return docs.mapInArrow(run, _extended(docs, ids_col, T.BinaryType()))


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the text of each row's token ids (null: empty)."""
    df = df.drop(text_col)
    shared = df_broadcast(df, vocabulary(path))

    def run(batches):
        v = shared.value
        for batch in batches:
            texts = [v.decode(x.as_py() or b"") for x in batch.column(ids_col)]
            yield _with_column(batch, pa.array(texts, pa.string()), text_col)

    return df.mapInArrow(run, _extended(df, text_col, T.StringType()))


def df_broadcast(df: DataFrame, value):
    """A broadcast of a value whose size does not depend on the data (here a vocabulary file)."""
    return df.sparkSession.sparkContext.broadcast(value)
