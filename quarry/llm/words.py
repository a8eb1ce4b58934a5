"""Vectorised word splitting and hashing of Arrow text batches.

Everything works on the UTF-8 bytes of a whole batch at once, in pieces of
``PIECE`` bytes cut at separators, so a very long text costs no more memory
than a short one. A word is a maximal run of bytes that the folding table maps
to a non-zero byte; its hash is a 64-bit polynomial over random byte values,
the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(_BASE * (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)))


_BYTE_VALUE = seeded(7, 256)


def _fold(separators: set[int]) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators)] = 0
    t[0] = 0 if 0 in separators else 1  # NUL stays a word byte of its own value
    return t


#: Words ``[^\x20\x09-\x0D]+``, A-Z lower-cased.
SPACE_FOLD = _fold({0x20, *range(0x09, 0x0E)})
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM_FOLD = _fold({i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122)})

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("p", _BASE), ("i", inverse)):
            full = np.full(n, base, dtype=np.uint64)
            full[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.cumprod(full)
    return _POWERS["p"], _POWERS["i"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n + 1 offsets of its rows in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _pieces(raw: np.ndarray, fold: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw):  # forward to the next separator
            gap = np.flatnonzero(fold[raw[end:end + PIECE]] == 0)
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + PIECE, len(raw))
        yield at, end
        at = end


def hash_words(column: pa.Array, fold: np.ndarray = SPACE_FOLD) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of the column, in order; rows count from 0."""
    raw, offsets = text_bytes(column)
    hashes, rows = [], []
    for at, end in _pieces(raw, fold):
        folded = fold[raw[at:end]]
        inside = folded != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, end, "left")] - at
        first[edges] = inside[edges]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        value = np.where(inside, _BYTE_VALUE[folded], np.uint64(0))
        power, inverse = _powers(len(folded))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(value * power[:len(folded)], starts)
            hashes.append(mix(total * inverse[starts]))
        rows.append(np.searchsorted(offsets, starts + at, "right") - 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def hash_word(word: str, fold: np.ndarray = SPACE_FOLD) -> int:
    """The hash of one word."""
    return int(hash_words(pa.array([word]), fold)[0][0])


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a row, and the index of the first word of each."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        h = hashes[:last].copy()
        for i in range(1, n):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + hashes[i:last + i])
    ok = np.flatnonzero(rows[:last] == rows[n - 1:])
    return h[ok], ok


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return x.view(np.int64)
