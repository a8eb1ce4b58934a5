"""Vector codes against a plain version of the same rounds, and on odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, `key` string, code string"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """{row index: (codes, error)} and the final books of (id, vector) rows of one dimension, by full comparisons in Python integers."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    width = -(-len(rows[0][1]) // parts)
    cut = []
    for _, v in rows:
        x = [int(np.floor(float(np.float32(c)) * scale)) for c in v] + [0] * (parts * width - len(v))
        cut.append([x[p * width:(p + 1) * width] for p in range(parts)])
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))

    def assigned():
        return [[min((dist(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            mine = defaultdict(list)
            for i, a in enumerate(now):
                mine[a[p][1]].append(cut[i][p])
            books[p] = [[sum(c) // len(mine[j]) for c in zip(*mine[j], strict=True)] if j in mine else e for j, e in enumerate(books[p])]
    now = assigned()
    return [("".join(f"{j:02x}" for _, j in a), sum(d for d, _ in a)) for a in now], books


def digest(books):
    return hashlib.sha256(",".join(str(c) for part in books for entry in part for c in entry).encode()).hexdigest()


@pytest.mark.parametrize("n,dim,spread,parts,entries,rounds", [(300, 32, 1.0, 16, 64, 2), (400, 16, 0.02, 4, 10, 5), (40, 20, 0.5, 16, 64, 2),
                                                              (500, 12, 30.0, 3, 24, 6)])
def test_codes_match_full_comparisons(spark, n, dim, spread, parts, entries, rounds):
    """Small spreads give many equally near entries; several rounds let the lists shrink and the bounds loosen."""
    rng = np.random.default_rng(n)
    centres = rng.normal(0, spread, (6, dim))
    rows = [(int(i), [float(np.float32(c)) for c in centres[i % 6] + rng.normal(0, spread / 5, dim)]) for i in rng.permutation(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    done = codes.compress(df, label_col=None, parts=parts, entries=entries, rounds=rounds)
    want, books = plain(rows, parts, entries, rounds)
    assert {r.vec_id: (r.code, r.error) for r in done.rows.collect()} == {rows[i][0]: w for i, w in enumerate(want)}
    assert done.codebooks.digest() == digest(books)


def test_lists_shrink_when_few_entries_are_needed(spark):
    """Well separated groups: after the first round hardly any part needs its list."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(100 * (i % 20) + c)) for c in rng.normal(0, 0.1, 4)]) for i in range(600)]
    done = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), label_col=None, parts=2, entries=20, rounds=4)
    assert done.listed[0] == 2 and done.listed[-1] == 1
    want, _ = plain(rows, 2, 20, 4)
    assert {r.vec_id: (r.code, r.error) for r in done.rows.collect()} == {i: w for i, w in enumerate(want)}


def test_odd_rows(spark):
    big, nan = [3e38] * 16, float("nan")
    rows = [(1, [0.5] * 16, 1, "a", "x"), (1, [0.5] * 16, 1, "a", "x"), (1, [0.25] * 16, None, None, None), (None, [-0.001] * 16, None, "b", None),
            (2, None, 1, None, None), (3, [nan] * 16, 1, None, None), (4, [None] * 16, 1, None, None), (5, [float("inf")] * 16, 1, None, None),
            (6, [1.0] * 8, 1, None, None), (7, [], 1, None, None), (8, big, 2, None, None)]
    out = codes.compressed_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in out) == [(False, 1), (False, 1), (False, 1), (False, 8), (True, 0)]
    kept = [r for r in rows if r[1] is not None and len(r[1]) == 16 and all(c is not None and abs(c) < float("inf") for c in r[1])]
    held = [(i, [c if abs(c) < 1e30 else codes.bound_of(16) / 256 for c in v]) for i, v, *_ in kept]
    want, books = plain(held)
    assert sorted((r.code, r.error) for r in out) == sorted(want)
    assert {r.codebooks_sha256 for r in out} == {digest(books)}
    assert codes.compressed_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.compressed_report(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_totals_of_hot_and_rare_keys(spark):
    rows = [(i, None if i % 3 == 0 else i % 3 if i % 2 else 100 + i, i) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k long, v long")
    got = {r.id: r.total for r in codes.with_group_totals(df, "k", "v", "total", hot=20).collect()}
    sums = defaultdict(int)
    for _, k, v in rows:
        sums[k] += v
    assert got == {i: sums[k] for i, k, _ in rows}
    assert codes.with_group_totals(df.where(F.lit(False)), "k", "v", "total").count() == 0
