"""Spelling variants against brute force, and on odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from quarry.llm import queries, variants

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def edits(w, alphabet):
    out = {w[:i] + w[i + 1:] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in alphabet} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
    return out - {w}


def grouped(n, factor=5):
    """{word: (form, root, n, n_near, form_n)} by trying every edit."""
    alphabet = sorted(set("".join(n)))
    near = {w: sorted((v for v in edits(w, alphabet) if v in n), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= factor * n[w] else None for w, v in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows(df):
    got = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(out) == len(got)
    return out


def test_query_matches_brute_force(spark):
    n = Counter()
    for d in ds.dataset(SF + "/documents.parquet").to_table().to_pylist():
        for run in RUN.findall(d["text"] or ""):
            w = run.translate(FOLD)
            h = zlib.crc32(f"{d['doc_id']}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    want = grouped({w: c for w, c in n.items() if len(w) >= 6 and c >= 5})
    assert len(want) > 500 and any(v[0] for v in want.values())
    assert rows(queries.op11_spelling_variants(spark, SF)) == want


@pytest.mark.parametrize("chunk,crowd", [(1024, 2000), (8, 4), (5, 10_000)])
def test_blocks_and_chunks_lose_no_pair(spark, monkeypatch, chunk, crowd):
    """Dense words over few letters, in one signature cut into chunks and in many small ones."""
    monkeypatch.setattr(variants, "CHUNK", chunk)
    monkeypatch.setattr(variants, "CROWD", crowd)
    rng = random.Random(chunk)
    n = {"".join(rng.choices("abcäßÀ", k=rng.randint(4, 8))): rng.choice([1, 5, 25, 130, 700]) for _ in range(400)}
    n |= {"x" * k: 5 ** (k - 20) for k in range(20, 26)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert rows(variants.variant_groups(df)) == grouped(n)


def test_edit_checks():
    block = lambda *w: variants.Block("\n".join(w), [1] * len(w))
    a, b = block("abcde", "bcdea", "aaaaa"), block("abxcde", "abcdee", "edcbaa")
    assert list(zip(*variants.near_pairs(a, b, False), strict=True)) == [(0, 0), (0, 1)]
    c = block("abcde", "abcdf", "abced", "bacdf")
    assert list(zip(*variants.near_pairs(c, c, True), strict=True)) == [(0, 1)]
    long = block("x" * 3000 + "a", "x" * 3000 + "b")
    assert long.counts.dtype == np.float64 and list(zip(*variants.near_pairs(long, long, True), strict=True)) == [(0, 1)]


def test_groups_grow_with_the_vocabulary():
    sizes = [variants.groups_for(v, 8.5) for v in (0, 1000, 100_000, 10_000_000, 1_000_000_000)]
    assert sizes == sorted(sizes) and sizes[0] == 1 and sizes[-1] > sizes[2] > 1


def test_odd_rows(spark):
    schema = "doc_id long, text string, word string, n long, h long"
    text = " ".join(["Colour"] * 30 + ["colorÄ"] * 5 + ["kolour"] * 6 + ["short"] * 9 + ["x" * 5000] * 5 + ["x" * 4999] * 30 + ["un×ics"] * 5)
    odd = [(1, text, "w", 1, 2), (2, None, None, None, None), (3, "", "", 0, 0), (None, "colour-colour", "c", 1, 1), (None, "colour-colour", "c", 1, 1)]
    got = rows(variants.spelling_variants(spark.createDataFrame(odd, schema)))
    assert set(got) == {"colour", "colorÄ", "kolour", "x" * 5000, "x" * 4999, "un×ics"}
    assert got["colour"] == (None, "colour", 34, 1, None) and got["colorÄ"] == (None, "colorÄ", 5, 0, None)
    assert got["kolour"] == ("colour", "colour", 6, 1, 34)
    assert got["x" * 5000] == ("x" * 4999, "x" * 4999, 5, 1, 30)
    assert rows(variants.spelling_variants(spark.createDataFrame([], schema))) == {}
    bare = spark.createDataFrame([(None, 3), ("", 3), ("abc", None), ("abcd", 2)], "word string, n long")
    assert rows(variants.variant_groups(bare)) == {"abcd": (None, "abcd", 2, 0, None)}


def test_ties_go_to_the_smallest_form(spark):
    n = {"banana": 2, "banans": 50, "bananb": 50, "bananaz": 50, "canana": 49}
    got = rows(variants.variant_groups(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == grouped(n) and got["banana"][0] == "bananaz"


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(13)]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w13" for w, _ in chain}
    assert variants.roots(spark.createDataFrame(chain, "word string, form string").where(F.lit(False))).count() == 0
