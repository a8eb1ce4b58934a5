"""Findings of round 3, second look: near copies of one text in a large group, disguised tokens told without a pattern search."""

import random

import numpy as np

from quarry.llm import near_dedup, toxicity


def test_near_copies_of_one_text_do_not_branch_on(spark, monkeypatch):
    """Copies changed to any degree, many of them outside the large component: compared in blocks, no link lost."""
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng, docs = np.random.default_rng(5), []
    for i in range(240):
        w = [f"w{k}" for k in range(100)]
        for j in rng.choice(100, rng.integers(0, 16), replace=False):
            w[j] = f"x{i}_{j}"
        docs.append((i, " ".join(w)))
    blocks, held = [], near_dedup._block_links
    monkeypatch.setattr(near_dedup, "_block_links", lambda *a: blocks.append(1) or held(*a))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()}

    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:], strict=False)} for _, t in docs]
    low = list(range(len(docs)))
    for _ in docs:  # smallest id reachable
        new = [min([low[j] for j, y in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)]) for x in sets]
        if new == low:
            break
        low = new
    assert [got[i] for i in range(len(docs))] == low and 1 < len(set(low)) < len(docs)
    assert blocks


def test_disguised_tokens_as_the_pattern_finds_them(monkeypatch):
    def by_pattern(text):
        out = set()
        for token in text.split():
            out.update(x for x in (token, *toxicity._INNER.split(token)) if toxicity._ODD.search(x))
        return out

    class Counted:
        calls, search = 0, staticmethod(toxicity._ODD.search)

    counted = Counted()
    rng, signs = random.Random(1), "aabcdé ßz²½0159@$!|+€£(¡*~^_.-'`,:;?)\"<>#/\\ \n漢"
    for _ in range(5000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 25)))
        assert toxicity.odd_tokens(text) - set().union(*[{m.group(), *toxicity._GAP.split(m.group()), *m.group().split()} for m in toxicity._APART.finditer(text)]) <= by_pattern(text)
        assert by_pattern(text) <= toxicity.odd_tokens(text)

    def search(token):
        counted.calls += 1
        return counted.search(token)

    monkeypatch.setattr(toxicity, "_ODD", type("Pattern", (), {"search": staticmethod(search)}))
    assert toxicity.odd_tokens('plain words, with "signs" around them): nothing odd. ' * 50) == set()
    assert counted.calls <= 1  # before: once a token
