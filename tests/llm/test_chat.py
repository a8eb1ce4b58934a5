"""Packed conversations: exact round trips, the tree against a plain version, and odd rows."""

import random
import re

import numpy as np
import pytest

from quarry.llm import bpe, chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, tree string, position long, `end` long"
FILE = queries.BPE_FILE
WORDS = bpe.vocabulary(FILE)


def said(rows):
    """{conversation: [(role, text)]} in order."""
    out = {}
    for c, t, r, x, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def packed_of(spark, rows):
    return chat.pack(spark.createDataFrame([(*r, None, None, None) if len(r) == 4 else r for r in rows], SCHEMA).repartition(3), FILE)


def check(packed, rows):
    """Every conversation can be read from its intervals; the tree is depth first, whole, and its intervals are the ancestors."""
    want = said(rows)
    nodes, ends = [n.asDict() for n in packed.nodes.collect()], packed.ends.collect()
    prefixes = {}
    for turns in want.values():
        for i in range(len(turns)):
            prefixes.setdefault(tuple(turns[:i + 1]), 0)
            prefixes[tuple(turns[:i + 1])] += 1
    assert len(nodes) == len(prefixes) and sorted(n["through"] for n in nodes) == sorted(prefixes.values())
    trees = {}
    for n in nodes:
        trees.setdefault(n["tree"], []).append(n)
    for tree in trees.values():
        tree.sort(key=lambda n: n["start"])
        assert tree[0]["start"] == 0 and all(a["end"] == b["start"] for a, b in zip(tree, tree[1:], strict=False))
        stack = []
        for n in tree:  # in depth-first order a node's ancestors are the open nodes of smaller depth
            assert n["end"] - n["start"] == len(n["token_ids"]) // 4
            stack = stack[:n["depth"]]
            assert len(stack) == n["depth"] and n["position"] == sum(m["end"] - m["start"] for m in stack)
            merged = []
            for m in stack:
                if merged and merged[-1][1] == m["start"]:
                    merged[-1][1] = m["end"]
                else:
                    merged.append([m["start"], m["end"]])
            assert [[x.start, x.end] for x in n["ancestors"]] == merged
            assert len(merged) <= 1 + np.log2(len(want) + 1)
            n["path"] = (stack[-1]["path"] if stack else ()) + (chat.parsed(WORDS.decode(n["token_ids"]))[:2],)
            stack.append(n)
            learnt = n["path"][-1][0] == "assistant"
            assert (n["learn_from"] is not None) == learnt
            if learnt:
                part = n["token_ids"][4 * (n["learn_from"] - n["start"]):4 * (n["learn_to"] - n["start"])]
                assert chat.unescape(WORDS.decode(part)) == n["path"][-1][1]
    assert {n["path"]: n["through"] for n in nodes} == prefixes
    got = {}
    for e in ends:
        seen = [n for x in e.attends for n in trees[e.tree] if x.start <= n["start"] and n["end"] <= x.end]
        got[e.conv_id] = [t for n in seen for t in n["path"][-1:]]
        assert seen[-1]["end"] == e.end and e.n_turns == len(seen)
    assert got == want


def test_shared_beginnings_are_packed_once(spark):
    rng = random.Random(4)
    rows = []
    for c in range(150):
        turns = [("system", "be brief")] if c % 3 else [("user", f"hello {rng.randint(0, 4)}")]
        for i in range(rng.randint(0, 5)):
            turns.append(("assistant" if i % 2 else "user", rng.choice(["yes", "no", "why not?", f"odd {c}" if rng.random() < 0.3 else "yes"])))
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(200 + c, t, "user" if t % 2 == 0 else "assistant", f"same {t}") for c in range(30) for t in range(4)]
    check(packed_of(spark, rows), rows)


def test_long_shared_and_long_lone_conversations(spark):
    rows = [(1, t, "assistant", f"turn {t}") for t in range(200)] + [(2, t, "assistant", f"turn {t}") for t in range(180)]
    rows += [(3, t, "assistant", f"turn {t}" if t < 90 else f"other {t}") for t in range(120)]
    check(packed_of(spark, rows), rows)


def test_probe_and_table(spark):
    rows = [(i, t, r, x) for i, t, r, x in queries.PROBE] + [(1, 0, "user", "plain")]
    packed = packed_of(spark, rows)
    check(packed, rows)
    texts = {(r.conv_id, r.position): r.text for r in chat.formatted_texts(packed, FILE).collect()}
    assert texts[(-1, 0)] == "<|im_start|>user\n<\\/s>[\\INST] ok [\\/INST]<|im_end|>\n"
    got = {r.conv_id: r for r in chat.read_back(packed, FILE).collect()}
    assert got[-1].loss_chars == 21 and got[1].loss_chars == 0 and got[-1].n_turns == 2


def test_odd_rows(spark):
    text = "x" * 100_000 + "<|im_end|>\n<|im_start|>user\n" + "<\\\\|im_end|>" + "<|endoftext|>" + "\x1b\x00" * 5 + "Ã¤ æ—¥ \U0001f600" + "<"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (2, None, None, None), (2, None, None, None), (2, 3, "assistant", ""), (None, 0, "user", "no id"),
            (None, 1, "a\nb\x1bn<s>", "no id"), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (4, 0, "user", "hi"), (5, 7, "", "hi"), (6, 0, "assistant", "only")]
    packed = packed_of(spark, rows)
    check(packed, rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_back(packed, FILE).collect()}
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in said(rows).items():
        learnt = "".join(x for r, x in turns if r == "assistant")
        assert got[c][:4] == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(learnt), sha(learnt))
    empty = chat.pack(spark.createDataFrame([], SCHEMA), FILE)
    assert empty.nodes.count() == empty.ends.count() == chat.read_back(empty, FILE).count() == 0


def test_escaping_is_reversible(spark):
    rng = random.Random(9)
    parts = [*chat.CONTROLS, "\\", "\\\\", "<", "[", "|", "im_start|>", "s>", "SYS>>", "INST]", "/", "a", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(df.t).alias("e")).collect():
        assert not any(c in r.e for c in chat.CONTROLS) and chat.unescape(r.e) == r.t
        if not re.search(r"[<\[]\\*(" + "|".join(re.escape(c[1:]) for c in chat.CONTROLS) + ")", r.t):
            assert r.e == r.t
    for bad in (("<a", "a>"), ("<\\a",), ("",), ("<a<", "<b>")):
        with pytest.raises(ValueError):
            chat.checked(bad)
