"""Findings of round 3, third look: candidate pairs of near copies, entries that a task of the toxicity model holds."""

import numpy as np
import pyarrow as pa

from quarry.llm import near_dedup, toxicity


def test_candidate_pairs_come_out_once(spark, monkeypatch):
    """Copies that differ by more than the threshold share nodes of many trees; each pair is a candidate once, and no link is lost."""
    rng, docs = np.random.default_rng(8), []
    for i in range(120):
        w = [f"w{k}" for k in range(100)]
        for j in rng.choice(100, rng.integers(3, 8), replace=False):
            w[j] = f"x{i}_{j}"
        docs.append((i, " ".join(w)))
    counts, held = [], near_dedup._crossing

    def counted(*args):
        pairs = held(*args)
        counts.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(near_dedup, "_crossing", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()}

    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:], strict=False)} for _, t in docs]
    low = list(range(len(docs)))
    for _ in docs:  # smallest id reachable
        new = [min([low[j] for j, y in enumerate(sets) if 5 * len(x & y) >= 4 * len(x | y)]) for x in sets]
        if new == low:
            break
        low = new
    assert [got[i] for i in range(len(docs))] == low and len(set(low)) < len(docs)
    (rows, pairs), = counts
    assert rows == pairs > 0  # before: once for every node that a pair shares


def test_learning_leaves_no_entries_in_the_workers(spark):
    """Workers go on to the next stages, so what the toxicity model remembers of words ends with its tasks."""
    texts = spark.createDataFrame([(f"some words of text {i} trashword" if i % 2 else f"other words {i} kindly", i % 2) for i in range(64)],
                                  "text string, toxic int").repartition(4)
    lexicon = toxicity.learn(texts)
    assert lexicon.score("a trashword here") > 0.9 and lexicon.score("kindly") < 0.5

    def held(batches):
        from quarry.llm import toxicity

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([toxicity.entries.cache_info().currsize], pa.int64())})

    left = [r.n for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()]
    assert left and max(left) == 0
