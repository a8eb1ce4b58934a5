"""Streaming (availableNow, checkpoint idempotence, batch = stream) and seeded ML sanity."""

import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.sources.pages import DOLLAR_AMOUNT, DOCUMENT_TITLE
from quarry.streaming import snapshots as snap


def _pages(spark, start, n):
    rows = [(i, f"u{i}", f"<html><title> Item {i} </title><b>${i}.50</b></html>") for i in range(start, start + n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_stream_is_idempotent_and_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="quarry-stream-test-")
    src, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    _pages(spark, 0, 20).coalesce(1).write.parquet(f"{src}/batch=0")
    stream = snap.snapshots(snap.page_stream(spark, src), "2024-01-31")
    snap.run_available(stream, sink, ckpt)
    first = spark.read.parquet(sink).count()
    snap.run_available(snap.snapshots(snap.page_stream(spark, src), "2024-01-31"), sink, ckpt)
    assert spark.read.parquet(sink).count() == first == 20          # rerun adds nothing
    _pages(spark, 100, 5).coalesce(1).write.parquet(f"{src}/batch=1")
    snap.run_available(snap.snapshots(snap.page_stream(spark, src), "2024-01-31"), sink, ckpt)
    out = spark.read.parquet(sink)
    assert out.count() == 25                                          # only the new file
    batch = snap.snapshots(spark.read.parquet(src).select("page_id", "url", "html"), "2024-01-31")
    assert sorted(map(tuple, out.select("page_id", "title", "price").collect())) == \
        sorted(map(tuple, batch.select("page_id", "title", "price").collect()))
    r = out.where(F.col("page_id") == 3).first()
    assert r.title == "Item 3" and float(r.price) == 3.50
    assert DOCUMENT_TITLE and DOLLAR_AMOUNT


def test_alert_stream(spark):
    base = tempfile.mkdtemp(prefix="quarry-alert-test-")
    _pages(spark, 0, 30).coalesce(1).write.parquet(f"{base}/in")
    alerts = snap.price_alerts(snap.snapshots(snap.page_stream(spark, f"{base}/in"), "2024-01-31"), 14.0)
    snap.run_available(alerts, f"{base}/out", f"{base}/ckpt")
    got = sorted(r.page_id for r in spark.read.parquet(f"{base}/out").collect())
    assert got == list(range(0, 14))                                   # i.50 < 14 for i <= 13


def _product(i, price):
    span = f'<span class="a-price-whole"> ${price} </span>' if price is not None else ""
    return i, f"u{i}", f'<span id="productTitle"> Item {i} </span>{span}'


def test_two_sinks_hold_every_row_once(spark):
    """Prices on both sides of the threshold; a second run, a new file and a batch that runs again leave each row once."""
    base = tempfile.mkdtemp(prefix="quarry-two-sinks-")
    prices = ["13.99", "14.00", "1,234.50", None, "sold out", "0.50"]
    spark.createDataFrame([_product(i, p) for i, p in enumerate(prices)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{base}/in")
    run = lambda: snap.run_with_alerts(snap.page_stream(spark, f"{base}/in"), "2024-01-31", f"{base}/s", f"{base}/a", f"{base}/c", 14.0)
    schema = run()
    held = lambda d: sorted((r.page_id, None if r.price is None else float(r.price)) for r in snap.read_sink(spark, f"{base}/{d}", schema).collect())
    want = [(0, 13.99), (1, 14.0), (2, 1234.5), (3, None), (4, None), (5, 0.5)]
    assert held("s") == want and held("a") == [(0, 13.99), (5, 0.5)]
    run()
    assert held("s") == want and held("a") == [(0, 13.99), (5, 0.5)]
    spark.createDataFrame([_product(9, "2.00")], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{base}/in")
    run()
    assert held("s") == [*want, (9, 2.0)] and held("a") == [(0, 13.99), (5, 0.5), (9, 2.0)]
    again = snap.snapshots(spark.createDataFrame([_product(9, "2.00")], "page_id long, url string, html string"), "2024-01-31")
    for _ in range(2):  # the last batch runs again, as after a failure between the sinks
        snap.write_batch(again, 1, f"{base}/s", f"{base}/a", 14.0)
    assert held("s") == [*want, (9, 2.0)] and held("a") == [(0, 13.99), (5, 0.5), (9, 2.0)]


def test_pruned_tree_and_its_errors(spark):
    """A tree on a planted rule, with nulls, a text feature and noise: subtrees shrink with cp, expressions score as counted."""
    import random

    from quarry.operators import trees

    rng = random.Random(5)
    rows = []
    for i in range(1200):
        x, c, b = rng.choice([None, *[j / 10 for j in range(100)]]), rng.choice(["red", "green", "blue", None]), rng.random() < 0.5
        y = "yes" if (x is not None and x > 6.0) or c == "red" else "no"
        rows.append((i, x, c, b, y if rng.random() < 0.9 else rng.choice(["yes", "no"]) if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "id long, x double, c string, b boolean, y string")
    features = ["x", "c", "b"]
    tree, table = trees.complexity_table(df, features, "y", ["id"], folds=5)
    got = table.orderBy("n_split").collect()
    assert [r.n_split for r in got] == sorted({r.n_split for r in got}) and got[0].n_split == 0 and got[0].rel_error == 1.0
    assert all(a.rel_error >= b.rel_error and a.cp >= b.cp for a, b in zip(got, got[1:], strict=False)) and got[-1].x_error < 0.6
    for cp in (0.0, 0.01, 0.2, 2.0):
        node = tree.cut(cp)
        cells = trees.confusion(node, tree.labels, df, "y").collect()
        assert sum(r.n for r in cells) == sum(r[4] is not None for r in rows)
        assert sum(r.n for r in cells if r.actual != r.predicted) == trees.total(node, 0.0)
    assert tree.cut(2.0).left is None and tree.cut(0.0).leaves() >= tree.cut(0.01).leaves() >= 3
    best = trees.chosen(tree, table)
    right = sum(r.n for r in trees.confusion(best, tree.labels, df, "y").collect() if r.actual == r.predicted)
    assert right >= max(sum(r[4] == v for r in rows) for v in ("yes", "no"))


def test_alphas_are_the_weakest_links():
    from quarry.operators import trees

    leaf = lambda *c: trees.Node([float(x) for x in c])
    deep = trees.Node([20.0, 30.0], None, leaf(20, 10), leaf(0, 20))
    root = trees.Node([60.0, 40.0], None, trees.Node([40.0, 10.0], None, leaf(38, 2), leaf(2, 8)), deep)
    # the right split saves 10 of 20 errors, the left one 6 of 10, and the root then nothing that is left
    steps = trees.alphas(root)
    assert steps[0] == 0.0 and steps == sorted(steps)
    assert trees.pruned(root, 5.9).leaves() == 4 and trees.pruned(root, 6.1).leaves() == 3 and trees.pruned(root, 100.0).left is None


def test_regression_against_numpy(spark):
    """Coefficients, errors and R2 as by a direct fit; a doubled column is an alias, rows with nulls take no part."""
    import numpy as np

    from quarry.operators import regression

    rng = np.random.default_rng(2)
    a, b, t = rng.normal(1500, 80, 300), rng.random(300) < 0.4, rng.choice(["low", "mid", "top"], 300)
    y = 3.0 + 0.02 * a - 1.5 * b + 2.0 * (t == "top") + rng.normal(0, 1, 300)
    rows = [(float(a[i]), float(2 * a[i]), bool(b[i]), str(t[i]), float(y[i])) for i in range(300)] + [(None, 1.0, True, "low", 1.0), (1.0, 2.0, True, "mid", None)]
    got = {r.term: r for r in regression.least_squares(spark.createDataFrame(rows, "a double, a2 double, b boolean, t string, y double"), "y", ["a", "b", "t", "a2"]).collect()}
    x = np.column_stack([np.ones(300), a, b, t == "mid", t == "top"]).astype(float)
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    errors = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / 295)
    for name, e, s in zip(("(intercept)", "a", "b", "t=mid", "t=top"), beta, errors, strict=True):
        assert (got[name].estimate, got[name].std_error) == (pytest.approx(e, abs=2e-6), pytest.approx(s, abs=2e-6))
    assert got["a2"].estimate is None and got["(n)"].estimate == 300 and got["(df)"].estimate == 295
    assert got["(r2)"].estimate == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum(), abs=2e-6)
    # fixed values of Student's t: two-sided tails
    assert regression.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and regression.t_two_sided(0.0, 7) == 1.0
    assert regression.t_two_sided(12.706205, 1) == pytest.approx(0.05, abs=1e-6) and regression.t_two_sided(1.959964, 10 ** 7) == pytest.approx(0.05, abs=1e-6)


def test_forest_beats_class_balance(spark, sf_small):
    from quarry.catalog.learning import MATCH_FEATURES, _split
    from quarry.operators import ml
    from quarry.sources import fixtures as fx

    train, test = _split(spark, sf_small, MATCH_FEATURES)
    model = ml.fit_forest(train)
    acc = ml._accuracy(model.transform(test))
    shares = ml.confusion(model.transform(test))
    assert shares.count() >= 2
    base = fx.matches(spark, sf_small).groupBy("winner").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert acc > base


def test_folds_are_stratified_and_repeatable(spark, sf_small):
    from quarry.catalog import learning
    from quarry.operators import ml
    from quarry.sources import fixtures as fx

    m = fx.matches(spark, sf_small)
    folds = ml.stratified_folds(m, "winner", learning.MATCH_KEYS, 5)
    per = {}
    for r in folds.groupBy("winner", "fold").count().collect():
        per.setdefault(r.winner, []).append(r["count"])
    assert all(len(n) == 5 and max(n) - min(n) <= 1 for n in per.values())
    key = lambda df: sorted(map(tuple, df.select(*learning.MATCH_KEYS, "fold").collect()))
    assert key(folds) == key(ml.stratified_folds(m.repartition(7), "winner", learning.MATCH_KEYS, 5))
    train, test = ml.train_test(m, learning.MATCH_KEYS)
    again, _ = ml.train_test(m.repartition(5), learning.MATCH_KEYS)
    assert train.count() + test.count() == m.count() and train.exceptAll(again).isEmpty() and 0.7 < train.count() / m.count() < 0.8


def test_early_stopping_and_drawn_sets(spark, sf_small):
    from quarry.catalog import learning
    from quarry.operators import ml

    assert ml.stopped([5.0, 4.0, 3.0, 3.5, 3.4, 3.3], 3) == (2, 6) and ml.stopped([5.0, 4.0, 4.1, 4.2, 1.0], 2) == (1, 4)
    assert ml.stopped([3.0, 2.0, 1.0], 50) == (2, 3)
    curve = ml.cross_validated_logloss(learning._folded(spark, sf_small, 3), rounds=6, step=0.1, parallelism=3).collect()
    assert [r.round for r in curve] == list(range(1, 7)) and [r.is_best for r in curve].count(True) == 1
    assert curve[-1].mean_logloss < curve[0].mean_logloss < 0.7
    found = ml.random_search(learning._folded(spark, sf_small, 2), draws=2, rounds=2).collect()
    sets = ml.drawn(2)
    assert [(r.step_size, r.max_depth, r.subsampling_rate) for r in found] == [(s["stepSize"], s["maxDepth"], s["subsamplingRate"]) for s in sets]
    assert sum(r.is_best for r in found) == 1 and {s["maxDepth"] for s in ml.drawn(200)} == set(range(2, 12))
