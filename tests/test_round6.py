"""Findings of round 4: boosted fits on many rows, and the whole search of the log loss."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F


def _matches(spark, rows: int, folds: int = 3):
    """Features of few values and ``c`` of many; the label follows some of them."""
    from quarry.operators import ml

    draw = lambda k, s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(k)).cast("double")
    df = spark.range(rows).select("id", draw(3, 1).alias("a"), draw(11, 2).alias("b"), (draw(1000, 3) / 7).alias("c"), draw(5, 4).alias("d"),
                                  draw(2, 5).alias("e"), draw(9, 6).alias("n"), (F.col("id") % folds).cast("int").alias("fold"))
    y = ((F.col("b") > 5) != (F.col("e") == 1)) | ((F.col("d") > 3) & (F.col("a") == 2))
    return ml.assemble(df.withColumn("y", (y != (F.col("n") == 4)).cast("int")), ["a", "b", "d", "e"], "y", keep=["c", "fold"])


@pytest.fixture
def packed(monkeypatch):
    """Small tables are taken for large ones: several tasks, several blocks a task, a job a level, checkpoints."""
    from quarry.operators import boosting, ml

    def large(block: int = 150):
        monkeypatch.setattr(ml, "TASK_ROWS", (400, 10_000))
        monkeypatch.setattr(ml, "PACKED_ROWS", 1000)
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
        monkeypatch.setattr(boosting, "CHECKPOINT_ROUNDS", 2)
        for learner in (ml.GBTClassifier, ml.GBTRegressor):
            monkeypatch.setattr(learner, "fit", lambda self, df: pytest.fail("many rows went to the learner that walks rows one by one"))

    return large


def test_packed_classifier_is_the_learners(spark, packed):
    from quarry.operators import ml

    rows = _matches(spark, 2400)
    want = ml.fit_gbt(rows, max_iter=5, max_depth=4)
    was = [r.prediction for r in want.transform(rows).orderBy("c", "fold").collect()]
    packed()
    got = ml.fit_gbt(rows, max_iter=5, max_depth=4)
    assert [r.prediction for r in got.transform(rows).orderBy("c", "fold").collect()] == was and len(got.trees) == 5
    assert abs(got.featureImportances.toArray() - want.featureImportances.toArray()).max() < 1e-6
    deep = ml.fit_gbt(rows, max_iter=1, max_depth=9)  # below the levels of one look-up
    assert ml._accuracy(deep.transform(rows)) >= ml._accuracy(got.transform(rows)) - 0.02


@pytest.mark.parametrize("block", [150, 1_000_000])
def test_packed_folds_are_the_learners(spark, packed, monkeypatch, block):
    from quarry.operators import ml

    rows = _matches(spark, 2400)
    sets = [{"stepSize": 0.3, "maxDepth": 3, "subsamplingRate": 1.0}, {"stepSize": 0.9, "maxDepth": 7, "subsamplingRate": 1.0}]
    monkeypatch.setattr(ml, "drawn", lambda draws, seed: sets)
    accuracy = ml.fold_accuracy(rows, folds=3, max_iter=4, max_depth=5).collect()
    search = ml.random_search(rows, draws=2, rounds=3).collect()
    curve = ml.cross_validated_logloss(rows, rounds=5, step=0.1, subsample=1.0, columns=1.0).collect()
    packed(block)
    assert ml.fold_accuracy(rows, folds=3, max_iter=4, max_depth=5).collect() == accuracy
    assert [(r.rmse, r.is_best) for r in ml.random_search(rows, draws=2, rounds=3).collect()] == [(pytest.approx(r.rmse, abs=2e-6), r.is_best) for r in search]
    now = ml.cross_validated_logloss(rows, rounds=5, step=0.1, subsample=1.0, columns=1.0).collect()
    assert [(r.round, r.mean_logloss, r.std_logloss, r.is_best) for r in now] == \
        [(r.round, pytest.approx(r.mean_logloss, abs=2e-6), pytest.approx(r.std_logloss, abs=2e-6), r.is_best) for r in curve]


def test_packed_rows_hold_every_row_and_do_not_depend_on_tasks(spark, packed):
    """Features of many values are cut evenly, rows and columns are drawn, and labels or features that are missing are refused."""
    from pyspark.ml.feature import VectorAssembler

    from quarry.operators import boosting, ml

    rows = _matches(spark, 2400).select("c", "label", "fold", "features")
    packed()
    wide = VectorAssembler(inputCols=["c", "features"], outputCol="x", handleInvalid="keep").transform(rows).select(F.col("x").alias("features"), "label", "fold")
    held = boosting.packed(wide, classes=True)
    assert held.count == sum(len(b[2]) for b in held.blocks.collect()) == 2400
    assert 25 <= held.layout.cards[0] <= boosting.BINS and held.layout.cards[1:] == [3, 11, 5, 2]
    fit = boosting.Fit([0, 1, 2], 4, 0.3)
    assert [s[1] for s in boosting.boost(held, fit, 1)[1][0]] == [800] * 3
    held = boosting.packed(rows, classes=True)
    a = boosting.boost(held, fit, 3)[1]
    b = boosting.boost(boosting.packed(rows.repartition(7), classes=True), fit, 3)[1]
    assert [[s[1:] for s in x] for x in a] == [[s[1:] for s in x] for x in b]
    assert np.allclose([[s[0] for s in x] for x in a], [[s[0] for s in x] for x in b], rtol=1e-12)
    some = boosting.boost(held, boosting.Fit([0, 1, 2], 4, 0.3, 0.5, 0.5, 7), 3)[1]
    assert some != a and all(n == 800 and right > 500 for _, n, right in some[-1])
    with pytest.raises(ValueError, match="null"):
        boosting.packed(wide.withColumn("label", F.when(F.col("label") == 0, 0.0)), classes=True)
    with pytest.raises(ValueError, match="null"):
        ml.fit_gbt(VectorAssembler(inputCols=["c"], outputCol="v", handleInvalid="keep").transform(rows.withColumn("c", F.when(F.col("c") > 1, F.col("c"))))
                   .select(F.col("v").alias("features"), "label"), max_iter=1)


def test_log_loss_query_searches_all_rounds(spark, monkeypatch):
    from quarry.catalog import learning
    from quarry.operators import ml

    whole = inspect.signature(ml.cross_validated_logloss)
    asked = []
    monkeypatch.setattr(learning, "_folded", lambda spark, sf, folds: None)
    monkeypatch.setattr(ml, "cross_validated_logloss", lambda *args, **sizes: asked.append(whole.bind(*args, **sizes)))
    learning.k9_cv_logloss(spark, "")
    asked[0].apply_defaults()
    assert asked[0].arguments["rounds"] == 1000 and asked[0].arguments["step"] == 0.01 and asked[0].arguments["patience"] == 50


@pytest.mark.parametrize("block", [150, 1_000_000])
def test_long_search_ends_where_no_round_helps(spark, packed, block):
    from quarry.operators import ml

    rows = _matches(spark, 1200)
    packed(block)
    curve = ml.cross_validated_logloss(rows, rounds=60, step=0.9, max_depth=6, patience=3).collect()
    best = [r.round for r in curve if r.is_best]
    assert len(curve) < 60 and best == [len(curve) - 3]
    assert curve[best[0] - 1].mean_logloss == min(r.mean_logloss for r in curve)
