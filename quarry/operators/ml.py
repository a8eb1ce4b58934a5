"""Supervised learning with ``pyspark.ml``.

All training is distributed: MLlib, or for boosted trees on many rows
``boosting`` (split statistics are summed per partition; no pandas/scikit-learn on the driver). Outputs are small
DataFrames of metrics, importances and matrices. Tree learners use the
session checkpoint folder (``spark.checkpoint.dir``) through
``checkpointInterval`` so long boosting runs cut their lineage and survive
executor loss.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import boosting
from quarry.plans.prefix import keyed_running
from quarry.session import ensure_checkpoint_dir
from quarry.sources.files import drop_table, materialize, scratch_path

SEED = 42
DIGITS = 6
#: Rows that one task of a fit takes: at least (few rows stay as they lie) and at most.
TASK_ROWS = (25_000, 1_000_000)
#: Rows times trees of one forest fit: its memory holds a count and a node per row and tree.
FOREST_CELLS = 400_000_000
#: Rows of all fits that run side by side: beyond them each fit takes all cores by itself, so memory holds the rows once.
SIDE_ROWS = 4_000_000
#: Rows from which boosted trees are fitted on packed rows (``boosting``); fewer go to the learner of ``pyspark.ml``.
PACKED_ROWS = 100_000
#: Tasks that Spark cuts a scan into, at least.
SCAN_TASKS = "spark.sql.files.minPartitionNum"


def _r(c):
    return F.round(c, DIGITS)


# ------------------------------------------------------------------ K1, K2
def train_test(df: DataFrame, keys: Sequence[str], share: float = 0.75, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """K1: seeded split by a hash of each row's ``keys`` (75/25 by default): the same rows under any partitioning.

    Rows that agree in all keys fall on the same side.
    """
    part = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where(part), df.where(~part)


def season_split(df: DataFrame, season_col: str, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """K1: time split - train on (first, last], test after ``last``."""
    s = F.col(season_col)
    return df.where((s > first) & (s <= last)), df.where(s > last)


def assemble(df: DataFrame, features: Sequence[str], label: str, label_shift: int = 0,
             drop: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """K2: feature vector + numeric label (``label - shift``), id columns dropped."""
    x = df.drop(*drop).withColumn("label", (F.col(label) - label_shift).cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep") \
        .transform(x).select("features", "label", *keep)


def hash_folds(df: DataFrame, key_cols: Sequence[str], folds: int, seed: int = SEED) -> DataFrame:
    """Repeatable fold number from a hash of the row's key columns (same answer after any recomputation)."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed)), F.lit(folds)).cast("int"))


def _accuracy(pred: DataFrame) -> float:
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(pred)


# ------------------------------------------------------------------ K3, K4, K8
def importances(model, features: Sequence[str], spark, digits: int = 3) -> DataFrame:
    """K4: feature importances rounded and sorted (one row per feature)."""
    imp = model.featureImportances.toArray().tolist()
    rows = [(f, round(float(v), digits)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@contextmanager
def dealt(rows: DataFrame) -> Iterator[DataFrame]:
    """The rows of a fit, dealt evenly over its tasks and written once; the table goes when the fit has ended.

    A learner keeps the partitions of its input in all passes, so a source of one row group would leave
    every pass to one task. There are as many tasks as cores, more for very many rows.
    """
    spark = rows.sparkSession
    n, (least, most) = rows.count(), TASK_ROWS
    tasks = max(min(spark.sparkContext.defaultParallelism, n // least), -(-n // most))
    if tasks <= 1:
        yield rows
        return
    path, before = scratch_path(spark, "fit"), spark.conf.get(SCAN_TASKS, None)
    try:
        table = materialize(rows.repartition(tasks), path)
        spark.conf.set(SCAN_TASKS, str(tasks))  # a task reads one file; else small files are packed together
        yield table
    finally:
        spark.conf.unset(SCAN_TASKS) if before is None else spark.conf.set(SCAN_TASKS, before)
        drop_table(spark, path)


class Forest:
    """Forests that were fitted one after another, used as one: trees vote together and share the importances."""

    def __init__(self, parts: Sequence):
        self.parts = list(parts)

    @property
    def trees(self) -> list:
        return [t for p in self.parts for t in p.trees]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the learner's name
        total = sum(t.featureImportances.toArray() for t in self.trees)
        return DenseVector(total / total.sum() if total.sum() else total)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``prediction``: the class of the most votes; of equal ones the first."""
        out = rows
        for i, p in enumerate(self.parts):
            out = p.copy({p.rawPredictionCol: f"__raw{i}", p.probabilityCol: "", p.predictionCol: ""}).transform(out)
        raw = [vector_to_array(F.col(f"__raw{i}")) for i in range(len(self.parts))]
        votes = F.array(*[sum((r[k] for r in raw[1:]), raw[0][k]) for k in range(self.parts[0].numClasses)])
        return out.select(*rows.columns, (F.array_position(votes, F.array_max(votes)) - 1).cast("double").alias("prediction"))


def fit_forest(train: DataFrame, num_trees: int = 100, max_depth: int = 30, seed: int = SEED):
    """K3: random forest of 100 trees; 30 levels are the most that the learner grows, so data end its trees first.

    Many rows are fitted in several forests of fewer trees (``FOREST_CELLS``), each with a seed of its own.
    """
    ensure_checkpoint_dir(train.sparkSession)
    with dealt(train) as rows:
        fits = min(num_trees, max(1, -(-rows.count() * num_trees // FOREST_CELLS)))
        parts = [RandomForestClassifier(numTrees=num_trees * (i + 1) // fits - num_trees * i // fits, maxDepth=max_depth, seed=seed + 1000 * i,
                                        checkpointInterval=10, cacheNodeIds=True).fit(rows) for i in range(fits)]
    return parts[0] if fits == 1 else Forest(parts)


def fit_gbt(train: DataFrame, max_iter: int = 100, max_depth: int = 6, step: float = 0.3, seed: int = SEED):
    """K8: gradient-boosted trees classifier (binary) at the boosting library's default sizes: 100 rounds, depth 6, step 0.3."""
    ensure_checkpoint_dir(train.sparkSession)
    with dealt(train) as rows:
        if rows.count() < PACKED_ROWS:
            return _gbt(max_iter, max_depth, step, seed).fit(rows)
        with _packed(rows, classes=True) as held:
            grown, _ = boosting.boost(held, boosting.Fit([None], max_depth, step, seed=seed), max_iter)
        return boosting.BoostedClassifier(held.layout, [t for t, in grown], step)


@contextmanager
def _packed(rows: DataFrame, classes: bool) -> Iterator[boosting.Packed]:
    held = boosting.packed(rows, classes)
    try:
        yield held
    finally:
        held.blocks.unpersist()


def _gbt(max_iter: int = 100, max_depth: int = 6, step: float = 0.3, seed: int = SEED) -> GBTClassifier:
    return GBTClassifier(maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed, checkpointInterval=10)


def model_report(model, test: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """Accuracy + importances of a fitted tree model as rows (model, feature, importance, accuracy)."""
    acc = _accuracy(model.transform(test))
    imp = importances(model, features, test.sparkSession)
    return imp.select(F.lit(name).alias("model"), "feature", "importance", F.lit(round(acc, DIGITS)).alias("accuracy"))


# ------------------------------------------------------------------ K5
def confusion(pred: DataFrame) -> DataFrame:
    """K5: confusion matrix rows (label, prediction, n)."""
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "prediction")


def classification_report(pred: DataFrame) -> DataFrame:
    """K5: per-class precision, recall, F1 and support from the confusion counts (one aggregate)."""
    c = confusion(pred)
    n, hit = F.col("n"), F.col("label") == F.col("prediction")
    zero = F.lit(0).cast("long")
    parts = F.array(  # each cell counts toward its true class and its predicted class
        F.struct(F.col("label").alias("cls"), F.when(hit, n).otherwise(zero).alias("tp"), zero.alias("pred_n"),
                 n.alias("support")),
        F.struct(F.col("prediction").alias("cls"), zero.alias("tp"), n.alias("pred_n"), zero.alias("support")))
    agg = c.select(F.explode(parts).alias("p")).groupBy("p.cls").agg(
        F.sum("p.tp").alias("tp"), F.sum("p.pred_n").alias("pred_n"), F.sum("p.support").alias("support"))
    p = F.try_divide(F.col("tp").cast("double"), F.col("pred_n").cast("double"))
    r = F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double"))
    return agg.select(F.col("cls").alias("label"), _r(p).alias("precision"), _r(r).alias("recall"),
                      _r(F.try_divide(2 * p * r, p + r)).alias("f1"), "support").orderBy("label")


# ------------------------------------------------------------------ K7
def logistic_pipeline(train: DataFrame, test: DataFrame, max_iter: int = 1000) -> DataFrame:
    """K7: standardise + logistic regression; returns the hold-out accuracy."""
    pipe = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled"),
                            LogisticRegression(featuresCol="scaled", maxIter=max_iter)])
    acc = _accuracy(pipe.fit(train).transform(test))
    return train.sparkSession.createDataFrame([("logistic_regression", round(acc, DIGITS))], "model string, accuracy double")


# ------------------------------------------------------------------ K9
def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], folds: int, seed: int = SEED) -> DataFrame:
    """``fold`` 0..folds-1 by the rank of a hash of the keys within the class: every class is spread evenly, to one row."""
    drawn = df.withColumn("__draw", F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)))
    ranked = keyed_running(drawn, [label], ["__draw", *keys], {}, count_name="__rank")
    return ranked.withColumn("fold", F.pmod(F.col("__rank"), F.lit(folds)).cast("int")).drop("__draw", "__rank")


def fits_at_once(rows: DataFrame, parallelism: int) -> int:
    """How many fits on shares of ``rows`` run side by side: ``parallelism`` of small ones, fewer of large ones (``SIDE_ROWS``)."""
    return max(1, min(parallelism, SIDE_ROWS // max(1, rows.count())))


def _share(df: DataFrame, parallelism: int) -> DataFrame:
    """Rows of one of several fits that run side by side: together they fill the cores; a fit by itself keeps all its tasks."""
    if parallelism == 1:
        return df
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism // parallelism))


def _side_by_side(spark, work, items, parallelism: int) -> list:
    """``work`` of every item, several Spark fits at a time."""
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


def stopped(means: Sequence[float], patience: int) -> tuple[int, int]:
    """(best round, rounds looked at): the search ends when ``patience`` rounds in a row bring no smaller mean."""
    best = 0
    for i, m in enumerate(means):
        if m < means[best]:
            best = i
        if i - best >= patience:
            return best, i + 1
    return best, len(means)


def cross_validated_logloss(data: DataFrame, rounds: int = 1000, step: float = 0.01, max_depth: int = 4, patience: int = 50,
                            subsample: float = 0.8, columns: float = 0.8, seed: int = SEED, parallelism: int = 5) -> DataFrame:
    """K9: mean and spread of the held-out log loss over the folds (column ``fold``) after every round, with early stopping.

    The curve ends once ``patience`` rounds bring no smaller mean. Long searches, and those on many
    rows, are grown on packed rows, all folds in the same jobs; their held-out losses come with the
    rounds, so the search itself ends there. Others read a round's loss on the held-out fold by one
    pass over it for all rounds. The rows are written once and shared by the fits.
    """
    ensure_checkpoint_dir(data.sparkSession)
    with dealt(materialize(data)) as held:
        if rounds >= 10 * patience or held.count() >= PACKED_ROWS:
            curves = _packed_curves(held, rounds, step, max_depth, patience, subsample, columns, seed)
        else:
            curves = _curves(held, rounds, step, max_depth, subsample, columns, seed, fits_at_once(held, parallelism))
        return _logloss_curve(data.sparkSession, curves, patience)


def _fold_numbers(held: DataFrame) -> list[int]:
    return sorted(r.fold for r in held.select("fold").distinct().collect())


def _curves(held: DataFrame, rounds: int, step: float, max_depth: int, subsample: float, columns: float, seed: int,
            parallelism: int) -> list[list[float]]:
    """Held-out log loss after every round, a list a fold, by the learner of ``pyspark.ml``."""
    def curve(f: int) -> list[float]:
        gbt = GBTClassifier(maxIter=rounds, maxDepth=max_depth, stepSize=step, subsamplingRate=subsample,
                            featureSubsetStrategy=str(columns), seed=seed, checkpointInterval=10)
        model = gbt.fit(_share(held.where(F.col("fold") != f), parallelism))
        return [x / 2.0 for x in model.evaluateEachIteration(held.where(F.col("fold") == f))]  # the learner's loss is twice the log loss

    return _side_by_side(held.sparkSession, curve, _fold_numbers(held), parallelism)


def _packed_curves(held: DataFrame, rounds: int, step: float, max_depth: int, patience: int, subsample: float, columns: float,
                   seed: int) -> list[list[float]]:
    """:func:`_curves` on packed rows, up to the round that ends the search."""
    means = []

    def go_on(scores: list) -> bool:
        means.append(sum(loss / n for loss, n, _ in scores[-1]) / len(scores[-1]))
        best, looked = stopped(means, patience)
        return looked - 1 - best < patience

    with _packed(held, classes=True) as rows:
        fit = boosting.Fit(_fold_numbers(held), max_depth, step, subsample, columns, seed)
        _, scores = boosting.boost(rows, fit, rounds, go_on)
    return [[at[m][0] / at[m][1] for at in scores] for m in range(len(fit.folds))]


def _logloss_curve(spark, curves: list[list[float]], patience: int) -> DataFrame:
    means = [sum(c) / len(c) for c in zip(*curves, strict=True)]
    best, looked = stopped(means, patience)
    rows = []
    for i in range(looked):
        at = [c[i] for c in curves]
        spread = (sum((x - means[i]) ** 2 for x in at) / len(at)) ** 0.5
        rows.append((i + 1, round(means[i], DIGITS), round(spread, DIGITS), i == best))
    return spark.createDataFrame(rows, "round int, mean_logloss double, std_logloss double, is_best boolean")


def fold_accuracy(x: DataFrame, folds: int = 5, seed: int = SEED, parallelism: int = 5, **sizes) -> DataFrame:
    """K9: accuracy of each fold (column ``fold``) and their mean (fold -1) of boosted trees at the sizes of :func:`fit_gbt`."""
    spark = x.sparkSession
    ensure_checkpoint_dir(spark)
    with dealt(materialize(x)) as held:
        if held.count() >= PACKED_ROWS:
            at = _fold_accuracies(held, folds, seed, **sizes)
            df = spark.createDataFrame(at, "fold int, accuracy double")
            return df.unionByName(df.agg(F.lit(-1).alias("fold"), _r(F.avg("accuracy")).alias("accuracy")))
        side = fits_at_once(held, parallelism)

        def one(f: int):
            model = _gbt(seed=seed, **sizes).fit(_share(held.where(F.col("fold") != f), side))
            return f, round(_accuracy(model.transform(held.where(F.col("fold") == f))), DIGITS)

        df = spark.createDataFrame(_side_by_side(spark, one, range(folds), side), "fold int, accuracy double")
    return df.unionByName(df.agg(F.lit(-1).alias("fold"), _r(F.avg("accuracy")).alias("accuracy")))


def _fold_accuracies(held: DataFrame, folds: int, seed: int, max_iter: int = 100, max_depth: int = 6, step: float = 0.3) -> list[tuple[int, float]]:
    """(fold, accuracy) of models that grow side by side on packed rows."""
    with _packed(held, classes=True) as rows:
        _, scores = boosting.boost(rows, boosting.Fit(range(folds), max_depth, step, seed=seed), max_iter)
    return [(f, round(right / n if n else 0.0, DIGITS)) for f, (_, n, right) in enumerate(scores[-1])]


# ------------------------------------------------------------------ K10
# The search space.
SEARCH_SPACE = {
    "stepSize": [round(0.01 * i, 2) for i in range(1, 101)],
    "maxDepth": list(range(2, 12)),
    "subsamplingRate": [round(0.02 * i, 2) for i in range(1, 51)],
}


def drawn(draws: int, seed: int = SEED) -> list[dict]:
    """Random parameter sets over the whole space."""
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in SEARCH_SPACE.items()} for _ in range(draws)]


def random_search(data: DataFrame, draws: int = 5, rounds: int = 200, seed: int = SEED, parallelism: int = 4) -> DataFrame:
    """``draws`` random parameter sets, cross-validated (column ``fold``) boosted-tree regressors of ``rounds`` rounds, best RMSE.

    The assembled rows are written once with their folds; all (draw, fold) trials read them
    and run side by side (on many rows, packed, the folds of a draw). RMSE is the root of the mean of the folds' squared errors.
    """
    spark = data.sparkSession
    ensure_checkpoint_dir(spark)
    sets = drawn(draws, seed)
    with dealt(materialize(data)) as held:
        folds = _fold_numbers(held)
        if held.count() >= PACKED_ROWS:
            mse = _packed_errors(held, sets, folds, rounds, seed)
        else:
            mse = _errors(held, sets, folds, rounds, seed, fits_at_once(held, parallelism))
    rmse = [(sum(mse[i, f] for f in folds) / len(folds)) ** 0.5 for i in range(draws)]
    rows = [(i, float(p["stepSize"]), int(p["maxDepth"]), float(p["subsamplingRate"]), round(rmse[i], DIGITS), rmse[i] == min(rmse)) for i, p in enumerate(sets)]
    return spark.createDataFrame(rows, "draw int, step_size double, max_depth int, subsampling_rate double, rmse double, is_best boolean")


def _errors(held: DataFrame, sets: list[dict], folds: list[int], rounds: int, seed: int, side: int) -> dict:
    """Mean squared error of every (draw, fold), by the learner of ``pyspark.ml``."""
    def trial(at: tuple[int, int]) -> float:
        i, f = at
        reg = GBTRegressor(maxIter=rounds, seed=seed, checkpointInterval=10, **sets[i])
        model = reg.fit(_share(held.where(F.col("fold") != f), side))
        return RegressionEvaluator(metricName="mse").evaluate(model.transform(held.where(F.col("fold") == f)))

    trials = [(i, f) for i in range(len(sets)) for f in folds]
    return dict(zip(trials, _side_by_side(held.sparkSession, trial, trials, side), strict=True))


def _packed_errors(held: DataFrame, sets: list[dict], folds: list[int], rounds: int, seed: int) -> dict:
    """:func:`_errors` on packed rows: the folds of a draw grow side by side."""
    out = {}
    with _packed(held, classes=False) as rows:
        for i, p in enumerate(sets):
            fit = boosting.Fit(folds, p["maxDepth"], p["stepSize"], p["subsamplingRate"], seed=seed, classes=False)
            _, scores = boosting.boost(rows, fit, rounds)
            out.update({(i, f): loss / n for f, (loss, n, _) in zip(folds, scores[-1], strict=True)})
    return out
