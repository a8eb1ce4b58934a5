"""Classification trees with cost-complexity pruning and cross-validation.

Spark grows the trees (split statistics are aggregated per task). A grown tree has at
most 2^depth nodes, so pruning works on its node table on the driver; predictions of
a pruned tree are a column expression, so scoring is a projection and the errors of a
whole sequence of subtrees come from ONE aggregate over the held-out rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ml import dealt, fits_at_once
from quarry.session import ensure_checkpoint_dir
from quarry.sources.files import drop_table, materialize, scratch_path

# A split must be worth this share of the root's errors; node sizes; folds.
CP, MIN_SPLIT_ROWS, MIN_LEAF_ROWS, FOLDS = 0.01, 20, 7, 10
#: Depth to which trees are grown before they are pruned.
GROW_DEPTH = 10
#: Stands for a missing number while a tree is grown: larger than all others.
MISSING = 1e300


@dataclass
class Node:
    """A node with its training counts per class; ``goes_left`` tells the rows of the left child."""

    counts: list[float]
    goes_left: Column | None = None
    left: Node | None = None
    right: Node | None = None
    rule: str = ""
    weakest: float = field(default=math.inf)

    @property
    def errors(self) -> float:
        return sum(self.counts) - max(self.counts)

    @property
    def best(self) -> int:
        return self.counts.index(max(self.counts))

    def leaves(self) -> int:
        return 1 if self.left is None else self.left.leaves() + self.right.leaves()


def pruned(node: Node, alpha: float) -> Node:
    """The smallest subtree of least errors + alpha x leaves; small nodes are not split."""
    if node.left is None or sum(node.counts) < MIN_SPLIT_ROWS:
        return Node(node.counts)
    left, right = pruned(node.left, alpha), pruned(node.right, alpha)
    below = total(left, alpha) + total(right, alpha)
    if node.errors + alpha <= below + 1e-9:
        return Node(node.counts)
    return Node(node.counts, node.goes_left, left, right, node.rule)


def total(node: Node, alpha: float) -> float:
    """Errors of the subtree plus alpha per leaf."""
    return node.errors + alpha if node.left is None else total(node.left, alpha) + total(node.right, alpha)


def alphas(root: Node) -> list[float]:
    """Ascending values at which the best subtree changes, from 0 (the whole tree) to the root alone."""
    out, now = [0.0], pruned(root, 0.0)
    while now.left is not None:
        links: list[float] = []

        def links_of(node: Node) -> tuple[float, int]:
            if node.left is None:
                return node.errors, 1
            (e, n), (f, m) = links_of(node.left), links_of(node.right)
            links.append((node.errors - e - f) / (n + m - 1))  # noqa: B023
            return e + f, n + m

        links_of(now)
        out.append(max(min(links), out[-1]))
        smaller = pruned(root, out[-1])
        now = smaller if smaller.leaves() < now.leaves() else Node(root.counts)
    return out


def predicted(node: Node, labels: Sequence[str]) -> Column:
    """The class of each row as nested conditions."""
    if node.left is None:
        return F.lit(labels[node.best])
    return F.when(node.goes_left, predicted(node.left, labels)).otherwise(predicted(node.right, labels))


@dataclass
class Tree:
    root: Node
    labels: list[str]

    def cut(self, cp: float) -> Node:
        """The subtree whose every split is worth ``cp`` times the root's errors."""
        return pruned(self.root, cp * self.root.errors)


def grow(train: DataFrame, features: Sequence[str], label: str, max_depth: int = GROW_DEPTH) -> Tree:
    """A Gini tree on numeric, boolean and text features.

    Rows without a label take no part. A null number counts as larger than all others
    (it follows the right branch), a null or unseen text as a value of its own.
    """
    spark = train.sparkSession
    kinds = dict(train.dtypes)
    texts = [f for f in features if kinds[f] == "string"]
    rows = train.where(F.col(label).isNotNull()).select(label, *[F.col(f) if f in texts else F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(MISSING)), F.lit(MISSING)).alias(f)
                                                                for f in features])
    index = [StringIndexer(inputCol=f, outputCol=f"{f}__i", handleInvalid="keep") for f in texts]
    names = [f"{f}__i" if f in texts else f for f in features]
    pipe = Pipeline(stages=[*index, StringIndexer(inputCol=label, outputCol="__y"), VectorAssembler(inputCols=names, outputCol="__x"),
                            DecisionTreeClassifier(labelCol="__y", featuresCol="__x", maxDepth=max_depth, minInstancesPerNode=MIN_LEAF_ROWS, maxBins=64, seed=42)])
    model = pipe.fit(rows)
    labels = list(model.stages[len(texts)].labels)
    values = {f"{f}__i": list(s.labels) for f, s in zip(texts, model.stages[:len(texts)], strict=True)}
    path = scratch_path(spark, "tree")
    model.stages[-1].write().overwrite().save(path)
    held = {r.id: r for r in spark.read.parquet(f"{path}/data").collect()}  # at most 2^depth rows
    drop_table(spark, path)

    def node(i: int) -> Node:
        r = held[i]
        at = Node(list(r.impurityStats))
        if r.leftChild >= 0:
            name, f = names[r.split.featureIndex], features[r.split.featureIndex]
            if name in values:
                left = [values[name][int(c)] for c in r.split.leftCategoriesOrThreshold if int(c) < len(values[name])]
                unseen = any(int(c) >= len(values[name]) for c in r.split.leftCategoriesOrThreshold)
                known = F.col(f).isin(values[name])
                at.goes_left = F.coalesce(F.col(f).isin(left) if left else F.lit(False), F.lit(False)) | (F.lit(unseen) & ~F.coalesce(known, F.lit(False)))
                at.rule = f"{f} in {sorted(left)}"
            else:
                at.goes_left = F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(MISSING)) <= r.split.leftCategoriesOrThreshold[0], F.lit(False))
                at.rule = f"{f} <= {r.split.leftCategoriesOrThreshold[0]:.6g}"
            at.left, at.right = node(r.leftChild), node(r.rightChild)
        return at

    return Tree(node(0), labels)


def confusion(tree: Node, labels: Sequence[str], test: DataFrame, label: str) -> DataFrame:
    """(actual, predicted, n) over the test rows that have a label."""
    return test.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("actual"), predicted(tree, labels).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n")).orderBy("actual", "predicted")


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], folds: int, seed: int = 42) -> DataFrame:
    """``fold`` 0..folds-1, drawn from a hash of the keys and turned per class, so classes spread evenly and any plan gives the same folds."""
    turn = F.pmod(F.xxhash64(F.col(label)), F.lit(folds))
    return df.withColumn("fold", F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)) + turn, F.lit(folds)).cast("int"))


def complexity_table(train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], cp: float = CP, folds: int = FOLDS,
                     parallelism: int = 4) -> tuple[Tree, DataFrame]:
    """The tree on all rows and, per subtree down to ``cp``: cp, n_split, rel_error, x_error and x_std (shares of the root's errors).

    Each fold's tree is grown on the other folds; its subtrees at the geometric means of
    neighbouring cp values are scored on the fold by one aggregate. The rows are written
    once and shared by all fits, which run side by side while their rows are few.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "folds")
    rows = materialize(stratified_folds(train.where(F.col(label).isNotNull()).select(label, *dict.fromkeys([*features, *keys])), label, keys, folds), path)
    with dealt(rows) as even:
        found = _cross_validated(even, features, label, cp, folds, fits_at_once(even, parallelism))
    drop_table(spark, path)
    return found


def _cross_validated(rows: DataFrame, features: Sequence[str], label: str, cp: float, folds: int, parallelism: int) -> tuple[Tree, DataFrame]:
    spark = rows.sparkSession
    tree = grow(rows, features, label)
    root = tree.root.errors
    steps = sorted({a / root for a in alphas(tree.root)} if root else {0.0}, reverse=True)
    steps = [s for s in steps if s > cp] + [cp]
    # cp of the k-th subtree stands for all values from it up to the one before
    middles = [math.inf, *[math.sqrt(a * b) for a, b in zip(steps, steps[1:], strict=False)]]

    def fold(f: int):
        other = grow(rows.where(F.col("fold") != f), features, label)
        wrong = [F.sum((predicted(other.cut(m) if m < math.inf else Node(other.root.counts), other.labels) != F.col(label)).cast("long")).alias(f"e{i}")
                 for i, m in enumerate(middles)]
        return rows.where(F.col("fold") == f).agg(F.count(F.lit(1)).alias("n"), *wrong).first()

    with ThreadPool(parallelism) as pool:
        found = [r for r in pool.map(inheritable_thread_target(spark)(fold), range(folds)) if r.n]
    n, out = sum(r.n for r in found), []
    for i, step in enumerate(steps):
        sub = Node(tree.root.counts) if i == 0 else tree.cut(steps[i])
        wrong = sum(r[f"e{i}"] for r in found)
        share = wrong / root if root else 0.0
        spread = math.sqrt(wrong * (1 - wrong / n)) / root if root and n else 0.0
        out.append((round(step, 6), sub.leaves() - 1, round(total(sub, 0.0) / root, 6) if root else 0.0, round(share, 6), round(spread, 6)))
    return tree, spark.createDataFrame(out, "cp double, n_split int, rel_error double, x_error double, x_std double")


def chosen(tree: Tree, table: DataFrame) -> Node:
    """The subtree of least cross-validated error; of equal ones the smallest."""
    best = min(table.collect(), key=lambda r: (r.x_error, r.n_split))  # one row a subtree
    return Node(tree.root.counts) if best.n_split == 0 else tree.cut(best.cp)
