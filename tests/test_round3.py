"""Findings of round 3: plans that must not grow with the square of the rows, whole work, bounded tasks."""

from pyspark.sql import functions as F

from quarry.operators import teamstats as ts


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_with_a_column_null_throughout_is_an_equi_join(spark):
    left = spark.createDataFrame([(1, "Over", 5), (2, None, 6), (2, None, 6)], "game_id long, result string, total int")
    right = spark.createDataFrame([(1, 7), (3, 8)], "game_id long, extra int").withColumn("result", F.lit(None).cast("string"))
    merged = ts.merge_exports(left, right)
    assert "NestedLoop" not in _plan(merged) and "Cartesian" not in _plan(merged)
    assert sorted(merged.select("game_id", "result", "total", "extra").collect(), key=str) == sorted(
        [(1, "Over", 5, None), (2, None, 6, None), (2, None, 6, None), (1, None, None, 7), (3, None, None, 8)], key=str)


def test_parts_of_ordered_scans_grow_in_number_not_in_size(spark, monkeypatch):
    from quarry.plans import prefix

    monkeypatch.setattr(prefix, "ROWS_PER_PART", 50)
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), "id", F.lit(1).alias("one"))
    done = prefix.ordered_parts(df, ["k", "id"])
    assert max(r["count"] for r in done.groupBy("__part").count().collect()) <= 150  # 500 with the session's 4 parts
    run = prefix.lagged(prefix.keyed_running(df, ["k"], ["id"], {"s": F.col("one")}, count_name="idx"), ["k"], "idx", {"p": ("id", 1)}, rows=2000)
    assert run.rdd.getNumPartitions() >= 40
    assert run.where("s <> idx OR idx <> floor(id / 3) + 1 OR NOT p <=> if(id < 3, null, id - 3)").count() == 0


def test_fill_from_peer_has_more_tasks_for_more_rows(spark, monkeypatch):
    from quarry.operators import cleaning
    from quarry.plans import prefix

    monkeypatch.setattr(prefix, "ROWS_PER_PART", 50)
    df = spark.range(2000).select("id", (F.col("id") % 500).cast("string").alias("k"), F.when(F.col("id") >= 1500, F.col("id").cast("string")).alias("v"))
    out = cleaning.fill_from_peer(df, "k", "v", "id")
    assert out.where("NOT v <=> CAST(id % 500 + 1500 AS STRING)").count() == 0 and out.count() == 2000
    assert out.where(F.spark_partition_id() > 3).count() > 1000  # 4 tasks by the session's setting


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    from quarry.llm import toxicity

    docs = spark.range(13_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert toxicity.labelled_texts(docs, labels, F.lit(True), "doc_id", "text", "toxic").count() == 13_000
    rows = [(f"{'vile' if i % 3 == 0 else 'kind'} word{i % 11} n{chr(97 + i % 26)}", int(i % 3 == 0)) for i in range(90)]
    sample = spark.createDataFrame(rows, "text string, toxic int")
    whole = toxicity.learn(sample)
    monkeypatch.setattr(toxicity, "MOST_COUNTED", 3)  # counts handed on many times sum to the same
    parts = toxicity.learn(sample)
    assert whole.precision == parts.precision and whole.restorer.tri == parts.restorer.tri
    assert any(e.startswith("vile") for e in whole.precision)


def _votes(spark, rows: int):
    """Rows of two numbers and a label that follows one of them, in one partition as a file of one row group gives them."""
    from quarry.operators import ml

    df = spark.range(rows).select((F.col("id") % 50).cast("double").alias("x"), F.pmod(F.hash("id"), F.lit(7)).cast("double").alias("z"),
                                  ((F.col("id") % 50 > 20) != (F.col("id") % 11 == 0)).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    return ml.assemble(df.coalesce(1), ["x", "z"], "y", keep=["fold"])


def test_fits_deal_their_rows_over_all_tasks(spark, monkeypatch):
    from quarry.operators import ml

    monkeypatch.setattr(ml, "TASK_ROWS", (100, 1000))
    one = _votes(spark, 3000)
    with ml.dealt(one) as rows:
        per = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert rows.rdd.getNumPartitions() == len(per) == 4 and max(per) - min(per) <= 4
        assert rows.exceptAll(one).isEmpty() and one.exceptAll(rows).isEmpty()
    seen = []
    fit = ml.RandomForestClassifier.fit
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    model = ml.fit_forest(one, num_trees=5, max_depth=4)
    assert seen == [4] and ml._accuracy(model.transform(one)) > 0.88
    monkeypatch.setattr(ml, "TASK_ROWS", (100, 300))  # more tasks than cores for many rows
    with ml.dealt(one) as rows:
        assert rows.rdd.getNumPartitions() == 10


def test_forest_of_many_rows_is_fitted_in_parts(spark, monkeypatch):
    from quarry.operators import ml

    rows = _votes(spark, 2000)
    whole = ml.fit_forest(rows, num_trees=20, max_depth=5)
    monkeypatch.setattr(ml, "FOREST_CELLS", 2000 * 7)
    parts = ml.fit_forest(rows, num_trees=20, max_depth=5)
    assert [p.getNumTrees for p in parts.parts] == [6, 7, 7] and len({str(t.toDebugString) for t in parts.trees}) > 7
    assert abs(parts.featureImportances.toArray() - whole.featureImportances.toArray()).max() < 0.1
    assert abs(parts.featureImportances.toArray().sum() - 1) < 1e-9
    assert abs(ml._accuracy(parts.transform(rows)) - ml._accuracy(whole.transform(rows))) < 0.02
    same = ml.Forest([whole, whole]).transform(rows).withColumnRenamed("prediction", "twice")
    pairs = whole.transform(rows).select("features", "prediction").distinct().join(same.select("features", "twice").distinct(), "features")
    assert pairs.count() > 0 and pairs.where("prediction <> twice").count() == 0


def test_large_fits_run_one_by_one_on_all_tasks(spark, monkeypatch):
    from quarry.operators import ml

    monkeypatch.setattr(ml, "TASK_ROWS", (100, 10_000))
    rows = _votes(spark, 3000)
    side_by_side = ml.fold_accuracy(rows, folds=3, max_iter=3).collect()
    seen = []
    monkeypatch.setattr(ml, "_side_by_side", lambda s, work, items, parallelism: seen.append(parallelism) or [work(i) for i in items])
    share = ml._share
    monkeypatch.setattr(ml, "_share", lambda df, side: seen.append(share(df, side).rdd.getNumPartitions()) or share(df, side))
    monkeypatch.setattr(ml, "SIDE_ROWS", 3000)
    assert ml.fold_accuracy(rows, folds=3, max_iter=3).collect() == side_by_side  # without sampling, the models are the same
    assert seen == [1, 4, 4, 4]
    seen.clear()
    assert len(ml.cross_validated_logloss(rows, rounds=2).collect()) == 2 and seen == [1, 4, 4, 4]
    seen.clear()
    assert len(ml.random_search(rows, draws=1, rounds=1).collect()) == 1 and seen == [1, 4, 4, 4]


def test_large_tree_folds_run_one_by_one_on_all_tasks(spark, monkeypatch):
    from quarry.operators import ml, trees

    df = spark.range(2000).select("id", (F.col("id") % 40).cast("double").alias("x"),
                                  F.when((F.col("id") % 40 > 12) != (F.col("id") % 9 == 0), "yes").otherwise("no").alias("y")).coalesce(1)
    _, before = trees.complexity_table(df, ["x"], "y", ["id"], folds=4)
    pools, tasks = [], []
    pool, grow = trees.ThreadPool, trees.grow
    monkeypatch.setattr(trees, "ThreadPool", lambda n: pools.append(n) or pool(n))
    monkeypatch.setattr(trees, "grow", lambda rows, *a: tasks.append(rows.rdd.getNumPartitions()) or grow(rows, *a))
    monkeypatch.setattr(ml, "TASK_ROWS", (100, 10_000))
    monkeypatch.setattr(ml, "SIDE_ROWS", 2000)
    _, table = trees.complexity_table(df, ["x"], "y", ["id"], folds=4)
    assert pools == [1] and tasks == [4] * 5
    assert table.collect() == before.collect()  # few distinct values: all are split points under any dealing


def test_texts_without_a_label_are_not_shuffled(spark):
    from quarry.llm import toxicity

    docs = spark.range(4000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("de").alias("lang"))
    docs = docs.unionByName(docs.where("doc_id = 7"))
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(1, 41), 5, 9999]] + [(None, 1), (50, None)], "doc_id long, toxic int")
    known = labels.where("toxic IS NOT NULL").select(F.col("doc_id").alias("known")).distinct()
    left = toxicity._perhaps_known(docs, known, "doc_id")
    assert left.columns == docs.columns and 41 <= left.count() <= 45 and left.where("doc_id <= 40").count() == 41
    want = sorted([(f"text {i}", i % 2) for i in range(1, 41)] + [("text 7", 1)])
    for change in ("long", "string", "int"):  # ids of two kinds are joined without the mask
        some = toxicity.labelled_texts(docs, labels.withColumn("doc_id", F.col("doc_id").cast(change)), F.lit(True), "doc_id", "text", "toxic")
        assert sorted(map(tuple, some.collect())) == want
