"""Forests grown on grouped rows: the library's trees where nothing is drawn, the same draws however the rows come, saved and scored whole."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from cohort.operators import forest, models
from cohort.operators.forest import GroupedForest, GroupedForestModel

COLUMNS = ["many", "few", "flag", "fixed"]


@pytest.fixture(scope="module")
def rows(spark):
    """1,800 rows: a column with more values than bins, a constant one, equal rows with other labels."""
    rnd = random.Random(3)
    made = []
    for _ in range(900):
        many, few, flag = round(rnd.gauss(0, 3), 1), float(rnd.randrange(6)), float(rnd.random() < 0.2)
        for _ in range(2):
            made.append((many, few, flag, 1.0, float(rnd.random() < 1 / (1 + np.exp(many / 2 - flag))), float(round(many * few + rnd.gauss(0, 2)))))
    df = spark.createDataFrame(made, "many double, few double, flag double, fixed double, label double, score double")
    df = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(df).withColumn("count", F.lit(1)).persist()
    assert df.select("many").distinct().count() > forest.MOST_BINS + 1
    return df


def test_a_tree_without_draws_is_the_librarys(rows):
    theirs = RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=30, minInstancesPerNode=2, seed=1).fit(rows)
    mine = GroupedForest(classes=2, trees=1, depth=30, least=2, bootstrap=False).fit(rows)
    assert len(mine.trees[0][0]) == theirs.totalNumNodes > 100
    for a, b in zip(theirs.transform(rows).collect(), mine.transform(rows).collect()):
        assert b.probability.toArray() == pytest.approx(a.probability.toArray(), abs=1e-12) and a.prediction == b.prediction
        assert b.rawPrediction.toArray() == pytest.approx(a.rawPrediction.toArray(), abs=1e-12)


@pytest.mark.parametrize(("depth", "least"), [(30, 1), (4, 5)])
def test_a_regression_tree_without_draws_is_the_librarys(rows, depth, least):
    theirs = RandomForestRegressor(labelCol="score", numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=depth, minInstancesPerNode=least, seed=1).fit(rows)
    mine = GroupedForest(label="score", trees=1, depth=depth, least=least, bootstrap=False).fit(rows)
    assert len(mine.trees[0][0]) == theirs.totalNumNodes
    assert [r.prediction for r in mine.transform(rows).collect()] == pytest.approx([r.prediction for r in theirs.transform(rows).collect()], abs=1e-9)


def test_a_whole_forest_predicts_like_the_librarys(rows):
    theirs = RandomForestClassifier(numTrees=200, featureSubsetStrategy="sqrt", maxDepth=30, minInstancesPerNode=2, seed=5).fit(rows)
    mine = GroupedForest(classes=2, trees=200, depth=30, least=2, seed=5).fit(rows)
    assert sum(len(t[0]) for t in mine.trees) == pytest.approx(theirs.totalNumNodes, rel=0.05)
    a, b = (np.array([r.probability[1] for r in m.transform(rows).collect()]) for m in (theirs, mine))
    assert np.corrcoef(a, b)[0, 1] > 0.99 and abs(a - b).mean() < 0.03


def test_draws_depend_on_the_seed_and_not_on_how_rows_come(rows):
    def sums(df, seed=4):
        return GroupedForest(classes=2, trees=5, depth=30, least=2, seed=seed).fit(df).transform(rows).select("rawPrediction").collect()

    grouped = rows.groupBy("features", "label").agg(F.count(F.lit(1)).alias("count"))
    assert sums(rows) == sums(rows.repartition(7)) == sums(grouped) != sums(rows, seed=6)


def test_a_grown_forest_is_saved_with_its_pipeline(rows, tmp_path):
    model = Pipeline(stages=[GroupedForest(classes=2, trees=3, depth=5)]).fit(rows)
    models.save_model(model, str(tmp_path / "m"))
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert isinstance(again, PipelineModel) and again.transform(rows).collect() == model.transform(rows).collect()


def test_many_features_and_forgotten_rows_are_scored_alike(spark, rows, monkeypatch):
    wide = VectorAssembler(inputCols=["features"] * 16, outputCol="w").transform(rows.select("features", "label", "count")).drop("features").withColumnRenamed("w", "features")
    model = GroupedForest(classes=2, trees=2, depth=6).fit(wide)  # too many bins for one number
    assert forest.packed(np.zeros((1, 64), np.uint8), [np.array(c) for c in model.getOrDefault("cuts")]) is None
    got = [r.prediction for r in model.transform(wide).collect()]
    assert len(got) == 1800 and set(got) == {0.0, 1.0}
    small = GroupedForest(classes=2, trees=4, depth=8).fit(rows)
    monkeypatch.setattr(forest, "REMEMBERED", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        whole = small.transform(rows).select("rawPrediction").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cuts = [np.array(c) for c in small.getOrDefault("cuts")]
    x = forest.binned(np.array([r.features.toArray() for r in rows.collect()]), cuts)
    assert [r.rawPrediction[1] for r in whole] == pytest.approx(forest.walk(forest.paths(small.trees), x)[:, 0].tolist())


def test_a_fit_of_many_rows_is_grown_on_the_distinct_ones(spark, monkeypatch):
    rows = spark.range(9000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"), (F.col("id") % 3).cast("string").alias("t"), (F.col("id") % 2).cast("double").alias(models.LABEL))
    seen, real = [], GroupedForest._fit
    monkeypatch.setattr(GroupedForest, "_fit", lambda self, df: (seen.append(df.agg(F.count(F.lit(1)), F.sum(models.COUNT)).first()), real(self, df))[1])
    model = models.fit(rows, "forest", ["x", "t"], trees=2, forest_depth=3)
    assert seen == [(42, 9000)] and isinstance(model.stages[-1], GroupedForestModel)
    fitted, pred, scores = models.train_forest_regressor(rows.withColumn("y", F.col("x") * 2.0), ["x", "t"], "y", "k", trees=20)
    assert len(seen) == 2 and len(fitted.stages[-1].trees) == 20 and scores["r2"] > 0.9 and pred.count() > 2000
    monkeypatch.setattr(models, "FOREST_CELLS", 100)  # too many distinct rows for a task: the library's forest
    assert isinstance(models.fit(rows, "forest", ["x", "t"], trees=2, forest_depth=3).stages[-1], RandomForestClassificationModel)


def test_distinct_rows_are_scored_once_and_every_row_comes_back(spark, monkeypatch):
    values = [(i, x, t) for i, (x, t) in enumerate([(1.0, "a"), (2.0, "b"), (None, "a"), (float("nan"), None), (0.0, "a"), (-0.0, "a"), (1.0, None)] * 40)]
    rows = spark.createDataFrame(values + values[:5], "k int, x double, t string").withColumn(models.LABEL, (F.col("k") % 2).cast("double"))
    model = models.fit(rows, "tree", ["x", "t"])
    want = sorted((r.k, r.prediction) for r in model.transform(rows).collect())
    seen, real = [], model.transform
    monkeypatch.setattr(model, "transform", lambda df: (seen.append(df.count()), real(df))[1])
    out = models.scored_once(model, rows, ["x", "t"])
    assert out.columns == [*rows.columns, "prediction"] and sorted((r.k, r.prediction) for r in out.collect()) == want
    assert seen == [6]


def test_models_of_a_training_share_folds_and_donors(spark, monkeypatch):
    rows = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"), (F.col("id") % 5).alias("z"))
    target = F.when((F.col("x") + F.col("z")) % 3 > 0, "Pass").otherwise("Fail")
    seen = []
    for name in ("fold_assignment", "fit_leave_out", "previous_rows"):
        monkeypatch.setattr(models, name, lambda *a, _f=getattr(models, name), _n=name, **k: (seen.append(_n), _f(*a, **k))[1])
    out = models.train_all(rows, target, ["x", "z"], "k", kinds=("tree", "logistic"))
    assert sorted(seen) == ["fit_leave_out"] * 2 + ["fold_assignment"] * 2 + ["previous_rows"]
    data = models.labelled(rows, target, ["x", "z"], "k")
    parts = models.stratified_split(data, models.LABEL, F.col("k"), 0.3, 42)
    train, test = (parts.where(F.col("is_test") == t).drop("is_test") for t in (False, True))
    model = models.calibrate_sigmoid(train, "tree", ["x", "z"], "k")
    one = {r.feature: r.importance for r in models.permutation_importance(model, test, ["x", "z"], "k").collect()}
    assert {r.feature: r.importance for r in out["importance"].where("model = 'Decision Tree Classifier'").collect()} == pytest.approx(one, abs=1e-9)
