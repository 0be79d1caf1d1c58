"""Model sanity (probabilities, determinism, save/load) and plan checks (pruning, pushdown)."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split_docs(spark):
    from cohort.plans.model_queries import _train_test
    return _train_test(spark, SF)


def test_probabilities_and_determinism(spark, split_docs):
    from cohort.operators import models
    from cohort.plans.model_queries import FEATURES, KEY
    train, test = split_docs
    m1 = models.fit(train, "logistic", FEATURES)
    p1 = models.holdout_predictions(m1, test, KEY)
    rows = p1.collect()
    assert rows and all(0.0 <= r.p <= 1.0 for r in rows)
    m2 = models.fit(train, "logistic", FEATURES)
    p2 = {r[KEY]: r.p for r in models.holdout_predictions(m2, test, KEY).collect()}
    assert all(p2[r[KEY]] == pytest.approx(r.p, abs=1e-12) for r in rows)


def test_save_load_round_trip(spark, split_docs, tmp_path):
    from cohort.operators import models
    from cohort.plans.model_queries import FEATURES, KEY
    train, test = split_docs
    m = models.fit(train, "tree", FEATURES)
    path = str(tmp_path / "m")
    models.save_model(m, path)
    a = {r[KEY]: r.p for r in models.holdout_predictions(m, test, KEY).collect()}
    b = {r[KEY]: r.p for r in models.holdout_predictions(models.load_model(path), test, KEY).collect()}
    assert a == b
    with pytest.raises(FileNotFoundError):
        models.load_model(str(tmp_path / "missing"))


def test_split_is_stratified_and_disjoint(spark):
    from cohort.operators import split
    from cohort.plans.model_queries import _labelled, KEY
    data = _labelled(spark, SF)
    s = split.stratified_split(data, "label", F.col(KEY), 0.3)
    by = {(r.label, r.is_test): r["count"] for r in s.groupBy("label", "is_test").count().collect()}
    for cls in {k[0] for k in by}:
        n = by.get((cls, True), 0) + by.get((cls, False), 0)
        assert by.get((cls, True), 0) == min(max(int(n * 0.3 + 0.5), 1), n - 1)
    assert s.select(KEY).distinct().count() == s.count()


def test_scan_pruning_and_pushdown(spark):
    import __spark_entry__ as e
    plan = e.queries()["kpi_snapshot"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_tax" not in plan  # columns pruned at the scan
    assert "IsNotNull(l_orderkey)" in plan  # join-key filter pushed to parquet


def test_running_sums_have_no_window_and_no_single_task(spark):
    from cohort.operators.ordered import running_sums
    df = spark.range(0, 5000).select(F.col("id").cast("double").alias("k"), F.lit(1).alias("v"))
    plan = running_sums(df, "k", ["v"], buckets=8)._jdf.queryExecution().executedPlan().toString()
    # the ordered rows are read back; only the carries, one row a partition, are joined
    assert "SinglePartition" not in plan and "Window" not in plan and "rangepartitioning" not in plan
    assert plan.count("BroadcastExchange") <= 1 and "SortMergeJoin" not in plan


def test_leave_out_preparation_equals_a_fit_of_each_part(spark):
    import random
    import statistics

    from cohort.operators.prep import TablePrep, fit_leave_out
    rnd = random.Random(1)
    rows = [(rnd.choice([None, rnd.gauss(5, 2), 1.0]), rnd.choice([None, 3]), rnd.choice([None, "a", "b"]) if i % 4 else "only in 0", i % 4) for i in range(203)]
    df = spark.createDataFrame(rows, "x double, y int, t string, fold int").repartition(3)
    got = fit_leave_out(df, ["x", "y"], ["t"], "fold", 4)
    for i, m in enumerate(got):
        part = [r for r in rows if r[3] != i]
        one = TablePrep(numeric=["x", "y"], categorical=["t"]).fit(df.where(F.col("fold") != i))
        for name in ("medians", "means", "stds"):
            assert m.getOrDefault(name) == pytest.approx(one.getOrDefault(name), abs=1e-9)
        assert m.getOrDefault("levels") == one.getOrDefault("levels") == [sorted({r[2] or "Missing" for r in part})] and m.getOrDefault("rows") == len(part)
        mid = statistics.median([r[0] for r in part if r[0] is not None])
        filled = [mid if r[0] is None else r[0] for r in part]
        assert m.getOrDefault("medians")[0] == pytest.approx(mid) and m.getOrDefault("stds")[0] == pytest.approx(statistics.pstdev(filled))
    assert len(got) == 5


def test_preparation_is_saved_with_its_pipeline(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from cohort.operators.prep import TablePrep, fit_leave_out
    df = spark.createDataFrame([(1.0, None, "a"), (float("nan"), None, "b"), (4.0, None, None)], "x double, gone double, t string")
    model = Pipeline(stages=[TablePrep(numeric=["x", "gone"], categorical=["t"])]).fit(df)
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    new = spark.createDataFrame([(2.0, 1.0, "new"), (None, None, "a")], "x double, gone double, t string")
    assert [r.features for r in again.transform(new).collect()] == [r.features for r in model.transform(new).collect()]
    assert again.transform(new).first().features.toArray()[2:].tolist() == [0.0, 0.0, 0.0]  # an unseen level
    import cohort.operators.prep as prep
    old, prep.MOST_LEVELS = prep.MOST_LEVELS, 2
    try:
        with pytest.raises(ValueError):
            fit_leave_out(df, [], ["t"])
    finally:
        prep.MOST_LEVELS = old


def test_previous_rows_shift_each_group_by_one(spark):
    from cohort.operators.ordered import previous_rows
    df = spark.createDataFrame([(g, (i * 37) % 101, i, None if i == 5 else f"v{i}") for g in (0, 1, None) for i in range(60)] + [(7, 1, 1, "alone")], "g int, k int, i int, v string")
    got = previous_rows(df, "k", ["v", "i"], ["g"]).collect()
    assert len(got) == 181
    for g in (0, 1, None, 7):
        rows = sorted((r for r in got if r.g == g), key=lambda r: r.k)
        assert [(r["_previous"].v, r["_previous"].i) for r in rows] == [(rows[j - 1].v, rows[j - 1].i) for j in range(len(rows))]
