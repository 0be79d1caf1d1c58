"""Running sums, exact percentiles, splits and scoring: brute force, bounded broadcasts, no lost rows."""

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from cohort.operators import clean, explore, models, roles, score, split
from cohort.operators.ordered import exact_percentiles, group_percentiles, running_sums


def test_percentiles_equal_numpy(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 7.0, rnd.gauss(0, 50)]), float(i % 3), None, rnd.randint(-5, 5)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_percentiles(df, {n: F.col(n) for n in "abcd"}, probs)
    for i, n in enumerate("abd"):
        values = [r["abcd".index(n)] for r in rows if r["abcd".index(n)] is not None]
        assert np.allclose(got[n], np.quantile(values, probs), rtol=0, atol=1e-9)
    assert got["c"] == [None] * len(probs)
    assert exact_percentiles(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double"), {"x": F.col("x")}, [0.5])["x"] == [3.0]


def test_many_groups_leave_few_carries(spark):
    rows = spark.range(100_000).select((F.col("id") % 20_000).alias("g"), (F.col("id") * 7919 % 100_003).alias("k"), F.lit(1).alias("v"))
    rows = rows.unionByName(spark.range(30_000).select(F.lit(-1).cast("long").alias("g"), F.col("id").alias("k"), F.lit(1).alias("v")))
    out = running_sums(rows, "k", ["v"], group=["g"], buckets=8)
    top = {r.g: r.m for r in out.groupBy("g").agg(F.max("cum_v").alias("m")).where("g < 5").collect()}
    assert top == {-1: 30_000, **{i: 5 for i in range(5)}}
    last = out.where("g = -1 AND cum_v <> k + 1").count()
    assert last == 0  # the large group is cut, its carries are right


def test_running_sums_equal_brute_force(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([None, "a", "b", "c"]), rnd.choice([float("nan"), 1.0, None]), rnd.randrange(10**6), rnd.randrange(9), rnd.random(), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g string, h double, k long, v int, x double, i int").repartition(6)
    for group, descending in (([], False), (["g"], True), (["g", "h"], False)):
        got = running_sums(df, "k", ["v", "x"], group, descending, buckets=7, ties=["i"]).collect()
        want = {}
        for r in sorted(rows, key=lambda r: (-r[2] if descending else r[2], r[5])):
            of = tuple(str(r["gh".index(c)]) for c in group)
            a, b = want.get(of, (0, 0.0))
            want[of] = a + r[3], b + r[4]
            want[r[5]] = want[of]
        assert len(got) == len(rows) and all(r.cum_v == want[r.i][0] and abs(r.cum_x - want[r.i][1]) < 1e-6 for r in got)


def test_null_keys_come_first_or_last_and_null_numbers_add_nothing(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (2, None), (3, 4)], "k int, v int")
    assert {r.k: r.cum_v for r in running_sums(df, "k", ["v"]).collect()} == {None: 1, 1: 3, 2: 3, 3: 7}
    assert {r.k: r.cum_v for r in running_sums(df, "k", ["v"], descending=True).collect()} == {3: 4, 2: 4, 1: 6, None: 7}
    assert running_sums(df.where("k > 9"), "k", ["v"], ["k"]).count() == 0


def test_percentiles_by_group_equal_numpy(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, "a", "b", "hot", "hot", "hot"]), rnd.choice([None, rnd.gauss(0, 5), 2.0])) for _ in range(2_000)] + [("none", None)]
    got = group_percentiles(spark.createDataFrame(rows, "g string, x double"), {"x": F.col("x")}, [0.0, 0.3, 0.5, 1.0], ["g"]).collect()
    assert {r.g for r in got} == {None, "a", "b", "hot"}
    for r in got:
        assert np.allclose(r.p, np.quantile([x for g, x in rows if g == r.g and x is not None], [0.0, 0.3, 0.5, 1.0]), rtol=0, atol=1e-9)


def test_the_input_of_running_sums_is_read_at_most_twice(spark, tmp_path):
    spark.range(1_000).selectExpr("id AS k", "1 AS v").write.parquet(str(tmp_path / "t"))
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        reads.add(1)
        yield from batches

    src = spark.read.parquet(str(tmp_path / "t")).coalesce(1)
    out = running_sums(src.mapInArrow(count, src.schema), "k", ["v"])
    assert out.agg(F.max("cum_v")).first()[0] == 1_000 and out.count() == 1_000 and reads.value <= 2


def test_large_integers_keep_their_order(spark):
    big = 1 << 59
    df = spark.createDataFrame([(big + i, 1) for i in range(50)], "k long, v int")
    assert all(r.cum_v == r.k - big + 1 for r in running_sums(df, "k", ["v"], buckets=4).collect())


def test_equal_keys_stay_on_one_side(spark):
    rows = [(i % 50, float(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, label double").withColumn("label", (F.col("id") % 2).cast("double"))
    out = split.stratified_split(df, "label", F.col("id"))
    sides = out.groupBy("id").agg(F.count_distinct("is_test").alias("n")).where("n > 1").count()
    assert sides == 0 and out.count() == 400
    again = split.stratified_split(df.repartition(7), "label", F.col("id"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_preparation_uses_the_true_median_and_population_std(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (4.0, 0.0), (10.0, 1.0), (None, 1.0)], "x double, label double")
    m = models.build_pipeline("tree", ["x"], [], 5).fit(df)
    filled = [1.0, 2.0, 4.0, 10.0, 3.0]
    mean, std = statistics.fmean(filled), statistics.pstdev(filled)
    got = [r["x__z"] for r in m.transform(df).collect()]
    assert np.allclose(got, [(v - mean) / std for v in filled])


def test_scoring_returns_every_request(spark):
    rows = [(1, 2.0, 3.0, 0.0, 10.0, 11.0), (2, None, 3.0, 0.0, 10.0, 11.0), (3, 900.0, 3.0, 0.0, 10.0, 11.0), (4, float("inf"), 1.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{f} double" for f in clean.FORM_FEATURES))
    checked = clean.scoring_input_check(df, {**clean.DEFAULT_LIMITS, "study_time": (0.0, 10.0, "Study Time")})
    scored = score.score_linear(checked.where("size(errors) = 0").drop("errors"), {"study_time": 1.0}, 0.0, {}, {})
    out = {r.id: r for r in score.with_rejects(scored, checked.where("size(errors) > 0")).collect()}
    assert sorted(out) == [1, 2, 3, 4] and out[1].errors is None and out[1].pass_probability > 0.8
    assert all(out[i].pass_probability is None and out[i].errors for i in (2, 3, 4))


def test_roles_overrides_status_and_needs(spark):
    df = spark.createDataFrame([("s1", "Pass", 12.0, 3.0, 0.9, 1.0)], "student_id string, result string, g1 double, study_time double, attendance double, final_grade double")
    found = roles.detect_roles(df)
    assert (found.student_id, found.target, found.attendance, found.scores) == ("student_id", "result", "attendance", ["g1", "final_grade"])
    assert found.prediction_features["absences"] == "attendance" and roles.supports(found) == {"prediction": True, "classification": True, "clustering": True}
    changed = roles.detect_roles(df, overrides={"attendance": "g1", "target": "nowhere", "scores": ["final_grade", "gone"]})
    assert (changed.attendance, changed.target, changed.scores) == ("g1", None, ["final_grade"])
    status = {r.schema_role: r.mapped_column for r in roles.schema_status(spark, changed).collect()}
    assert status["Target Column"] == "Derived from score columns" and status["Score Columns"] == "final_grade"
    assert roles.final_grade_column(roles.collect_facts(df)) == "final_grade"


def test_columns_that_define_the_target_are_removed():
    assert models.sanitize_features(["g1", "g2", "study", "study", "result"], "result", ["g1", "g2"]) == (["study"], ["g1", "g2", "result"])


def test_inversions_equal_brute_force():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        n, k = rnd.integers(0, 40), rnd.integers(1, 12)
        x, y, w = rnd.integers(0, k, n).astype(float), rnd.integers(0, k, n).astype(float), rnd.integers(1, 5, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
        assert explore.weighted_inversions(x, y, w) == want


def test_discordant_pairs_on_a_fine_grid_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(explore, "STRIP_POINTS", 40)
    rnd = random.Random(6)
    rows = {(p, rnd.choice([1.0, 1.0, rnd.gauss(0, 3)]), rnd.choice([2.0, rnd.gauss(0, 3)])) for p in range(3) for _ in range([5, 300, 600][p])}
    rows = [(*r, rnd.randint(1, 3)) for r in sorted(rows)]
    got = {r.pair: r.nd for r in explore.discordant_pairs(spark.createDataFrame(rows, "pair int, x double, y double, w long").repartition(3)).collect()}
    for p in range(3):
        x, y, w = (np.array([r[c] for r in rows if r[0] == p]) for c in (1, 2, 3))
        assert got[p] == (w[:, None] * w)[(x[:, None] < x) & (y[:, None] > y)].sum()


def test_kendall_of_100_000_distinct_points(spark):
    import time
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("a"), (F.col("id") * F.col("id") % 100_019).cast("double").alias("b"))
    t0 = time.time()
    tau = explore.correlation_kendall(df, ["a", "b"]).first().tau
    assert abs(tau) < 0.02 and time.time() - t0 < 60
