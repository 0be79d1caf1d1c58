"""Edge fixtures for the semantic traps and properties of the ordered operators."""

import random

import pytest
from pyspark.sql import functions as F

from cohort.functions.exprs import num_expr, scale_factor, pass_mark
from cohort.functions.labels import normalize_target, risk_category
from cohort.operators import metrics, clean, profile
from cohort.operators.ordered import running_sums
from pyspark.sql import types as T


def test_numeric_coercion(spark):
    df = spark.createDataFrame([("1",), (" 2.5 ",), ("abc",), ("1.0d",), ("Infinity",), (None,)], "v string")
    got = [r[0] for r in df.select(num_expr("v", T.StringType())).collect()]
    assert got == [1.0, 2.5, None, None, None, None]


def test_target_tokens(spark):
    df = spark.createDataFrame([(" PASSED ",), ("Y",), ("1",), ("true",), ("maybe",), (None,), ("no",)], "t string")
    got = [r[0] for r in df.select(normalize_target(F.col("t"))).collect()]
    assert got == ["Pass", "Pass", "Pass", "Pass", None, None, "Fail"]


def test_scale_rules():
    assert scale_factor(1.0) == 100 and scale_factor(20) == 5 and scale_factor(95) == 1
    assert pass_mark(1.0) == 0.6 and pass_mark(20) == 10 and pass_mark(100) == 60


def test_risk_order(spark):
    df = spark.createDataFrame([("Pass", 80.0, 70.0), ("Fail", 90.0, 95.0), (None, 90.0, 80.0), (None, 90.0, 95.0),
                                (None, 50.0, 95.0), ("Pass", 70.0, 95.0)], "t string, a double, att double")
    got = [r[0] for r in df.select(risk_category(F.col("t"), F.col("a"), F.col("att"))).collect()]
    assert got == ["High Performers", "At-Risk Students", "Average Progress", "High Performers",
                   "At-Risk Students", "Average Progress"]


def test_dedup_null_equality(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, float("nan")), (2, float("nan"))], "a int, b double")
    assert clean.dedup_rows(df).count() == 2


def test_constant_column_scaler(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    prep = clean.FeaturePrep.fit(df, ["x"], [])
    assert [r.x for r in prep.transform(df).collect()] == [5.0, 5.0, 5.0]


def test_cardinality_cut_is_strict(spark):
    rows = [(f"v{i % 30}", f"w{i % 31}") for i in range(62)]
    df = spark.createDataFrame(rows, "a string, b string")
    hc = {r.column_name: r.high_cardinality for r in profile.high_cardinality(df).collect()}
    assert hc == {"a": False, "b": True}


def test_running_sums_match_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("xyz"), float(k), rnd.randint(0, 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k double, v long")
    got = {(r.g, r.k): r.cum_v for r in running_sums(df, "k", ["v"], group=["g"], buckets=5).collect()}
    for g in "xyz":
        acc = 0
        for _, k, v in sorted([r for r in rows if r[0] == g], key=lambda r: r[1]):
            acc += v
            assert got[(g, k)] == acc


def test_auc_properties(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "y long, p double")
    auc = metrics.roc_auc(df).first()[0]
    flipped = metrics.roc_auc(df.withColumn("p", -F.col("p"))).first()[0]
    assert auc + flipped == pytest.approx(1.0)
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(brute)
    c = metrics.confusion_counts(df.withColumn("pred", (F.col("p") >= 0.5).cast("long"))).first()
    assert c.tn + c.fp + c.fn + c.tp == 200


def test_a_missing_absence_is_neither_full_absence_nor_full_attendance(spark):
    from cohort.functions.labels import attendance_percent
    from cohort.operators.clean import absence_transform
    df = spark.createDataFrame([(None,), (0.0,), (4.0,), (9.0,)], "a double")
    got = df.select(attendance_percent(F.col("a"), True, 8.0).alias("p"), absence_transform(F.col("a"), "attendance_percent_proxy").alias("m")).collect()
    assert [(r.p, r.m) for r in got] == [(None, None), (100.0, 100.0), (50.0, 96.0), (0.0, 91.0)]


def _brute_kendall(xs, ys):
    n = len(xs)
    s = sum((1 if (xs[i] - xs[j]) * (ys[i] - ys[j]) > 0 else -1 if (xs[i] - xs[j]) * (ys[i] - ys[j]) < 0 else 0)
            for i in range(n) for j in range(i + 1, n))
    from collections import Counter
    n0 = n * (n - 1) / 2
    n1 = sum(t * (t - 1) / 2 for t in Counter(xs).values())
    n2 = sum(t * (t - 1) / 2 for t in Counter(ys).values())
    return s / ((n0 - n1) * (n0 - n2)) ** 0.5


def _avg_ranks(v):
    order = sorted(range(len(v)), key=lambda i: v[i])
    ranks = [0.0] * len(v)
    i = 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and v[order[j + 1]] == v[order[i]]:
            j += 1
        for k in range(i, j + 1):
            ranks[order[k]] = (i + j) / 2 + 1
        i = j + 1
    return ranks


def _pearson(a, b):
    n = len(a)
    ma, mb = sum(a) / n, sum(b) / n
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    va = sum((x - ma) ** 2 for x in a) ** 0.5
    vb = sum((y - mb) ** 2 for y in b) ** 0.5
    return cov / (va * vb)


def test_rank_correlations_match_brute_force(spark):
    from cohort.operators import explore
    rnd = random.Random(11)
    rows = [(float(rnd.randint(0, 9)), float(rnd.randint(0, 6)), rnd.random()) for _ in range(150)]
    rows += [(None, 1.0, 0.5), (2.0, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    tau = {(r.column_a, r.column_b): r.tau for r in explore.correlation_kendall(df, ["a", "b", "c"]).collect()}
    rho = {(r.column_a, r.column_b): r.r for r in explore.correlation_spearman(df, ["a", "b", "c"]).collect()}
    for a, b, ia, ib in [("a", "b", 0, 1), ("a", "c", 0, 2), ("b", "c", 1, 2)]:
        comp = [(r[ia], r[ib]) for r in rows if r[ia] is not None and r[ib] is not None]
        xs, ys = [p[0] for p in comp], [p[1] for p in comp]
        assert tau[(a, b)] == pytest.approx(_brute_kendall(xs, ys), abs=1e-9)
        assert rho[(a, b)] == pytest.approx(_pearson(_avg_ranks(xs), _avg_ranks(ys)), abs=1e-9)


def test_text_tables(spark):
    from cohort.sources.delimited import extract_text_tables
    docs = spark.createDataFrame([
        (1, "intro line\nname|score|\nann|3|x\nbob|4|\nend"),
        (2, "a,b\n1,2\n3,4"),
        (3, "no table here"),
    ], "doc_id long, text string")
    got = sorted((r.doc_id, r.row_no, r.column_name, r.value) for r in extract_text_tables(docs).collect())
    assert (1, 2, "name", "ann") in got and (1, 2, "column_3", "x") in got and (1, 3, "column_3", None) in got
    assert (2, 1, "a", "1") in got and (2, 2, "b", "4") in got
    assert not [g for g in got if g[0] == 3]


def test_sniffed_semicolon_file(spark, tmp_path):
    from cohort.sources.delimited import read_delimited
    p = tmp_path / "audit.csv"
    p.write_text("studytime;absences;G1\n2;4;12\n3;1;15\n")
    df = read_delimited(spark, str(p))
    assert df.columns == ["studytime", "absences", "G1"]
    assert [tuple(r) for r in df.collect()] == [(2, 4, 12), (3, 1, 15)]
