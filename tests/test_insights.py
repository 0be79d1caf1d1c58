"""Insights by group against insights of each group alone, with fallback, limit and odd groups."""

import random

from pyspark.sql import functions as F

from cohort.operators import insights as ins
from cohort.operators import kpi
from cohort.operators.roles import detect_roles

COLUMNS = "student_id long, programme string, band string, study_time double, absences double, failures double, math_score double, art_score double, result string"


def _rows(n=600, seed=3):
    rnd = random.Random(seed)
    maybe = lambda v: None if rnd.random() < 0.1 else v
    return [(i, rnd.choice([None, "a", "b", "hot", "hot", "hot", "hot"]), rnd.choice(["x", "y", None]), maybe(float(rnd.randint(0, 9))), maybe(float(rnd.randint(0, 20))),
             maybe(float(rnd.randint(0, 3))), maybe(rnd.uniform(30, 100)), maybe(rnd.uniform(20, 100)), maybe(rnd.choice(["Pass", "Fail"]))) for i in range(n)]


def test_each_group_has_the_insights_of_its_own_rows(spark):
    df = spark.createDataFrame(_rows(), COLUMNS).repartition(5)
    roles = detect_roles(df)
    stats = kpi.scale_stats(df, roles)
    got = {}
    for r in ins.insights_by(ins.figures_by(df, roles, ["programme"], stats), ["programme"], 4).orderBy("programme", "severity_rank", "emitted").collect():
        got.setdefault(r.programme, []).append((r.emitted, r.title, r.label, r.severity, round(r.value, 6)))
    assert set(got) == {None, "a", "b", "hot"}
    for g, rows in got.items():
        part = df.where(F.col("programme").eqNullSafe(F.lit(g))).drop("programme")
        row = {}
        prepared, _ = kpi.prepare(part, roles, stats)
        own = prepared.agg(*kpi._kpi_aggs(prepared, roles, stats)).first()
        pairs = [(r.study_time, r[kpi.AVG]) for r in prepared.collect() if r.study_time is not None and r[kpi.AVG] is not None]
        mid = sorted(s for s, _ in pairs)
        m = (mid[(len(mid) - 1) // 2] + mid[len(mid) // 2]) / 2
        low, high = [a for s, a in pairs if s <= m], [a for s, a in pairs if s > m]
        bands = {}
        for r in prepared.collect():
            if r.band is not None and r[kpi.AVG] is not None:
                bands.setdefault(r.band, []).append(r[kpi.AVG])
        best = max(bands, key=lambda b: sum(bands[b]) / len(bands[b]))
        counts = prepared.agg(F.count_if(F.col(kpi.AVG) < 60).alias("l"), F.count_if(F.col(kpi.AVG) >= 80).alias("h"), F.count_if(F.col("failures") >= 2).alias("f")).first()
        row = (float(max(own.total_entities, 1)), own.average_attendance, float(own.at_risk_count), own.pass_rate, own.fail_rate, float(counts.l), float(counts.h), True,
               f"band: {best}", sum(bands[best]) / len(bands[best]), sum(low) / len(low), sum(high) / len(high), float(counts.f), True, None, None, None)
        want = ins.insights(spark.createDataFrame([row], ins.FIGURES), 4).collect()
        assert rows == [(r.emitted, r.title, r.label, r.severity, round(r.value, 6)) for r in want]


def test_a_group_without_facts_has_the_fallback(spark):
    df = spark.createDataFrame([(1, "a", "x", 1.0, 2.0, 0.0, 90.0, 80.0, "Pass"), (2, "a", "y", 2.0, 1.0, 0.0, 70.0, 60.0, "Fail"),
                                (3, "empty", "x", None, None, None, None, None, None), (4, "empty", "y", None, None, None, None, None, None)], COLUMNS)
    roles = detect_roles(df)
    out = ins.insights_by(ins.figures_by(df, roles, ["programme"]), ["programme"])
    assert [(r.title, r.severity, r.value) for r in out.where("programme = 'empty'").collect()] == [("Upload More Academic Data", "info", None)]
    assert out.where("programme = 'a'").count() >= 3


def test_hot_groups_are_collapsed_before_the_shuffle(spark):
    df = spark.createDataFrame(_rows(50), COLUMNS)
    plan = ins.insights_by(ins.figures_by(df, detect_roles(df), ["programme"]), ["programme"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan and "BatchEvalPython" not in plan and "CartesianProduct" not in plan
