"""Golden values on the ten-row sample table (expected values from FIXTURES.md §1.1)."""

import pytest
from pyspark.sql import functions as F

from cohort.operators import kpi, explore, profile
from cohort.operators.roles import detect_roles

ROWS = [
    (1, "female", "bachelor's degree", "standard", "completed", 3.5, 0.95, 78, 84, 82),
    (2, "male", "some college", "standard", "none", 2.0, 0.88, 67, 70, 68),
    (3, "female", "master's degree", "standard", "completed", 4.2, 0.98, 92, 95, 94),
    (4, "male", "high school", "free/reduced", "none", 1.5, 0.79, 55, 59, 57),
    (5, "female", "associate's degree", "standard", "completed", 3.0, 0.91, 74, 79, 80),
    (6, "male", "some high school", "free/reduced", "none", 1.2, 0.72, 49, 53, 51),
    (7, "female", "some college", "standard", "completed", 3.8, 0.94, 85, 89, 88),
    (8, "male", "bachelor's degree", "standard", "none", 2.7, 0.86, 71, 73, 70),
    (9, "female", "high school", "free/reduced", "completed", 2.4, 0.82, 63, 68, 66),
    (10, "male", "associate's degree", "standard", "completed", 3.1, 0.90, 76, 75, 74),
]
SCHEMA = ("student_id long, gender string, parental_education string, lunch_type string, "
          "test_preparation_course string, study_time_hours double, attendance_rate double, "
          "math_score long, reading_score long, writing_score long")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_roles(sample):
    r = detect_roles(sample)
    assert r.student_id == "student_id"
    assert r.target is None
    assert r.attendance == "attendance_rate"
    assert r.scores == ["math_score", "reading_score", "writing_score"]
    assert r.risk_indicators == ["study_time_hours", "attendance_rate"]


def test_kpis(sample):
    r = detect_roles(sample)
    s = kpi.kpi_snapshot(sample, r).first()
    assert s.total_entities == 10
    assert s.average_score == pytest.approx(72.833333, abs=1e-5)
    assert s.average_attendance == pytest.approx(87.5, abs=1e-9)
    assert (s.pass_count, s.fail_count) == (8, 2)
    assert (s.high_performers, s.average_progress, s.at_risk_students) == (5, 3, 2)


def test_row_averages_and_bands(sample):
    r = detect_roles(sample)
    p, _ = kpi.prepare(sample, r)
    avgs = [round(x[0], 4) for x in p.orderBy("student_id").select(kpi.AVG).collect()]
    assert avgs == [81.3333, 68.3333, 93.6667, 57.0, 77.6667, 51.0, 87.3333, 71.3333, 65.6667, 75.0]
    bands = explore.score_bands(p, kpi.AVG).orderBy("band").select("n").collect()
    assert [b.n for b in bands] == [0, 0, 2, 2, 4, 2]


def test_correlations(sample):
    pear = explore.correlation_matrix(sample, ["study_time_hours", "math_score"]).first().r
    spear = explore.correlation_spearman(sample, ["study_time_hours", "math_score"]).first().r
    assert pear == pytest.approx(0.979938, abs=1e-6)
    assert spear == pytest.approx(0.987879, abs=1e-6)


def test_group_and_split(sample):
    r = detect_roles(sample)
    best = kpi.top_group(sample, r).first()
    assert (best.group_column, best.level) == ("parental_education", "master's degree")
    assert best.average_score == pytest.approx(93.6667, abs=1e-4)
    ms = kpi.median_split(sample, r, study="study_time_hours").first()
    assert ms.median_study == pytest.approx(2.85)
    assert ms.low_study_score == pytest.approx(62.666667, abs=1e-5)
    assert ms.high_study_score == pytest.approx(83.0, abs=1e-9)


def test_describe_and_identifiers(sample):
    d = profile.describe_all(sample, ["math_score"]).first()
    assert (d.mean, d.min, d.p25, d.p50, d.p75, d.max) == (71.0, 49.0, 64.0, 72.5, 77.5, 92.0)
    assert d.std == pytest.approx(13.080945, abs=1e-6)
    ids = [r.column_name for r in profile.identifier_columns(sample).where("is_identifier").collect()]
    assert ids == ["student_id"]
