"""Catalog entries: KPIs, labels and group figures over the student fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.functions.exprs import col, num, row_mean, scale_factor, pass_mark as pass_mark_value
from cohort.functions.labels import normalize_target as norm_target, derive_target as derive
from cohort.operators import kpi
from cohort.operators.roles import detect_roles
from cohort.plans.common import register, finish, SP, STUDENTS, TARGET_SQL
from cohort.sources.fixtures import students


def _students(spark, sf_dir):
    df = students(spark, sf_dir)
    return df, detect_roles(df)


KPI_SQL_COLS = """CAST(count(DISTINCT student_id) AS BIGINT) AS total_entities,
  round((sum(g1) + sum(g2) + sum(g3)) / (count(g1) + count(g2) + count(g3)) * 5.0, 6) AS average_score,
  round(avg(att), 6) AS average_attendance,
  round(avg(absences), 6) AS average_absences,
  CAST(count_if(t = 'Pass') AS BIGINT) AS pass_count,
  CAST(count_if(t = 'Fail') AS BIGINT) AS fail_count,
  round(CAST(count_if(t = 'Pass') AS DOUBLE) * 100 / nullif(count_if(t IS NOT NULL), 0), 6) AS pass_rate,
  round(CAST(count_if(t = 'Fail') AS DOUBLE) * 100 / nullif(count_if(t IS NOT NULL), 0), 6) AS fail_rate,
  CAST(count_if(risk = 'High Performers') AS BIGINT) AS high_performers,
  CAST(count_if(risk = 'Average Progress') AS BIGINT) AS average_progress,
  CAST(count_if(risk = 'At-Risk Students') AS BIGINT) AS at_risk_students,
  CAST(count_if(t = 'Fail') AS BIGINT) AS at_risk_count"""


@register("kpi_snapshot", f"WITH {SP}\nSELECT programme, {KPI_SQL_COLS}\nFROM spr GROUP BY programme")
def q_kpi_snapshot(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    return finish(kpi.kpi_snapshot(df, roles, by=["programme"]))


@register("total_entities", f"WITH {STUDENTS}\nSELECT CAST(count(DISTINCT student_id) AS BIGINT) AS total_entities, "
                            "CAST(count(*) AS BIGINT) AS n_rows FROM students")
def q_total_entities(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    total = F.coalesce(F.nullif(F.count_distinct(col(roles.student_id)), F.lit(0)), F.count(F.lit(1)))
    return finish(df.agg(total.alias("total_entities"), F.count(F.lit(1)).alias("n_rows")))


@register("average_score", f"WITH {SP}\nSELECT round((sum(g1) + sum(g2) + sum(g3)) / "
                           "(count(g1) + count(g2) + count(g3)) * 5.0, 6) AS average_score FROM sp")
def q_average_score(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    return finish(kpi.kpi_snapshot(df, roles).select("average_score"))


@register("average_attendance", f"WITH {SP}\nSELECT round(avg(att), 6) AS average_attendance FROM sp")
def q_average_attendance(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    return finish(kpi.kpi_snapshot(df, roles).select("average_attendance"))


@register("average_absences", f"WITH {STUDENTS}\nSELECT round(avg(absences), 6) AS average_absences FROM students")
def q_average_absences(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    return finish(kpi.kpi_snapshot(df, roles).select("average_absences"))


@register("pass_fail_kpis", f"""WITH {SP}
SELECT CAST(count_if(t = 'Pass') AS BIGINT) AS pass_count, CAST(count_if(t = 'Fail') AS BIGINT) AS fail_count,
  round(CAST(count_if(t = 'Pass') AS DOUBLE) * 100 / nullif(count_if(t IS NOT NULL), 0), 6) AS pass_rate,
  round(CAST(count_if(t = 'Fail') AS DOUBLE) * 100 / nullif(count_if(t IS NOT NULL), 0), 6) AS fail_rate
FROM sp""")
def q_pass_fail(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    return finish(kpi.kpi_snapshot(df, roles).select("pass_count", "fail_count", "pass_rate", "fail_rate"))


@register("risk_category", f"WITH {SP}\nSELECT student_id, risk AS risk_category, round(avg, 6) AS avg_score, "
                           "round(att, 6) AS attendance, t AS target FROM spr")
def q_risk_category(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    prepared, _ = kpi.prepare(df, roles)
    return finish(prepared.select("student_id", F.col(kpi.RISK).alias("risk_category"),
                                  F.col(kpi.AVG).alias("avg_score"), F.col(kpi.ATT).alias("attendance"),
                                  F.col(kpi.TARGET).alias("target")))


@register("risk_breakdown", f"WITH {SP}\nSELECT programme, risk AS risk_category, CAST(count(*) AS BIGINT) AS n "
                            "FROM spr GROUP BY programme, risk")
def q_risk_breakdown(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    return finish(kpi.risk_breakdown(df, roles, by=["programme"]))


@register("row_mean", f"WITH {SP}\nSELECT student_id, round(avg, 6) AS avg_score FROM sp")
def q_row_mean(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    prepared, _ = kpi.prepare(df, roles, keep=["student_id", "g1", "g2", "g3"])
    return finish(prepared.select("student_id", F.col(kpi.AVG).alias("avg_score")))


@register("normalize_target", f"WITH {STUDENTS}\nSELECT student_id, result, {TARGET_SQL} AS target FROM students")
def q_normalize_target(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    return df.select("student_id", "result", norm_target(col(roles.target)).alias("target"))


@register("derive_target", f"""WITH {STUDENTS},
m AS (SELECT greatest(max(g1), max(g2), max(g3)) AS smax FROM students),
r AS (SELECT student_id, (coalesce(g1, 0.0) + coalesce(g2, 0.0) + coalesce(g3, 0.0))
      / nullif((CASE WHEN g1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN g2 IS NULL THEN 0 ELSE 1 END)
               + (CASE WHEN g3 IS NULL THEN 0 ELSE 1 END), 0) AS mean_score,
      CASE WHEN smax <= 1.5 THEN 0.6 WHEN smax <= 20 THEN 10.0 ELSE 60.0 END AS mark FROM students, m)
SELECT student_id, CASE WHEN mean_score >= mark THEN 'Pass' WHEN mean_score IS NOT NULL THEN 'Fail' END AS target_kpi,
  CASE WHEN mean_score >= mark THEN 'Pass' ELSE 'Fail' END AS target_train FROM r""")
def q_derive_target(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    stats = kpi.scale_stats(df, roles)
    mean = row_mean([num(df, c) for c in roles.performance])
    mark = pass_mark_value(stats.perf_max)
    return df.select("student_id", derive(mean, mark, "null").alias("target_kpi"),
                     derive(mean, mark, "fail").alias("target_train"))


@register("pass_mark", f"""WITH {STUDENTS},
m AS (SELECT greatest(max(g1), max(g2), max(g3)) AS smax FROM students)
SELECT CASE WHEN smax <= 1.5 THEN 0.6 WHEN smax <= 20 THEN 10.0 ELSE 60.0 END::DOUBLE AS pass_mark,
       CASE WHEN smax <= 1.5 THEN 100.0 WHEN smax <= 20 THEN 5.0 ELSE 1.0 END::DOUBLE AS scale_factor FROM m""")
def q_pass_mark(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    from cohort.functions.exprs import greatest_of
    m = df.agg(F.max(greatest_of([num(df, c) for c in roles.performance])).alias("smax"))
    s = F.col("smax")
    return finish(m.select(
        F.when(s <= 1.5, 0.6).when(s <= 20, 10.0).otherwise(60.0).alias("pass_mark"),
        F.when(s <= 1.5, 100.0).when(s <= 20, 5.0).otherwise(1.0).alias("scale_factor")))


@register("subject_means", f"""WITH {SP}
SELECT subject, round(average_score, 6) AS average_score FROM (
  SELECT 'g1' AS subject, avg(g1) * 5.0 AS average_score FROM students UNION ALL
  SELECT 'g2', avg(g2) * 5.0 FROM students UNION ALL SELECT 'g3', avg(g3) * 5.0 FROM students)""")
def q_subject_means(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    return finish(kpi.subject_means(df, roles))


@register("class_distribution", f"""WITH {STUDENTS}
SELECT class, CAST(count(*) AS BIGINT) AS records FROM (SELECT {TARGET_SQL} AS class FROM students) x
WHERE class IS NOT NULL GROUP BY class""")
def q_class_distribution(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    return kpi.class_distribution(df, roles)


@register("mean_by_group", f"""WITH {STUDENTS}
SELECT support_band, round(avg(g3), 6) AS mean_g3 FROM students WHERE support_band IS NOT NULL GROUP BY support_band""")
def q_mean_by_group(spark, sf_dir):
    df, _ = _students(spark, sf_dir)
    return finish(kpi.mean_by_group(df, "support_band", "g3"))


@register("top_group", f"""WITH {SP},
lv AS (SELECT 'programme' AS group_column, 1 AS pos, programme AS level, avg FROM sp UNION ALL
       SELECT 'support_band', 2, support_band, avg FROM sp),
m AS (SELECT group_column, pos, level, avg(avg) AS average_score FROM lv WHERE level IS NOT NULL
      GROUP BY group_column, pos, level HAVING avg(avg) IS NOT NULL)
SELECT group_column, level, round(average_score, 6) AS average_score FROM m
ORDER BY average_score DESC, pos, level LIMIT 1""")
def q_top_group(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    return finish(kpi.top_group(df, roles))


@register("median_split", f"""WITH {SP},
p AS (SELECT CAST(studytime AS DOUBLE) AS s, avg AS a FROM sp WHERE studytime IS NOT NULL AND avg IS NOT NULL),
m AS (SELECT median(s) AS m FROM p)
SELECT round(m.m, 6) AS median_study, round(avg(CASE WHEN s <= m.m THEN a END), 6) AS low_study_score,
       round(avg(CASE WHEN s > m.m THEN a END), 6) AS high_study_score FROM p, m GROUP BY m.m""")
def q_median_split(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    return finish(kpi.median_split(df, roles))


@register("threshold_counts", f"""WITH {SP}
SELECT CAST(count_if(avg < 60) AS BIGINT) AS low_score_count, CAST(count_if(avg >= 80) AS BIGINT) AS high_score_count,
       CAST(count_if(failures >= 2) AS BIGINT) AS repeat_failure_count FROM sp""")
def q_threshold_counts(spark, sf_dir):
    df, roles = _students(spark, sf_dir)
    return finish(kpi.threshold_counts(df, roles))
