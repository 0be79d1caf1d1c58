"""Catalog entries: role evidence and detection, report facts, scalar function families."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.functions.exprs import col, normalize_name_col
from cohort.functions.labels import normalize_target, PASS, FAIL
from cohort.operators import roles as R, kpi
from cohort.plans.common import register, finish, STUDENTS, SP, TARGET_SQL, sql_list
from cohort.plans.profile_queries import STUDENT_COLS
from cohort.functions.labels import PASS_TOKENS, FAIL_TOKENS
from cohort.session import scratch_path
from cohort.sources.fixtures import students, table


def _evidence_sql():
    parts = []
    for i, (c, t) in enumerate(STUDENT_COLS):
        if t in ("bigint", "int", "double"):
            numc = f"count({c})"
        elif t == "string":
            numc = f"count_if(regexp_matches({c}, '^\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$'))"
        else:
            numc = "0"
        tok = f"count_if(lower(trim(CAST({c} AS VARCHAR))) IN ({sql_list(PASS_TOKENS + FAIL_TOKENS)}))"
        parts.append(f"SELECT '{c}' AS column_name, CAST({i} AS BIGINT) AS position, '{t}' AS data_type, CAST(count({c}) AS BIGINT) AS non_null, "
                     f"CAST({numc} AS BIGINT) AS numeric_count, CAST({tok} AS BIGINT) AS passfail_count FROM students")
    return f"WITH {STUDENTS}\n" + "\nUNION ALL\n".join(parts)


@register("role_evidence", _evidence_sql())
def q_role_evidence(spark, sf_dir):
    return finish(R.evidence_frame(students(spark, sf_dir)))


# Expected roles of the fixture, as literal rows (role detection works on names).
ROLE_ROWS = [("student_id", 0, "student_id"), ("target", 0, "result"), ("attendance", 0, "absences"),
             ("scores", 0, "g1"), ("scores", 1, "g2"), ("scores", 2, "g3"),
             ("risk_indicators", 0, "studytime"), ("risk_indicators", 1, "absences"), ("risk_indicators", 2, "failures"),
             ("prediction_features.study_time", 0, "studytime"), ("prediction_features.absences", 0, "absences"),
             ("prediction_features.failures", 0, "failures"), ("prediction_features.previous_grade_1", 0, "g1"),
             ("prediction_features.previous_grade_2", 0, "g2")] + \
    [("classification_features", i, c) for i, c in enumerate(
        ["studytime", "absences", "failures", "programme", "support_band", "tutor_ref", "g2", "g3", "recorded_at"])] + \
    [("clustering_features", i, c) for i, c in enumerate(["g1", "g2", "g3", "studytime", "absences"])] + \
    [("performance", i, c) for i, c in enumerate(["g1", "g2", "g3"])]


@register("detect_roles", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', CAST({b} AS BIGINT), '{c}')" for a, b, c in ROLE_ROWS)
          + ") t(role, position, column_name)")
def q_detect_roles(spark, sf_dir):
    df = students(spark, sf_dir)
    return finish(R.roles_frame(spark, R.detect_roles(df)))


OVERRIDES = {"attendance": "studytime", "target": "nowhere", "scores": ["g3", "gone", "g1"], "student_id": None}
#: What the overrides change; a column that isn't there leaves its role empty, a null is no override.
OVERRIDDEN = [r for r in ROLE_ROWS if r[0] not in ("attendance", "target", "scores")] + [("attendance", 0, "studytime"), ("scores", 0, "g3"), ("scores", 1, "g1")]


def _values(rows, names):
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows) + f") t({names})"


@register("role_overrides", _values(OVERRIDDEN, "role, position, column_name"))
def q_role_overrides(spark, sf_dir):
    return finish(R.roles_frame(spark, R.detect_roles(students(spark, sf_dir), overrides=OVERRIDES)))


@register("role_status", _values([("Student ID", "student_id"), ("Target Column", "Derived from score columns"), ("Attendance Column", "studytime"),
    ("Score Columns", "g3, g1"), ("Risk Indicators", "studytime, absences, failures"),
    ("Prediction Features", "study_time: studytime, absences: absences, failures: failures, previous_grade_1: g1, previous_grade_2: g2")], "schema_role, mapped_column"))
def q_role_status(spark, sf_dir):
    return R.schema_status(spark, R.detect_roles(students(spark, sf_dir), overrides=OVERRIDES))


@register("numeric_column_mean", f"WITH {STUDENTS}\nSELECT round(avg(g3), 6) AS mean_value FROM students")
def q_numeric_column_mean(spark, sf_dir):
    df = students(spark, sf_dir)
    return finish(df.agg(F.avg(kpi.num(df, "g3")).alias("mean_value")))


@register("report_facts", f"""WITH {STUDENTS}
SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(12 AS BIGINT) AS column_count, CAST(7 AS BIGINT) AS numeric_columns,
  CAST(4 AS BIGINT) AS categorical_columns,
  CAST(count(*) * 12 - (count(student_id) + count(programme) + count(support_band) + count(tutor_ref) + count(studytime)
     + count(absences) + count(failures) + count(g1) + count(g2) + count(g3) + count(result) + count(recorded_at)) AS BIGINT) AS missing_values,
  round(avg(g1), 6) AS performance_mean,
  round(count_if(g1 >= CASE WHEN max(g1) OVER () <= 20 THEN 10 ELSE 60 END) * 100.0 / count(g1), 6) AS pass_rate
FROM students""".replace("count_if(g1 >= CASE WHEN max(g1) OVER () <= 20 THEN 10 ELSE 60 END)",
                         "count_if(g1 >= (SELECT CASE WHEN max(g1) <= 20 THEN 10 ELSE 60 END FROM students))"))
def q_report_facts(spark, sf_dir):
    df = students(spark, sf_dir)
    return finish(kpi.report_facts(df, R.detect_roles(df)))


@register("scalar_string", f"""WITH {STUDENTS}
SELECT student_id, regexp_replace(lower(trim(support_band)), '[ _/-]', '', 'g') AS norm_band,
  contains(result, 'PASS') AS has_pass, ends_with(programme, 'ING') AS ends_ing,
  concat_ws(', ', programme, support_band) AS joined, replace(support_band, '-', ' ') AS spaced FROM students""")
def q_scalar_string(spark, sf_dir):
    df = students(spark, sf_dir)
    return df.select("student_id", normalize_name_col(col("support_band")).alias("norm_band"),
                     col("result").contains("PASS").alias("has_pass"), col("programme").endswith("ING").alias("ends_ing"),
                     F.concat_ws(", ", "programme", "support_band").alias("joined"),
                     F.replace(col("support_band"), F.lit("-"), F.lit(" ")).alias("spaced"))


@register("scalar_math", f"""WITH {STUDENTS}
SELECT student_id, least(greatest(g2 - 5, 0.0), 10.0) AS clipped, CAST(ceil(g2) AS DOUBLE) AS up, round(g2 / 3, 6) AS third,
  CAST(studytime % 4 AS BIGINT) AS modulo, abs(g2 - 10) AS dist, isfinite(g2 / nullif(absences, 0)) AS finite FROM students""")
def q_scalar_math(spark, sf_dir):
    df = students(spark, sf_dir)
    ratio = F.try_divide(col("g2"), F.nullif(col("absences"), F.lit(0)))
    return finish(df.select("student_id", F.least(F.greatest(col("g2") - 5, F.lit(0.0)), F.lit(10.0)).alias("clipped"),
                            F.ceil("g2").cast("double").alias("up"), (col("g2") / 3).alias("third"),
                            (col("studytime") % 4).alias("modulo"), F.abs(col("g2") - 10).alias("dist"),
                            (~F.isnan(ratio) & (F.abs(ratio) != float("inf"))).alias("finite")))


@register("scalar_scale", f"""WITH {STUDENTS}
SELECT student_id, round(CASE WHEN g1 / 20 <= 1.5 THEN g1 / 20 * 100 ELSE g1 / 20 END, 6) AS scaled FROM students""")
def q_scalar_scale(spark, sf_dir):
    df = students(spark, sf_dir)
    v = col("g1") / 20
    return finish(df.select("student_id", F.when(v <= 1.5, v * 100).otherwise(v).alias("scaled")))


@register("scalar_null", f"""WITH {STUDENTS}
SELECT student_id, coalesce(g1, g2) AS first_grade, g3 IS NULL AS g3_missing, coalesce(result, 'Missing') AS result FROM students""")
def q_scalar_null(spark, sf_dir):
    df = students(spark, sf_dir)
    return finish(df.select("student_id", F.coalesce("g1", "g2").alias("first_grade"), F.isnull("g3").alias("g3_missing"),
                            F.coalesce("result", F.lit("Missing")).alias("result")))


@register("scalar_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_scalar_json(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register("scalar_hash", "SELECT doc_id, substr(sha1(text), 1, 12) AS text_sig FROM documents")
def q_scalar_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring(F.sha1(F.col("text").cast("binary")), 1, 12).alias("text_sig"))


@register("scalar_map", f"""WITH {STUDENTS}
SELECT student_id, CASE ({TARGET_SQL}) WHEN 'Pass' THEN 1 WHEN 'Fail' THEN 0 END::BIGINT AS y FROM students""")
def q_scalar_map(spark, sf_dir):
    df = students(spark, sf_dir)
    t = normalize_target(col("result"))
    return df.select("student_id", F.when(t == PASS, 1).when(t == FAIL, 0).cast("long").alias("y"))


@register("latest_accuracy")
def q_latest_accuracy(spark, sf_dir):
    """Accuracy (percent) of the newest stored logistic run; without one, of the newest run of any model."""
    from cohort.operators import kpi as k
    from cohort.plans.model_queries import runs
    return k.latest_accuracy(runs(spark, sf_dir)["metrics"])


@register("auto_pipeline")
def q_auto_pipeline(spark, sf_dir):
    from cohort.plans.pipeline_run import auto_pipeline
    return auto_pipeline(students(spark, sf_dir), scratch_path(spark, "auto-runs")).report


_PLAIN = "'^\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$'"


@register("numeric_cast", f"""WITH {STUDENTS}
SELECT student_id, CASE WHEN regexp_matches(tutor_ref, {_PLAIN}) THEN TRY_CAST(trim(tutor_ref) AS DOUBLE) END AS tutor_num,
  CASE WHEN regexp_matches(result, {_PLAIN}) THEN TRY_CAST(trim(result) AS DOUBLE) END AS result_num,
  CAST(absences AS DOUBLE) AS absences_num FROM students""")
def q_numeric_cast(spark, sf_dir):
    df = students(spark, sf_dir)
    return finish(df.select("student_id", kpi.num(df, "tutor_ref").alias("tutor_num"),
                            kpi.num(df, "result").alias("result_num"), kpi.num(df, "absences").alias("absences_num")))
