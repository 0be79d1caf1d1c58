"""Catalog entries: cleaning and feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.functions.exprs import clip, col
from cohort.functions.labels import normalize_target
from cohort.operators import clean
from cohort.operators.roles import detect_roles
from cohort.plans.common import register, finish, STUDENTS, TARGET_SQL
from cohort.sources.fixtures import students

ALL = ("student_id, programme, support_band, tutor_ref, studytime, absences, failures, g1, g2, g3, result, "
       "recorded_at")
NUMS = ["studytime", "absences", "failures", "g1", "g2", "g3"]
CATS = ["programme", "support_band", "result"]


@register("dedup_rows", f"WITH {STUDENTS}\nSELECT DISTINCT {ALL} FROM students")
def q_dedup_rows(spark, sf_dir):
    return clean.dedup_rows(students(spark, sf_dir))


@register("clean_names", f"WITH {STUDENTS}\nSELECT DISTINCT {ALL} FROM students")
def q_clean_names(spark, sf_dir):
    return clean.clean_names(students(spark, sf_dir))


@register("select_typed", f"WITH {STUDENTS}\nSELECT student_id, studytime, absences, failures, g1, g2, g3 FROM students")
def q_select_typed(spark, sf_dir):
    return clean.select_typed(students(spark, sf_dir), "numeric")


@register("select_typed_categorical", f"WITH {STUDENTS}\nSELECT programme, support_band, tutor_ref, result FROM students")
def q_select_typed_categorical(spark, sf_dir):
    return clean.select_typed(students(spark, sf_dir), "categorical")


@register("select_typed_datetime", f"WITH {STUDENTS}\nSELECT recorded_at FROM students")
def q_select_typed_datetime(spark, sf_dir):
    return clean.select_typed(students(spark, sf_dir), "datetime")


@register("drop_unlabelled", f"WITH {STUDENTS}\nSELECT {ALL} FROM students WHERE ({TARGET_SQL}) IS NOT NULL")
def q_drop_unlabelled(spark, sf_dir):
    df = students(spark, sf_dir)
    return clean.drop_unlabelled(df, normalize_target(col("result")))


@register("drop_all_missing_rows", f"WITH {STUDENTS}\nSELECT {ALL} FROM students "
                                   "WHERE g1 IS NOT NULL OR g3 IS NOT NULL OR absences IS NOT NULL")
def q_drop_all_missing(spark, sf_dir):
    out, _ = clean.drop_all_missing(students(spark, sf_dir), ["g1", "g3", "absences"])
    return out


@register("preview", f"WITH {STUDENTS}\nSELECT student_id, programme, g1 FROM students ORDER BY student_id, programme, g1 LIMIT 20")
def q_preview(spark, sf_dir):
    return students(spark, sf_dir).select("student_id", "programme", "g1").orderBy(
        "student_id", "programme", "g1").limit(20)


def _impute_sql(cols, centre):
    med = ", ".join(f"median({c}) AS m_{c}" for c in cols)
    filled = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in cols)
    stats = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    if centre is None:
        sel = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)
    else:
        sel = ", ".join(
            f"round(({c}{' - a_' + c if centre else ''}) / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END), 6) AS {c}"
            for c in cols)
    return (f"WITH {STUDENTS}, m AS (SELECT {med} FROM students),\n"
            f"f AS (SELECT student_id, {filled} FROM students, m),\n"
            f"s AS (SELECT {stats} FROM f)\n"
            f"SELECT student_id, {sel} FROM f, s")


@register("impute_median", _impute_sql(["g1", "g3", "absences"], None))
def q_impute_median(spark, sf_dir):
    df = students(spark, sf_dir)
    prep = clean.FeaturePrep.fit(df, ["g1", "g3", "absences"], [])
    return finish(df.select("student_id", *[F.coalesce(clean.num(df, c), F.lit(prep.medians[c])).alias(c)
                                            for c in ["g1", "g3", "absences"]]))


@register("scale_std", _impute_sql(["g1", "g3", "absences"], True))
def q_scale_std(spark, sf_dir):
    df = students(spark, sf_dir)
    prep = clean.FeaturePrep.fit(df, ["g1", "g3", "absences"], [], with_mean=True)
    return finish(prep.transform(df, keep=["student_id"]))


@register("impute_constant", f"WITH {STUDENTS}\nSELECT student_id, coalesce(CAST(result AS VARCHAR), 'Missing') AS result FROM students")
def q_impute_constant(spark, sf_dir):
    df = students(spark, sf_dir)
    return df.select("student_id", F.coalesce(col("result").cast("string"), F.lit(clean.MISSING)).alias("result"))


def _onehot_sql(src, cats):
    return "\nUNION ALL\n".join(
        f"SELECT student_id, '{c}_' || coalesce(CAST({c} AS VARCHAR), 'Missing') AS feature, 1.0::DOUBLE AS value FROM {src}"
        for c in cats)


@register("one_hot", f"WITH {STUDENTS}\n{_onehot_sql('students', CATS)}")
def q_one_hot(spark, sf_dir):
    df = students(spark, sf_dir)
    prep = clean.FeaturePrep.fit(df, [], CATS)
    return finish(prep.transform_sparse(df, ["student_id"]))


def _feature_matrix_sql():
    med = ", ".join(f"median({c}) AS m_{c}" for c in NUMS)
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in NUMS)
    stats = ", ".join(f"stddev_pop({c}) AS s_{c}" for c in NUMS)
    nums = "\nUNION ALL\n".join(
        f"SELECT student_id, '{c}' AS feature, round({c} / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END), 6) AS value FROM f, s"
        for c in NUMS)
    return (f"WITH {STUDENTS}, d AS (SELECT DISTINCT {ALL} FROM students),\n"
            f"m AS (SELECT {med} FROM d),\nf AS (SELECT student_id, {filled} FROM d, m),\n"
            f"s AS (SELECT {stats} FROM f)\n{nums}\nUNION ALL\n{_onehot_sql('d', CATS)}")


@register("feature_matrix", _feature_matrix_sql())
def q_feature_matrix(spark, sf_dir):
    matrix, _, _, _ = clean.feature_matrix(students(spark, sf_dir), keep=["student_id"])
    return finish(matrix)


@register("model_features", f"WITH {STUDENTS}\nSELECT student_id, CAST(studytime AS DOUBLE) AS study_time, "
                            "CAST(absences AS DOUBLE) AS absences, CAST(failures AS DOUBLE) AS failures, "
                            "g1 AS previous_grade_1, g2 AS previous_grade_2 FROM students")
def q_model_features(spark, sf_dir):
    df = students(spark, sf_dir)
    roles = detect_roles(df)
    feats, _, _ = clean.model_features(df, roles.prediction_features, keep=["student_id"])
    return finish(feats)


@register("absence_transform", f"""WITH {STUDENTS},
m AS (SELECT greatest(CAST(max(absences) AS DOUBLE), 1.0) AS amax FROM students),
a AS (SELECT student_id, CASE WHEN absences IS NOT NULL THEN least(greatest(1.0 - absences / amax, 0.0), 1.0) END AS attendance_rate FROM students, m)
SELECT student_id, round(CASE WHEN attendance_rate IS NOT NULL THEN (1.0 - least(greatest(attendance_rate, 0.0), 1.0)) * 100 END, 6) AS absences FROM a""")
def q_absence_transform(spark, sf_dir):
    df = students(spark, sf_dir)
    amax = max(float(df.agg(F.max("absences")).first()[0] or 0), 1.0)
    rated = df.select("student_id", clip(F.lit(1.0) - F.col("absences") / F.lit(amax), 0.0, 1.0).alias("attendance_rate"))
    feats, modes, _ = clean.model_features(rated, {"absences": "attendance_rate"}, keep=["student_id"])
    return finish(feats.select("student_id", "absences"))


@register("field_ranges", f"""WITH {STUDENTS}
SELECT 'study_time' AS field, CAST(min(studytime) AS DOUBLE) AS min, CAST(greatest(min(studytime) + 1, max(studytime)) AS DOUBLE) AS max,
  CASE WHEN sum(studytime % 1) = 0 THEN 1.0 ELSE 0.5 END AS step,
  least(greatest(median(studytime), min(studytime)), greatest(min(studytime) + 1, max(studytime)))::DOUBLE AS "default" FROM students
UNION ALL SELECT 'absences', 0.0, greatest(20, ceil(max(absences)))::DOUBLE, 1.0, least(median(absences), greatest(20, ceil(max(absences))))::DOUBLE FROM students
UNION ALL SELECT 'failures', 0.0, greatest(4, ceil(max(failures)))::DOUBLE, 1.0, least(median(failures), greatest(4, ceil(max(failures))))::DOUBLE FROM students
UNION ALL SELECT 'previous_grade_1', 0.0, greatest(20, ceil(max(g1)))::DOUBLE, 1.0, least(greatest(median(g1), 0.0), greatest(20, ceil(max(g1))))::DOUBLE FROM students
UNION ALL SELECT 'previous_grade_2', 0.0, greatest(20, ceil(max(g2)))::DOUBLE, 1.0, least(greatest(median(g2), 0.0), greatest(20, ceil(max(g2))))::DOUBLE FROM students""")
def q_field_ranges(spark, sf_dir):
    df = students(spark, sf_dir)
    return finish(clean.field_ranges(df, detect_roles(df).prediction_features))


def _check_sql():
    parts = []
    for f, src, (lo, hi, label) in [("study_time", "studytime", clean.DEFAULT_LIMITS["study_time"]),
                                     ("absences", "absences", clean.DEFAULT_LIMITS["absences"]),
                                     ("failures", "failures", clean.DEFAULT_LIMITS["failures"]),
                                     ("previous_grade_1", "g1", clean.DEFAULT_LIMITS["previous_grade_1"]),
                                     ("previous_grade_2", "g2", clean.DEFAULT_LIMITS["previous_grade_2"])]:
        parts.append(f"CASE WHEN {src} IS NULL THEN '{label} is required.' "
                     f"WHEN {src} < {lo} OR {src} > {hi} THEN '{label} must be between {clean._fmt(lo)} and {clean._fmt(hi)}.' END")
    msgs = "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
    return (f"WITH {STUDENTS}\nSELECT student_id, len({msgs}) = 0 AS valid, "
            f"array_to_string({msgs}, '; ') AS errors FROM students")


@register("scoring_input_check", _check_sql())
def q_scoring_input_check(spark, sf_dir):
    df = students(spark, sf_dir)
    feats, _, _ = clean.model_features(df, detect_roles(df).prediction_features, keep=["student_id"])
    checked = clean.scoring_input_check(feats)
    return checked.select("student_id", (F.size("errors") == 0).alias("valid"),
                          F.array_join("errors", "; ").alias("errors"))


def _audit_sql():
    """The audit's facts: 'tutor_ref' is left out where it has more than 30 levels, else its levels are encoded too."""
    cats = " UNION ALL ".join(f"SELECT '{c}' AS c, coalesce(CAST({c} AS VARCHAR), 'Missing') AS v FROM d" for c in [*CATS, "tutor_ref"])
    present = " + ".join(f"count({c})" for c in ALL.split(", "))
    steps = ["n", "12", "n - nd", "nd", "12 * n - present", "0", str(len(NUMS)), "3 + (1 - wide)", "1", "wide", "30", "made", "nd", f"{len(NUMS)} + made"]
    rows = " UNION ALL ".join(f"SELECT '{s}' AS step, CAST({x} AS BIGINT) AS result FROM t" for s, x in zip(clean.AUDIT_STEPS, steps))
    return f"""WITH {STUDENTS}, d AS (SELECT DISTINCT {ALL} FROM students),
k AS (SELECT CASE WHEN count(DISTINCT tutor_ref) > 30 THEN 1 ELSE 0 END AS wide FROM d),
l AS (SELECT DISTINCT c, v FROM ({cats}) x, k WHERE c <> 'tutor_ref' OR wide = 0),
t AS (SELECT (SELECT count(*) FROM students) AS n, (SELECT count(*) FROM d) AS nd, (SELECT {present} FROM students) AS present,
        (SELECT count(*) FROM l) AS made, wide FROM k)
{rows}"""


@register("audit_rows", _audit_sql())
def q_audit_rows(spark, sf_dir):
    return clean.audit_rows(students(spark, sf_dir))


@register("drop_all_missing_columns", f"WITH {STUDENTS}\nSELECT student_id, g1, g3 FROM students "
                                      "WHERE g1 IS NOT NULL OR g3 IS NOT NULL")
def q_drop_all_missing_columns(spark, sf_dir):
    # 'g_unreleased' is a score column with no values yet (entirely NULL): it is removed first,
    # then rows missing every remaining column go
    df = students(spark, sf_dir).withColumn("g_unreleased", F.when(F.col("g1") > 1e9, F.col("g1")))
    out, kept = clean.drop_all_missing(df, ["g1", "g_unreleased", "g3"])
    return out.select("student_id", *kept)
