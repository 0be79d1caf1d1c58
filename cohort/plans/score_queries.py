"""Catalog entries: scoring, labels on probabilities, recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.functions import labels as L
from cohort.operators import clean, score
from cohort.operators.roles import detect_roles
from cohort.plans.common import register, finish, STUDENTS
from cohort.sources.fixtures import stored_students

# Fixed example coefficients for the literal-coefficient scorer (parameters, not fitted).
WEIGHTS = {"study_time": 0.8, "absences": -0.3, "failures": -0.9, "previous_grade_1": 0.5, "previous_grade_2": 0.7}
INTERCEPT = 0.2


def _linear(spark, sf_dir):
    """Every request of the fixture: limits come from the data, rejected requests keep their errors."""
    df = stored_students(spark, sf_dir)
    mapping = detect_roles(df).prediction_features
    feats, _, _ = clean.model_features(df, mapping, keep=["student_id"])
    checked = clean.scoring_input_check(feats, clean.data_limits(clean.field_ranges(df, mapping)))
    valid = checked.where(F.size("errors") == 0).drop("errors")
    st = valid.agg(*[F.avg(f).alias(f"a_{f}") for f in WEIGHTS], *[F.stddev_pop(f).alias(f"s_{f}") for f in WEIGHTS]).first()
    centre = {f: st[f"a_{f}"] for f in WEIGHTS}
    scale = {f: st[f"s_{f}"] for f in WEIGHTS}
    return score.with_rejects(score.score_linear(valid, WEIGHTS, INTERCEPT, centre, scale), checked.where(F.size("errors") > 0))


def sql_linear(centred: bool = True) -> str:
    """The scoring chain in SQL, ending in table x; ``centred``: features are standardised first."""
    limits = {"study_time": ("min(studytime)", "greatest(min(studytime) + 1, max(studytime))"), "absences": ("0", "greatest(20, ceil(max(absences)))"),
              "failures": ("0", "greatest(4, ceil(max(failures)))"), "previous_grade_1": ("0", "greatest(20, ceil(max(g1)))"),
              "previous_grade_2": ("0", "greatest(20, ceil(max(g2)))")}
    lim = ", ".join(f"CAST({lo} AS DOUBLE) AS lo_{f}, CAST({hi} AS DOUBLE) AS hi_{f}" for f, (lo, hi) in limits.items())
    msgs = ", ".join(f"CASE WHEN {f} IS NULL THEN '{clean.FIELD_LABELS[f]} is required.' WHEN {f} < lo_{f} OR {f} > hi_{f} THEN "
                     f"'{clean.FIELD_LABELS[f]} must be between ' || lo_{f} || ' and ' || hi_{f} || '.' END" for f in limits)
    stats = ", ".join(f"avg({f}) AS a_{f}, stddev_pop({f}) AS s_{f}" for f in WEIGHTS)
    z = f"{INTERCEPT!r}" + "".join(
        f" + {w!r} * (({f} - a_{f}) / (CASE WHEN s_{f} = 0 OR s_{f} IS NULL THEN 1.0 ELSE s_{f} END))" if centred else f" + {w!r} * {f}"
        for f, w in WEIGHTS.items())
    acts = (f"list_filter([CASE WHEN absences >= 10 THEN '{L.ACTION_ABSENCES}' END, "
            f"CASE WHEN failures >= 2 THEN '{L.ACTION_FAILURES}' END, "
            f"CASE WHEN (previous_grade_1 + previous_grade_2) / 2 < 10 THEN '{L.ACTION_GRADES}' END, "
            f"CASE WHEN study_time <= 1 THEN '{L.ACTION_STUDY}' END], lambda x: x IS NOT NULL)")
    return f"""WITH {STUDENTS},
f AS (SELECT student_id, CAST(studytime AS DOUBLE) AS study_time, CAST(absences AS DOUBLE) AS absences,
             CAST(failures AS DOUBLE) AS failures, g1 AS previous_grade_1, g2 AS previous_grade_2 FROM students),
lim AS (SELECT {lim} FROM students),
ch AS (SELECT f.*, array_to_string(list_filter([{msgs}], lambda x: x IS NOT NULL), '; ') AS errors FROM f, lim),
v AS (SELECT * EXCLUDE (errors) FROM ch WHERE errors = ''),
st AS (SELECT {stats} FROM v),
p AS (SELECT v.*, 1 / (1 + exp(-({z}))) AS pass_probability FROM v, st),
o AS (SELECT p.*, CASE WHEN pass_probability >= 0.5 THEN 'Pass' ELSE 'Fail' END AS predicted_label,
        1 - pass_probability AS fail_probability,
        CASE WHEN pass_probability >= 0.75 THEN '{L.LEVEL_LOW}' WHEN pass_probability >= 0.5 THEN '{L.LEVEL_MODERATE}'
             ELSE '{L.LEVEL_HIGH}' END AS risk_level, {acts} AS acts FROM p),
r AS (SELECT o.*, greatest(pass_probability, fail_probability) AS confidence,
        CASE WHEN predicted_label = 'Pass' AND risk_level = '{L.LEVEL_LOW}' THEN '{L.BASE_PASS_LOW}'
             WHEN predicted_label = 'Pass' THEN '{L.BASE_PASS}' WHEN risk_level = '{L.LEVEL_MODERATE}' THEN '{L.BASE_MODERATE}'
             ELSE '{L.BASE_HIGH}' END AS base,
        CASE WHEN abs(pass_probability - fail_probability) < 0.1 THEN '{L.CONFIDENCE_MIXED}'
             WHEN greatest(pass_probability, fail_probability) < 0.7 THEN '{L.CONFIDENCE_MODERATE}'
             ELSE '{L.CONFIDENCE_CLEAR}' END AS confidence_note FROM o),
y AS (SELECT r.*, CASE WHEN len(acts) = 0 THEN base || '{L.NO_ACTION_TAIL}'
        ELSE base || ' Recommended action: ' || array_to_string(list_slice(acts, 1, 3), ', ') || '.' END AS recommendation FROM r),
x AS (SELECT student_id, study_time, absences, failures, previous_grade_1, previous_grade_2, pass_probability, predicted_label, fail_probability,
        confidence, risk_level, recommendation, confidence_note, CAST(NULL AS VARCHAR) AS errors FROM y
      UNION ALL SELECT student_id, study_time, absences, failures, previous_grade_1, previous_grade_2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, errors
      FROM ch WHERE errors <> '')"""


LIN = sql_linear()


@register("score_linear", LIN + """
SELECT student_id, round(pass_probability, 6) AS pass_probability, predicted_label, round(fail_probability, 6) AS fail_probability,
       round(confidence, 6) AS confidence, risk_level, recommendation, confidence_note, errors FROM x""")
def q_score_linear(spark, sf_dir):
    s = _linear(spark, sf_dir)
    return finish(s.select("student_id", "pass_probability", "predicted_label", "fail_probability", "confidence",
                           "risk_level", "recommendation", "confidence_note", "errors"))


@register("risk_level", LIN + "\nSELECT student_id, risk_level FROM x")
def q_risk_level(spark, sf_dir):
    return _linear(spark, sf_dir).select("student_id", "risk_level")


@register("recommendation", LIN + "\nSELECT student_id, recommendation FROM x")
def q_recommendation(spark, sf_dir):
    return _linear(spark, sf_dir).select("student_id", "recommendation")


@register("confidence_band", LIN + "\nSELECT student_id, confidence_note FROM x")
def q_confidence_band(spark, sf_dir):
    return _linear(spark, sf_dir).select("student_id", "confidence_note")


@register("score_table")
def q_score_table(spark, sf_dir):
    df = stored_students(spark, sf_dir)
    roles = detect_roles(df)
    from cohort.operators import kpi
    target = kpi.target_column(df, roles, kpi.scale_stats(df, roles), "fail")
    feats, _, _ = clean.model_features(df.withColumn("_t", target), roles.prediction_features, keep=["student_id", "_t"])
    model, _ = score.train_scoring_model(feats, F.col("_t"))
    limits = clean.data_limits(clean.field_ranges(df, roles.prediction_features))
    return score.with_rejects(*score.score_table(model, feats.drop("_t"), ["student_id"], limits))


@register("score_average")
def q_score_average(spark, sf_dir):
    from cohort.operators import models
    s = stored_students(spark, sf_dir, distinct=True)
    features = ["studytime", "absences", "failures", "programme"]
    model, _, _ = models.train_forest_regressor(s, features, "g3", "student_id")
    return models.scored_once(model, s.select("student_id", *features), features) \
        .select("student_id", F.col("prediction").alias("predicted_average"))
