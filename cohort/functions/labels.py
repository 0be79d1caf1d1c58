"""Labelling expressions: Pass/Fail tokens, risk categories, risk levels,
recommendations and confidence bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohort.functions.exprs import clip, normalize_name

# ---- fixed values (must equal the reference's vocabularies) ----------------
PASS = "Pass"
FAIL = "Fail"
PASS_TOKENS = ["pass", "passed", "yes", "y", "true", "1", "successful"]
FAIL_TOKENS = ["fail", "failed", "no", "n", "false", "0", "unsuccessful"]
ABSENCE_NAMES = ["absences", "absence", "classesmissed"]
RISK_HIGH = "High Performers"
RISK_AVERAGE = "Average Progress"
RISK_AT = "At-Risk Students"
LEVEL_LOW = "Low Risk"
LEVEL_MODERATE = "Moderate Risk"
LEVEL_HIGH = "High Risk"
ACTION_ABSENCES = "reduce absenteeism and restore regular class participation"
ACTION_FAILURES = "prioritize remediation in previously failed subjects"
ACTION_GRADES = "strengthen revision on weak topics before the next assessment"
ACTION_STUDY = "increase weekly study time with a structured revision plan"
BASE_PASS_LOW = "The student is trending positively and is likely to maintain a passing outcome."
BASE_PASS = "The student is currently on a passing path, but the academic profile still needs monitoring."
BASE_MODERATE = "The student needs targeted academic support to avoid slipping into a failing outcome."
BASE_HIGH = "The student is at high risk of failing and needs immediate academic intervention."
NO_ACTION_TAIL = " Continue guided practice, weekly review, and close progress tracking."
CONFIDENCE_MIXED = "Low separation between outcomes; this case should be reviewed carefully."
CONFIDENCE_MODERATE = "Moderate confidence; this is better treated as an early-warning signal than a final judgment."
CONFIDENCE_CLEAR = "Higher confidence; the model shows a clearer separation between Pass and Fail for this profile."
# ---------------------------------------------------------------------------


def is_absence_name(name: str | None) -> bool:
    return name is not None and normalize_name(name) in ABSENCE_NAMES


def normalize_target(c: Column) -> Column:
    """Map free-text outcome tokens to 'Pass' / 'Fail'; anything else is NULL."""
    token = F.lower(F.trim(c.cast("string")))
    return (F.when(token.isin(PASS_TOKENS), F.lit(PASS))
            .when(token.isin(FAIL_TOKENS), F.lit(FAIL)))


def derive_target(mean_score: Column, threshold: float, null_policy: str = "null") -> Column:
    """Pass when the (unscaled) mean score reaches the threshold.

    ``null_policy='fail'`` mirrors model training, where a missing mean compares
    false and therefore labels the row Fail; ``'null'`` mirrors the KPI view.
    """
    labelled = F.when(mean_score >= F.lit(float(threshold)), F.lit(PASS))
    if null_policy == "fail":
        return labelled.otherwise(F.lit(FAIL))
    return labelled.when(mean_score.isNotNull(), F.lit(FAIL))


def attendance_percent(values: Column, is_absence: bool, max_value) -> Column:
    """Attendance on a 0-100 scale.

    Absence counts become ``1 - a / max(max_a, 1)`` clipped to [0, 1]; other
    attendance columns are rescaled by the column maximum (0-1 and 0-20 forms).
    """
    if is_absence:
        denom = max(float(max_value), 1.0) if max_value is not None else 1.0
        return clip(F.lit(1.0) - values / F.lit(denom), 0.0, 1.0) * 100
    if max_value is None:
        return F.when(values <= 1.5, values * 100).otherwise(values)
    if max_value <= 1.5:
        return values * 100
    if max_value <= 20:
        return values * 5
    return values


def risk_category(target: Column | None, avg: Column | None, attendance: Column | None) -> Column:
    """Rule-based risk label.

    The rules are applied as overrides in this order: score bands, attendance
    bands, then the target.  Written as one first-match chain:
    (1) Pass and avg >= 75 -> High (Pass alone when there are no scores);
    (2) Fail -> At-Risk; (3) attendance < 75 -> At-Risk; (4) avg < 60 -> At-Risk;
    (5) 75 <= attendance < 88 -> Average; (6) avg >= 75 -> High; else Average.
    """
    chain = None

    def add(cond, label):
        nonlocal chain
        chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))

    if target is not None:
        add(target == PASS if avg is None else (target == PASS) & (avg >= 75), RISK_HIGH)
        add(target == FAIL, RISK_AT)
    if attendance is not None:
        add(attendance < 75, RISK_AT)
    if avg is not None:
        add(avg < 60, RISK_AT)
    if attendance is not None:
        add((attendance >= 75) & (attendance < 88), RISK_AVERAGE)
    if avg is not None:
        add(avg >= 75, RISK_HIGH)
    if chain is None:
        return F.lit(RISK_AVERAGE)
    return chain.otherwise(F.lit(RISK_AVERAGE))


def risk_level(pass_probability: Column) -> Column:
    return (F.when(pass_probability >= 0.75, F.lit(LEVEL_LOW))
            .when(pass_probability >= 0.5, F.lit(LEVEL_MODERATE))
            .otherwise(F.lit(LEVEL_HIGH)))


def recommendation(label: Column, level: Column, study_time: Column, absences: Column,
                   failures: Column, grade_average: Column) -> Column:
    """Base message by (label, risk level) plus up to three actions."""
    actions = F.array_compact(F.array(
        F.when(absences >= 10, F.lit(ACTION_ABSENCES)),
        F.when(failures >= 2, F.lit(ACTION_FAILURES)),
        F.when(grade_average < 10, F.lit(ACTION_GRADES)),
        F.when(study_time <= 1, F.lit(ACTION_STUDY)),
    ))
    base = (F.when((label == PASS) & (level == LEVEL_LOW), F.lit(BASE_PASS_LOW))
            .when(label == PASS, F.lit(BASE_PASS))
            .when(level == LEVEL_MODERATE, F.lit(BASE_MODERATE))
            .otherwise(F.lit(BASE_HIGH)))
    return F.when(F.size(actions) == 0, F.concat(base, F.lit(NO_ACTION_TAIL))).otherwise(
        F.concat(base, F.lit(" Recommended action: "),
                 F.array_join(F.slice(actions, 1, 3), ", "), F.lit(".")))


def confidence_band(pass_probability: Column, fail_probability: Column) -> Column:
    gap = F.abs(pass_probability - fail_probability)
    winner = F.greatest(pass_probability, fail_probability)
    return (F.when(gap < 0.1, F.lit(CONFIDENCE_MIXED))
            .when(winner < 0.7, F.lit(CONFIDENCE_MODERATE))
            .otherwise(F.lit(CONFIDENCE_CLEAR)))
