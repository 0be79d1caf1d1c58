"""Key figures: entity counts, average score and attendance, pass/fail rates,
risk categories and the grouped KPI snapshot.

Two passes at most: one global aggregate for the scale facts (score maximum,
attendance maximum) and one aggregate for all figures, optionally grouped.
Both are partial (map-side) aggregates, so a hot group key only costs one
pre-aggregated row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.operators.ordered import exact_percentiles
from cohort.functions.exprs import col, num, row_mean, greatest_of, scale_factor, pass_mark, normalize_name
from cohort.functions.labels import (PASS, FAIL, RISK_HIGH, RISK_AVERAGE, RISK_AT, normalize_target,
                                     derive_target, attendance_percent, risk_category, is_absence_name)
from cohort.operators.roles import RoleMap

AVG = "_avg"          # scaled row mean of the score columns (percent scale)
TARGET = "_target"    # Pass / Fail / NULL
ATT = "_att"          # attendance on a 0-100 scale
RISK = "_risk"        # rule-based risk category


@dataclass
class ScaleStats:
    score_max: float | None
    perf_max: float | None
    attendance_max: float | None
    target_labels: int


def _score_cols(df: DataFrame, roles: RoleMap) -> list[str]:
    return [c for c in roles.scores if c in df.columns]


def _target_score_cols(df: DataFrame, roles: RoleMap) -> list[str]:
    scores = _score_cols(df, roles)
    return [c for c in roles.performance if c in scores] or scores


def _max_of(values):
    vals = [v for v in values if v is not None]
    return max(vals) if vals else None


def scale_stats(df: DataFrame, roles: RoleMap) -> ScaleStats:
    """The facts that choose scales and thresholds.

    Taken from the role-detection pass when it covered these columns (no job);
    otherwise one global aggregate.
    """
    scores = _score_cols(df, roles)
    perf = _target_score_cols(df, roles)
    needed = scores + ([roles.attendance] if roles.attendance else []) + ([roles.target] if roles.target else [])
    same_source = roles.source_hash is not None and roles.source_hash == df.semanticHash()
    if same_source and roles.column_max and all(c in roles.column_max for c in needed):
        att = roles.column_max.get(roles.attendance) if roles.attendance else None
        labels = roles.label_words.get(roles.target, 0) if roles.target else 0
        return ScaleStats(_max_of(roles.column_max[c] for c in scores), _max_of(roles.column_max[c] for c in perf),
                          att, labels or 0)
    aggs = [F.lit(None).cast("double").alias("score_max"), F.lit(None).cast("double").alias("perf_max"),
            F.lit(None).cast("double").alias("att_max"), F.lit(0).cast("long").alias("target_labels")]
    if scores:
        aggs[0] = F.max(greatest_of([num(df, c) for c in scores])).alias("score_max")
        aggs[1] = F.max(greatest_of([num(df, c) for c in perf])).alias("perf_max")
    if roles.attendance and roles.attendance in df.columns:
        aggs[2] = F.max(num(df, roles.attendance)).alias("att_max")
    if roles.target and roles.target in df.columns:
        aggs[3] = F.count(normalize_target(col(roles.target))).alias("target_labels")
    row = df.agg(*aggs).first()
    return ScaleStats(row.score_max, row.perf_max, row.att_max, row.target_labels)


def target_column(df: DataFrame, roles: RoleMap, stats: ScaleStats, null_policy: str = "null") -> Column | None:
    """Existing Pass/Fail column when it has labels, else derived from scores."""
    if roles.target and roles.target in df.columns and stats.target_labels > 0:
        return normalize_target(col(roles.target))
    perf = _target_score_cols(df, roles)
    if not perf:
        return None
    raw_mean = row_mean([num(df, c) for c in perf])
    return derive_target(raw_mean, pass_mark(stats.perf_max), null_policy)


def avg_column(df: DataFrame, roles: RoleMap, stats: ScaleStats) -> Column | None:
    scores = _score_cols(df, roles)
    if not scores:
        return None
    return row_mean([num(df, c) for c in scores]) * F.lit(scale_factor(stats.score_max))


def attendance_column(df: DataFrame, roles: RoleMap, stats: ScaleStats) -> Column | None:
    if not roles.attendance or roles.attendance not in df.columns:
        return None
    return attendance_percent(num(df, roles.attendance), is_absence_name(roles.attendance),
                              stats.attendance_max)


def prepare(df: DataFrame, roles: RoleMap, stats: ScaleStats | None = None, keep: list[str] | None = None,
            null_policy: str = "null") -> tuple[DataFrame, ScaleStats]:
    """Add _avg, _target, _att, _risk (and keep only what the caller needs)."""
    stats = stats or scale_stats(df, roles)
    avg = avg_column(df, roles, stats)
    tgt = target_column(df, roles, stats, null_policy)
    att = attendance_column(df, roles, stats)
    exprs = [col(c) for c in (keep if keep is not None else df.columns)]
    exprs += [(avg if avg is not None else F.lit(None).cast("double")).alias(AVG),
              (tgt if tgt is not None else F.lit(None).cast("string")).alias(TARGET),
              (att if att is not None else F.lit(None).cast("double")).alias(ATT),
              risk_category(tgt, avg, att).alias(RISK)]
    return df.select(*exprs), stats


def _kpi_aggs(df: DataFrame, roles: RoleMap, stats: ScaleStats, cluster_at_risk: Column | None = None):
    scores = _score_cols(df, roles)
    factor = scale_factor(stats.score_max)
    aggs = []
    if roles.student_id and roles.student_id in df.columns:
        total = F.coalesce(F.nullif(F.count_distinct(col(roles.student_id)), F.lit(0)), F.count(F.lit(1)))
    else:
        total = F.count(F.lit(1))
    aggs.append(total.cast("long").alias("total_entities"))
    if scores:
        cell_sum = F.coalesce(F.sum(num(df, scores[0])), F.lit(0.0))
        for c in scores[1:]:
            cell_sum = cell_sum + F.coalesce(F.sum(num(df, c)), F.lit(0.0))
        cell_cnt = sum((F.count(num(df, c)) for c in scores[1:]), F.count(num(df, scores[0])))
        aggs.append((F.try_divide(cell_sum, F.nullif(cell_cnt, F.lit(0))) * F.lit(factor)).alias("average_score"))
    else:
        aggs.append(F.lit(None).cast("double").alias("average_score"))
    aggs.append(F.avg(ATT).alias("average_attendance"))
    if roles.attendance and is_absence_name(roles.attendance):
        aggs.append(F.avg(num(df, roles.attendance)).alias("average_absences"))
    else:
        aggs.append(F.lit(None).cast("double").alias("average_absences"))
    n_pass = F.count_if(F.col(TARGET) == PASS)
    n_fail = F.count_if(F.col(TARGET) == FAIL)
    labelled = F.nullif(n_pass + n_fail, F.lit(0))
    aggs += [n_pass.alias("pass_count"), n_fail.alias("fail_count"),
             (n_pass * 100.0 / labelled).alias("pass_rate"),
             (n_fail * 100.0 / labelled).alias("fail_rate"),
             F.count_if(F.col(RISK) == RISK_HIGH).alias("high_performers"),
             F.count_if(F.col(RISK) == RISK_AVERAGE).alias("average_progress"),
             F.count_if(F.col(RISK) == RISK_AT).alias("at_risk_students"),
             (cluster_at_risk if cluster_at_risk is not None else n_fail).alias("at_risk_count")]
    return aggs


KPI_COLUMNS = ["total_entities", "average_score", "average_attendance", "average_absences", "pass_count",
               "fail_count", "pass_rate", "fail_rate", "high_performers", "average_progress",
               "at_risk_students", "at_risk_count"]


def kpi_snapshot(df: DataFrame, roles: RoleMap, by: list[str] | None = None,
                 stats: ScaleStats | None = None) -> DataFrame:
    """All dashboard figures in one aggregate; grouped by ``by`` when given."""
    by = by or []
    needed = list(dict.fromkeys(by + [c for c in [roles.student_id, roles.target, roles.attendance]
                                      if c and c in df.columns] + _score_cols(df, roles)))
    prepared, stats = prepare(df, roles, stats, keep=needed)
    aggs = _kpi_aggs(prepared, roles, stats)
    out = prepared.groupBy(*[col(c) for c in by]).agg(*aggs) if by else prepared.agg(*aggs)
    return out


def kpi_long(snapshot: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(metric, value) long form of a snapshot."""
    by = by or []
    metrics = [c for c in snapshot.columns if c not in by]
    return snapshot.select(*[col(c) for c in by], F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), col(m).cast("double").alias("value")) for m in metrics])))


def risk_breakdown(df: DataFrame, roles: RoleMap, by: list[str] | None = None) -> DataFrame:
    prepared, _ = prepare(df, roles, keep=list(dict.fromkeys((by or []) + [
        c for c in [roles.target, roles.attendance] if c] + _score_cols(df, roles))))
    return prepared.groupBy(*[col(c) for c in (by or [])], F.col(RISK).alias("risk_category")).agg(
        F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, roles: RoleMap, null_policy: str = "fail") -> DataFrame:
    """Counts per Pass/Fail label over labelled rows (training view)."""
    stats = scale_stats(df, roles)
    tgt = target_column(df, roles, stats, null_policy)
    return (df.select(tgt.alias("class")).where(F.col("class").isNotNull())
            .groupBy("class").agg(F.count(F.lit(1)).alias("records")))


def subject_means(df: DataFrame, roles: RoleMap, stats: ScaleStats | None = None) -> DataFrame:
    """Average per score column on the percent scale, highest first."""
    scores = _score_cols(df, roles)
    stats = stats or scale_stats(df, roles)
    factor = scale_factor(stats.score_max)
    wide = df.agg(*[(F.avg(num(df, c)) * F.lit(factor)).alias(f"m{i}") for i, c in enumerate(scores)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("subject"), F.col(f"m{i}").alias("average_score"))
        for i, c in enumerate(scores)])))


GROUP_BLOCKED = ["pass", "fail", "status", "result", "outcome", "id"]


def group_candidates(df: DataFrame) -> list[str]:
    """Non-numeric, non-datetime columns whose names carry no outcome / id token."""
    from cohort.functions.exprs import is_numeric_type, is_datetime_type
    return [f.name for f in df.schema.fields
            if not any(k in normalize_name(f.name) for k in GROUP_BLOCKED)
            and not is_numeric_type(f.dataType) and not is_datetime_type(f.dataType)]


def group_columns(df: DataFrame, distinct_counts: dict[str, int] | None = None, max_levels: int = 12) -> list[str]:
    """Categorical columns usable for group insights (2..12 levels, no outcome/id names).

    Without given counts, one profile pass counts the distinct values of all candidates exactly.
    """
    cands = group_candidates(df)
    if distinct_counts is None:
        from cohort.operators.profile import distinct_counts as exact_counts
        if not cands:
            return []
        distinct_counts = exact_counts(df, cands)
    return [c for c in cands if 1 < distinct_counts.get(c, 0) <= max_levels]


def top_group(df: DataFrame, roles: RoleMap, candidates: list[str] | None = None) -> DataFrame:
    """Best (column, level) by mean row score over all categorical group columns.

    Ties: earlier column, then smaller level.  One unpivot + one grouped
    aggregate; no per-column jobs.
    """
    if candidates is None:
        candidates = group_columns(df)
    prepared, _ = prepare(df, roles, keep=candidates + [c for c in _score_cols(df, roles)])
    if not candidates:
        return prepared.sparkSession.createDataFrame([], "group_column string, level string, average_score double")
    positions = {c: i for i, c in enumerate(df.columns)}
    long = prepared.select(F.col(AVG), F.inline(F.array(*[
        F.struct(F.lit(c).alias("group_column"), F.lit(positions[c]).alias("pos"),
                 col(c).cast("string").alias("level")) for c in candidates])))
    means = (long.where(F.col("level").isNotNull())
             .groupBy("group_column", "pos", "level").agg(F.avg(AVG).alias("average_score"))
             .where(F.col("average_score").isNotNull()))
    return (means.orderBy(F.desc("average_score"), F.asc("pos"), F.asc("level")).limit(1)
            .select("group_column", "level", "average_score"))


def mean_by_group(df: DataFrame, x: str, y: str) -> DataFrame:
    """Average of y per category x (null groups dropped), highest first."""
    return (df.where(col(x).isNotNull())
            .groupBy(col(x).alias(x)).agg(F.avg(num(df, y)).alias(f"mean_{y}"))
            .orderBy(F.desc(f"mean_{y}"), F.asc(x)))


STUDY_NAMES = ["studytime", "studyhours", "studyhoursweekly"]
FAILURE_NAMES = ["failures", "pastfailures", "previousfailures"]


def _first_named(df: DataFrame, names: list[str]) -> str | None:
    return next((c for c in df.columns if normalize_name(c) in names), None)


def median_split(df: DataFrame, roles: RoleMap, study: str | None = None) -> DataFrame:
    """Mean row score at or below vs above the median study time."""
    study = study or _first_named(df, STUDY_NAMES)
    if study is None:
        return df.sparkSession.createDataFrame(
            [(None, None, None)], "median_study double, low_study_score double, high_study_score double")
    prepared, _ = prepare(df, roles, keep=[study] + _score_cols(df, roles))
    pairs = prepared.select(num(prepared, study).alias("s"), F.col(AVG).alias("a")).dropna()
    m = exact_percentiles(pairs, {"s": F.col("s")}, [0.5])["s"][0]
    m_lit = F.lit(m).cast("double")
    return pairs.agg(m_lit.alias("median_study"),
                     F.avg(F.when(F.col("s") <= m_lit, F.col("a"))).alias("low_study_score"),
                     F.avg(F.when(F.col("s") > m_lit, F.col("a"))).alias("high_study_score"))


def threshold_counts(df: DataFrame, roles: RoleMap) -> DataFrame:
    failures = _first_named(df, FAILURE_NAMES)
    prepared, _ = prepare(df, roles, keep=([failures] if failures else []) + _score_cols(df, roles)
                          + ([roles.student_id] if roles.student_id else []))
    fail_expr = (F.count_if(num(prepared, failures) >= 2) if failures else F.lit(0).cast("long"))
    return prepared.agg(F.count_if(F.col(AVG) < 60).alias("low_score_count"),
                        F.count_if(F.col(AVG) >= 80).alias("high_score_count"),
                        fail_expr.alias("repeat_failure_count"))


def report_facts(df: DataFrame, roles: RoleMap) -> DataFrame:
    """Executive-summary numbers: shape, kinds, missing cells, performance mean and the
    report's pass rate (mark 10 on a 20-point scale, else 60)."""
    from cohort.functions.exprs import is_numeric_type, is_categorical_type
    from cohort.operators.profile import missing_frame
    perf = (roles.performance or roles.scores or [None])[0]
    types = [f.dataType for f in df.schema.fields]
    missing = missing_frame(df).agg(F.sum("missing")).first()[0] or 0
    base = [F.count(F.lit(1)).alias("row_count"), F.lit(len(types)).cast("long").alias("column_count"),
            F.lit(sum(is_numeric_type(t) for t in types)).cast("long").alias("numeric_columns"),
            F.lit(sum(is_categorical_type(t) for t in types)).cast("long").alias("categorical_columns"),
            F.lit(missing).cast("long").alias("missing_values")]
    if perf is None:
        return df.agg(*base, F.lit(None).cast("double").alias("performance_mean"),
                      F.lit(None).cast("double").alias("pass_rate"))
    x = num(df, perf)
    mx = df.agg(F.max(x)).first()[0]
    mark = 10 if mx is not None and mx <= 20 else 60  # the report rule knows only the 20- and 100-point scales
    return df.agg(*base, F.avg(x).alias("performance_mean"),
                  F.try_divide(F.count_if(x >= mark) * 100.0, F.count(x)).alias("pass_rate"))


def latest_accuracy(runs: DataFrame) -> DataFrame:
    """Accuracy in percent of the newest logistic run of a runs table, else of the newest run; null without runs."""
    logistic = F.lower("model") == "logistic regression"
    newest = F.struct(logistic.cast("int"), F.col("run_at"), F.col("model"))
    return runs.where(F.col("accuracy").isNotNull()).agg((F.max_by("accuracy", newest) * 100).alias("prediction_accuracy"))
