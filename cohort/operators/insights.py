"""Rule-based insights over the snapshot figures.

The figures come from aggregates (KPI snapshot, threshold counts, top group, study split), of the whole table or
by group; the rules are ``when`` expressions over a row of figures, ordered by severity (stable), cut to six
and exploded with ``inline``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.operators import kpi
from cohort.operators.ordered import running_sums
from cohort.operators.roles import RoleMap

# ---- fixed values -------------------------------------------------------------
SEVERITY_ORDER = ["critical", "warning", "info", "positive"]
FIGURES = ("total double, average_attendance double, at_risk_count double, pass_rate double, fail_rate double, "
           "low_score_count double, high_score_count double, has_scores boolean, top_group string, "
           "top_group_score double, low_study_score double, high_study_score double, repeat_failure_count double, "
           "has_failures boolean, cluster_high double, cluster_average double, prediction_accuracy double")
# ---------------------------------------------------------------------------


def figures(df: DataFrame, roles: RoleMap, cluster_counts: dict | None = None,
            prediction_accuracy: float | None = None) -> DataFrame:
    """The figures behind the rules, from a narrow projection that is persisted
    once and read by the four small aggregates."""
    import dataclasses
    from cohort.functions.exprs import is_categorical_type
    study0 = kpi._first_named(df, kpi.STUDY_NAMES)
    fail0 = kpi._first_named(df, kpi.FAILURE_NAMES)
    cats = [f.name for f in df.schema.fields if is_categorical_type(f.dataType)]
    needed = [c for c in df.columns if c in set(
        [roles.student_id, roles.target, roles.attendance, study0, fail0] + roles.scores + roles.performance + cats)]
    narrow = df.select(*[kpi.col(c) for c in needed]).persist()
    try:
        roles = dataclasses.replace(roles, source_hash=narrow.semanticHash())
        return _figures(narrow, roles, cluster_counts, prediction_accuracy)
    finally:
        narrow.unpersist()


def _figures(df: DataFrame, roles: RoleMap, cluster_counts, prediction_accuracy) -> DataFrame:
    snap = kpi.kpi_snapshot(df, roles).first()
    th = kpi.threshold_counts(df, roles).first()
    tg = kpi.top_group(df, roles).first()
    study = kpi._first_named(df, kpi.STUDY_NAMES)
    ms = kpi.median_split(df, roles).first() if study else None
    failures = kpi._first_named(df, kpi.FAILURE_NAMES)
    has_scores = snap.average_score is not None
    row = (float(max(snap.total_entities or 0, 1)), snap.average_attendance,
           float(snap.at_risk_count) if snap.pass_count + snap.fail_count > 0 else None,
           snap.pass_rate, snap.fail_rate, float(th.low_score_count), float(th.high_score_count), has_scores,
           f"{tg.group_column}: {tg.level}" if tg else None, tg.average_score if tg else None,
           ms.low_study_score if ms else None, ms.high_study_score if ms else None,
           float(th.repeat_failure_count), failures is not None,
           float((cluster_counts or {}).get("High Performers", 0)) if cluster_counts else None,
           float((cluster_counts or {}).get("Average Performers", 0)) if cluster_counts else None,
           prediction_accuracy)
    return df.sparkSession.createDataFrame([row], FIGURES)


def _ins(order, title, label, severity, value):
    return F.struct(F.lit(order).alias("emitted"), title.alias("title") if not isinstance(title, str) else F.lit(title).alias("title"),
                    F.lit(label).alias("label"), severity.alias("severity") if not isinstance(severity, str) else F.lit(severity).alias("severity"),
                    value.cast("double").alias("value"))


def figures_by(df: DataFrame, roles: RoleMap, by: list[str], stats: kpi.ScaleStats | None = None) -> DataFrame:
    """The figures behind the rules for every group of ``by``: its columns and those of ``FIGURES``.

    Three grouped aggregates over narrow projections, all with map-side partial results, so that a hot group is
    collapsed where its rows are: the snapshot and threshold counts; the best level of each group's other group columns; the
    study split at the group's exact median, from sums by distinct study time that ``running_sums`` orders and cuts.
    Scales are the whole table's, as in the grouped snapshot.  A null group is a group.
    """
    stats = stats or kpi.scale_stats(df, roles)
    study, fail = kpi._first_named(df, kpi.STUDY_NAMES), kpi._first_named(df, kpi.FAILURE_NAMES)
    levels = [c for c in kpi.group_columns(df) if c not in by]
    scores = kpi._score_cols(df, roles)
    keep = list(dict.fromkeys([*by, *levels, *scores, *[c for c in (roles.student_id, roles.target, roles.attendance, study, fail) if c and c in df.columns]]))
    rows, _ = kpi.prepare(df, roles, stats, keep=keep)
    groups = [kpi.col(c) for c in by]
    failed = F.count_if(kpi.num(rows, fail) >= 2) if fail else F.lit(0)
    facts = rows.groupBy(*groups).agg(*kpi._kpi_aggs(rows, roles, stats), F.count_if(F.col(kpi.AVG) < 60).alias("low"),
                                      F.count_if(F.col(kpi.AVG) >= 80).alias("high"), failed.alias("failed"))
    none = F.lit(None).cast("double")
    labelled = F.col("pass_count") + F.col("fail_count") > 0
    out = facts.select(*groups, F.greatest("total_entities", F.lit(1)).cast("double").alias("total"), "average_attendance",
                       F.when(labelled, F.col("at_risk_count").cast("double")).alias("at_risk_count"), "pass_rate", "fail_rate",
                       F.col("low").cast("double").alias("low_score_count"), F.col("high").cast("double").alias("high_score_count"),
                       F.col("average_score").isNotNull().alias("has_scores"), F.col("failed").cast("double").alias("repeat_failure_count"),
                       F.lit(fail is not None).alias("has_failures"), *[none.alias(c) for c in ("cluster_high", "cluster_average", "prediction_accuracy")])
    return _beside(_beside(out, _best_levels(rows, by, levels), by), _study_split(rows, by, study), by)


def _beside(left: DataFrame, right: DataFrame | None, by: list[str]) -> DataFrame:
    """Left join on the group columns, null groups included."""
    same = reduce(lambda a, b: a & b, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in by])
    return left.alias("l").join(right.alias("r"), same, "left").select("l.*", *[F.col(f"r.`{c}`") for c in right.columns if c not in by])


def _best_levels(rows: DataFrame, by: list[str], levels: list[str]) -> DataFrame:
    """Each group's level with the highest mean score; ties: earlier column, then smaller level."""
    groups = [kpi.col(c) for c in by]
    parts = [F.struct(F.lit(i).alias("_place"), F.lit(c).alias("_column"), kpi.col(c).cast("string").alias("_level")) for i, c in enumerate(levels)]
    long = rows.select(*groups, F.col(kpi.AVG).alias("_score"), F.inline(F.array(*parts) if parts else F.array().cast("array<struct<_place:int,_column:string,_level:string>>")))
    means = long.where("_level IS NOT NULL").groupBy(*groups, "_place", "_column", "_level").agg(F.avg("_score").alias("_score")).where("_score IS NOT NULL")
    best = means.groupBy(*groups).agg(F.min(F.struct((-F.col("_score")).alias("o"), "_place", "_level", "_column")).alias("b"))
    return best.select(*groups, F.concat("b._column", F.lit(": "), "b._level").alias("top_group"), (-F.col("b.o")).alias("top_group_score"))


def _study_split(rows: DataFrame, by: list[str], study: str | None) -> DataFrame:
    """Each group's mean score at or below its median study time, and above it."""
    groups = [kpi.col(c) for c in by]
    if study is None:
        return rows.select(*groups, *[F.lit(None).cast("double").alias(c) for c in ("low_study_score", "high_study_score")]).limit(0)
    pairs = rows.select(*groups, kpi.num(rows, study).alias("_s"), F.col(kpi.AVG).alias("_a")).where("_s IS NOT NULL AND _a IS NOT NULL")
    sums = pairs.groupBy(*groups, "_s").agg(F.count(F.lit(1)).alias("_n"), F.sum("_a").alias("_t"))
    ranked = running_sums(sums, "_s", ["_n", "_t"], by)
    whole = ranked.groupBy(*groups).agg(F.max("cum__n").alias("_all"), F.max_by("cum__t", "_s").alias("_sum"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in by])
    both = ranked.alias("l").join(whole.alias("r"), same).select("l.*", "_all", "_sum")
    # no value lies between the two middle ones, so the rows at or below the median end with the lower of them
    low = F.when(F.col("cum__n") > F.floor((F.col("_all") - 1) / 2), F.struct("_s", "cum__n", "cum__t"))
    half = both.groupBy(*groups, "_all", "_sum").agg(F.min(low).alias("m"))
    return half.select(*groups, (F.col("m.cum__t") / F.col("m.cum__n")).alias("low_study_score"),
                       F.try_divide(F.col("_sum") - F.col("m.cum__t"), F.col("_all") - F.col("m.cum__n")).alias("high_study_score"))


def insights(fig: DataFrame, limit: int = 6) -> DataFrame:
    """Up to ``limit`` insights of one row of figures, by severity."""
    return insights_by(fig, [], limit).orderBy("severity_rank", "emitted")


def insights_by(fig: DataFrame, by: list[str], limit: int = 6) -> DataFrame:
    """Up to ``limit`` insights of every row of figures with its ``by`` columns; a row where no rule fires has the
    fallback.  Ordering and cutting are within the row: nothing is shuffled."""
    c = F.col
    att = c("average_attendance")
    share = c("at_risk_count") / c("total") * 100
    risk_sev = F.when(share >= 30, "critical").when(share >= 15, "warning").otherwise("positive")
    pr = c("pass_rate")
    gap = c("high_study_score") - c("low_study_score")
    fail_sev = F.when(c("repeat_failure_count") / c("total") >= 0.2, "critical").otherwise("warning")
    acc = c("prediction_accuracy")
    items = [
        F.when(att.isNotNull(), _ins(1, F.when(att < 75, "Low Attendance Warning").when(att < 88, "Attendance Needs Monitoring")
                                     .otherwise("Attendance Trend Is Strong"),
                                     "Attendance", F.when(att < 75, "critical").when(att < 88, "warning").otherwise("positive"), att)),
        F.when(c("at_risk_count").isNotNull(), _ins(2, F.when(risk_sev == "positive", "Risk Level Is Controlled")
                                                    .otherwise("High-Risk Student Alert"), "Student risk", risk_sev, share)),
        F.when(pr.isNotNull() & c("fail_rate").isNotNull(),
               _ins(3, "Prediction Trend", "Pass/Fail pattern",
                    F.when(pr >= 75, "positive").when(pr >= 60, "warning").otherwise("critical"), pr)),
        F.when(c("has_scores") & (c("low_score_count") > 0),
               _ins(4, "Performance Pattern", "Score distribution",
                    F.when(c("low_score_count") / c("total") < 0.3, "warning").otherwise("critical"), c("low_score_count")))
        .when(c("has_scores") & (c("high_score_count") > 0),
              _ins(4, "Strong Performance Pattern", "Score distribution", "positive", c("high_score_count"))),
        F.when(c("has_scores") & c("top_group").isNotNull(),
               _ins(5, F.concat(F.lit("Top-Performing Group: "), c("top_group")), "Group insight", "positive",
                    c("top_group_score"))),
        F.when(c("has_scores") & gap.isNotNull() & (gap >= 8),
               _ins(6, "Study Habit Recommendation", "Study pattern", "positive", gap))
        .when(c("has_scores") & gap.isNotNull() & (c("low_study_score") < 60),
              _ins(6, "Study Time Risk", "Study pattern", "warning", c("low_study_score"))),
        F.when(c("has_failures") & (c("repeat_failure_count") > 0),
               _ins(7, "Failure Risk Warning", "Academic history", fail_sev, c("repeat_failure_count"))),
        F.when((c("cluster_high") > 0) & (c("cluster_average") > 0),
               _ins(8, "Cluster Trend Summary", "Segmentation", "info", c("cluster_high"))),
        F.when(acc.isNotNull(), _ins(9, "Model Reliability Signal", "Prediction quality",
                                     F.when(acc >= 75, "positive").when(acc >= 60, "warning").otherwise("critical"), acc)),
    ]
    # the fallback appears only when no rule fired
    fallback = F.array(_ins(10, "Upload More Academic Data", "AI insight", "info", F.lit(None)))
    fired = F.array_compact(F.array(*items))
    rank = F.array(*[F.lit(x) for x in SEVERITY_ORDER])
    ranked = F.transform(F.when(F.size(fired) > 0, fired).otherwise(fallback), lambda x: F.struct(
        F.array_position(rank, x["severity"]).cast("long").alias("severity_rank"), x["emitted"].alias("emitted"),
        x["title"].alias("title"), x["label"].alias("label"), x["severity"].alias("severity"), x["value"].alias("value")))
    rows = fig.select(*[F.col(f"`{c}`") for c in by], F.inline(F.slice(F.array_sort(ranked), 1, limit)))
    return rows.select(*[F.col(f"`{c}`") for c in by], "emitted", "title", "label", "severity", "value", "severity_rank")
