"""Catalog entries: clustering.  The D-checked chain assigns rows to the
nearest of three centres computed from the data (means of the rule-based risk
groups); kmeans3 / pca2 fit real models (row checks only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.functions.labels import RISK_AT, RISK_AVERAGE, RISK_HIGH
from cohort.operators import kpi, segment
from cohort.operators.roles import detect_roles
from cohort.plans.common import register, finish, SP
from cohort.sources.fixtures import stored_students, students

FEATS = ["g1", "g2", "g3", "studytime", "absences"]
PERF = ["g1", "g2", "g3"]
GROUPS = [RISK_AT, RISK_AVERAGE, RISK_HIGH]


def _scaled(spark, sf_dir):
    df = stored_students(spark, sf_dir, distinct=True)
    scored = segment.performance_score(df, PERF)
    scaled, kept, _ = segment.cluster_features(scored, FEATS, keep=["student_id", "performance_score"])
    return df, scaled


def _assigned(spark, sf_dir):
    df, scaled = _scaled(spark, sf_dir)
    prepared, _ = kpi.prepare(df, detect_roles(df), keep=["student_id"])
    risk = prepared.select("student_id", F.col(kpi.RISK).alias("risk"))
    with_risk = scaled.join(risk, "student_id")
    cent = with_risk.groupBy("risk").agg(*[F.round(F.avg(c), 6).alias(c) for c in FEATS]).collect()  # 3 rows
    by = {r.risk: [r[c] for c in FEATS] for r in cent}
    centres = [by[g] for g in GROUPS if g in by]
    return df, segment.assign_nearest(scaled, FEATS, centres)


# ---- SQL: same chain in DuckDB ---------------------------------------------------
_MED = ", ".join(f"median({c}) AS m_{c}" for c in FEATS)
_FILL = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in FEATS)
_STAT = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in FEATS)
_Z = ", ".join(f"({c} - a_{c}) / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END) AS {c}" for c in FEATS)
_CENT = ", ".join(f"round(avg(z.{c}), 6) AS {c}" for c in FEATS)
_DIST = " + ".join(f"pow(z.{c} - c.{c}, 2)" for c in FEATS)
SEG = "WITH " + SP + f""",
d AS (SELECT DISTINCT * FROM students),
pm AS (SELECT greatest(max(g1), max(g2), max(g3)) AS smax FROM d),
ps AS (SELECT d.*, (coalesce(g1, 0.0) + coalesce(g2, 0.0) + coalesce(g3, 0.0))
      / nullif((CASE WHEN g1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN g2 IS NULL THEN 0 ELSE 1 END)
               + (CASE WHEN g3 IS NULL THEN 0 ELSE 1 END), 0)
      * (CASE WHEN smax <= 1.5 THEN 100.0 WHEN smax <= 20 THEN 5.0 ELSE 1.0 END) AS performance_score FROM d, pm),
u AS (SELECT * FROM ps WHERE {" OR ".join(f"{c} IS NOT NULL" for c in FEATS)}),
md AS (SELECT {_MED} FROM u),
f AS (SELECT student_id, performance_score, {_FILL} FROM u, md),
st AS (SELECT {_STAT} FROM f),
z AS (SELECT student_id, performance_score, {_Z} FROM f, st),
rk AS (SELECT DISTINCT student_id, risk FROM spr),
c AS (SELECT CASE rk.risk WHEN '{RISK_AT}' THEN 0 WHEN '{RISK_AVERAGE}' THEN 1 ELSE 2 END AS cid, {_CENT}
      FROM z JOIN rk ON z.student_id = rk.student_id GROUP BY rk.risk),
dist AS (SELECT z.student_id, z.performance_score, c.cid, {_DIST} AS dd FROM z, c),
a AS (SELECT student_id, performance_score, arg_min(cid, (dd, cid)) AS cluster_id FROM dist GROUP BY student_id, performance_score),
cm AS (SELECT cluster_id, avg(performance_score) AS m FROM a GROUP BY cluster_id),
lab AS (SELECT cluster_id, CAST(row_number() OVER (ORDER BY m ASC NULLS FIRST, cluster_id) - 1 AS BIGINT) AS label_rank FROM cm),
lab2 AS (SELECT cluster_id, label_rank, CASE label_rank WHEN 0 THEN 'At-Risk Students' WHEN 1 THEN 'Average Performers'
         ELSE 'High Performers' END AS cluster_label FROM lab),
al AS (SELECT a.*, label_rank, cluster_label FROM a JOIN lab2 ON a.cluster_id = lab2.cluster_id)"""


@register("cluster_features", SEG + "\nSELECT student_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATS) + " FROM z")
def q_cluster_features(spark, sf_dir):
    _, scaled = _scaled(spark, sf_dir)
    return finish(scaled.select("student_id", *FEATS))


@register("performance_score", SEG + "\nSELECT student_id, round(performance_score, 6) AS performance_score FROM ps")
def q_performance_score(spark, sf_dir):
    df = students(spark, sf_dir).dropDuplicates()
    return finish(segment.performance_score(df, PERF).select("student_id", "performance_score"))


@register("assign_nearest", SEG + "\nSELECT student_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM a")
def q_assign_nearest(spark, sf_dir):
    _, a = _assigned(spark, sf_dir)
    return finish(a.select("student_id", "cluster_id"))


@register("label_clusters", SEG + "\nSELECT CAST(cluster_id AS BIGINT) AS cluster_id, label_rank, cluster_label FROM lab2")
def q_label_clusters(spark, sf_dir):
    _, a = _assigned(spark, sf_dir)
    return finish(segment.label_clusters(a))


@register("cluster_profiles", SEG + """
SELECT cluster_label, label_rank, CAST(count(*) AS BIGINT) AS students,
  round(avg(d.g1), 6) AS mean_g1, round(avg(d.g2), 6) AS mean_g2, round(avg(d.g3), 6) AS mean_g3,
  round(avg(d.studytime), 6) AS mean_studytime, round(avg(d.absences), 6) AS mean_absences
FROM al JOIN d ON al.student_id = d.student_id GROUP BY cluster_label, label_rank""")
def q_cluster_profiles(spark, sf_dir):
    df, a = _assigned(spark, sf_dir)
    lab = segment.attach_labels(a).select("student_id", "cluster_label", "label_rank")
    return finish(segment.cluster_profiles(df.join(lab, "student_id"), FEATS))


@register("cluster_summary", SEG + """,
names AS (SELECT * FROM (VALUES (0, 'At-Risk Students'), (1, 'Average Performers'), (2, 'High Performers')) t(label_rank, cluster_label)),
s AS (SELECT cluster_label, count(*) AS students, avg(performance_score) AS aps FROM al GROUP BY cluster_label)
SELECT n.cluster_label, CAST(n.label_rank AS BIGINT) AS label_rank, CAST(coalesce(students, 0) AS BIGINT) AS students,
  round(aps, 6) AS average_performance_score,
  round(coalesce(students, 0) * 100.0 / sum(coalesce(students, 0)) OVER (), 6) AS share
FROM names n LEFT JOIN s ON n.cluster_label = s.cluster_label""")
def q_cluster_summary(spark, sf_dir):
    _, a = _assigned(spark, sf_dir)
    return finish(segment.cluster_summary(segment.attach_labels(a)))


@register("cluster_counts", SEG + """
SELECT CAST(count_if(cluster_label = 'High Performers') AS BIGINT) AS high_performers,
  CAST(count_if(cluster_label = 'Average Performers') AS BIGINT) AS average_performers,
  CAST(count_if(cluster_label = 'At-Risk Students') AS BIGINT) AS at_risk_students, CAST(count(*) AS BIGINT) AS clustered,
  count(*) > 0 AND count(*) <= (SELECT count(DISTINCT student_id) FROM students) AS usable FROM al""")
def q_cluster_counts(spark, sf_dir):
    df, a = _assigned(spark, sf_dir)
    total = df.select("student_id").distinct().count()
    return segment.cluster_counts(segment.attach_labels(a), total)


@register("attach_clusters", SEG + """
SELECT s.student_id, s.programme, al.cluster_label FROM students s LEFT JOIN al ON s.student_id = al.student_id""")
def q_attach_clusters(spark, sf_dir):
    _, a = _assigned(spark, sf_dir)
    lab = segment.attach_labels(a)
    return segment.attach_clusters(students(spark, sf_dir).select("student_id", "programme"), lab, "student_id")


@register("kmeans3")
def q_kmeans3(spark, sf_dir):
    df = stored_students(spark, sf_dir, distinct=True)
    run = segment.run_clustering(df, FEATS, PERF, "student_id")
    return run["assignments"].orderBy("label_rank", F.desc("performance_score"))


@register("pca2")
def q_pca2(spark, sf_dir):
    _, scaled = _scaled(spark, sf_dir)
    return segment.pca2(scaled, FEATS, ["student_id"])


@register("pca2_two_features", SEG + """,
t AS (SELECT 0.5 * atan2(2 * covar_pop(2 * g1, g2), var_pop(2 * g1) - var_pop(g2)) AS r FROM z)
SELECT student_id, round(abs(cos(r) * 2 * g1 + sin(r) * g2), 6) AS axis_1, round(abs(cos(r) * g2 - sin(r) * 2 * g1), 6) AS axis_2 FROM z, t""")
def q_pca2_two_features(spark, sf_dir):
    """Of two features the axes are a rotation that SQL can state; an axis has no sign."""
    _, scaled = _scaled(spark, sf_dir)
    two = scaled.select("student_id", (2 * F.col("g1")).alias("a"), F.col("g2").alias("b"))
    out = segment.pca2(two, ["a", "b"], ["student_id"])
    return finish(out.select("student_id", F.abs("axis_1").alias("axis_1"), F.abs("axis_2").alias("axis_2")))


@register("distinct_rows", f"WITH {SP.split(',' + chr(10) + 'mx AS')[0]}\n"
                           "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT g1, g2, g3 FROM students LIMIT 3) x")
def q_distinct_rows(spark, sf_dir):
    df = students(spark, sf_dir)
    return df.select("g1", "g2", "g3").distinct().limit(3).agg(F.count(F.lit(1)).alias("n"))
