"""Catalog entries: evaluation operators over the deterministic document scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.operators import metrics
from cohort.plans.common import register, finish, SCORED
from cohort.sources.fixtures import scored_docs

# y = quality (1 = Pass); predicted Pass when p >= 0.5; curves use p rounded to 2 places (ties).
BASE = f"WITH {SCORED},\ns AS (SELECT CAST(quality AS BIGINT) AS y, CAST(p >= 0.5 AS BIGINT) AS pred, p FROM scored),\n" \
       "s2 AS (SELECT y, pred, round(p, 2) AS p FROM s)"


def _scored(spark, sf_dir, digits=None):
    df = scored_docs(spark, sf_dir)
    p = F.round("p", digits) if digits else F.col("p")
    return df.select(F.col("quality").cast("long").alias("y"), (F.col("p") >= 0.5).cast("long").alias("pred"),
                     p.alias("p"))


@register("confusion_matrix", BASE + """
SELECT 'Actual Fail' AS actual, 'Predicted Fail' AS predicted, CAST(count_if(y = 0 AND pred = 0) AS BIGINT) AS n FROM s UNION ALL
SELECT 'Actual Fail', 'Predicted Pass', CAST(count_if(y = 0 AND pred = 1) AS BIGINT) FROM s UNION ALL
SELECT 'Actual Pass', 'Predicted Fail', CAST(count_if(y = 1 AND pred = 0) AS BIGINT) FROM s UNION ALL
SELECT 'Actual Pass', 'Predicted Pass', CAST(count_if(y = 1 AND pred = 1) AS BIGINT) FROM s""")
def q_confusion(spark, sf_dir):
    return metrics.confusion_matrix(_scored(spark, sf_dir))


@register("class_metrics", BASE + """,
c AS (SELECT count_if(y = 0 AND pred = 0) AS tn, count_if(y = 0 AND pred = 1) AS fp,
             count_if(y = 1 AND pred = 0) AS fn, count_if(y = 1 AND pred = 1) AS tp FROM s)
SELECT round(CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END, 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM c""")
def q_class_metrics(spark, sf_dir):
    return finish(metrics.class_metrics(_scored(spark, sf_dir)))


@register("roc_auc", BASE + """,
r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s2)
SELECT round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)
             / (count_if(y = 1) * count_if(y = 0)), 6) AS roc_auc FROM r""")
def q_roc_auc(spark, sf_dir):
    return finish(metrics.roc_auc(_scored(spark, sf_dir, 2)))


CURVE = """,
g AS (SELECT p AS score, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM s2 GROUP BY p),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tps, sum(neg) OVER (ORDER BY score DESC) AS fps,
             row_number() OVER (ORDER BY score DESC) AS i FROM g)"""


@register("average_precision", BASE + CURVE + """
SELECT round(sum(pos * tps / (tps + fps)) / sum(pos), 6) AS average_precision FROM c""")
def q_average_precision(spark, sf_dir):
    return finish(metrics.average_precision(_scored(spark, sf_dir, 2)))


@register("log_loss", BASE + f"""
SELECT round(avg(-(y * ln(least(greatest(p, {metrics.EPS!r}), 1 - {metrics.EPS!r})))
                 - (1 - y) * ln(1 - least(greatest(p, {metrics.EPS!r}), 1 - {metrics.EPS!r}))), 6) AS log_loss FROM s""")
def q_log_loss(spark, sf_dir):
    return finish(metrics.log_loss(_scored(spark, sf_dir)))


@register("brier", BASE + "\nSELECT round(avg(pow(y - p, 2)), 6) AS brier FROM s")
def q_brier(spark, sf_dir):
    return finish(metrics.brier(_scored(spark, sf_dir)))


@register("roc_points", BASE + CURVE + """,
t AS (SELECT max(tps) AS T, max(fps) AS F, max(i) AS m FROM c),
k AS (SELECT c.*, lag(tps) OVER (ORDER BY i) AS tp0, lag(fps) OVER (ORDER BY i) AS fp0,
             lead(tps) OVER (ORDER BY i) AS tp2, lead(fps) OVER (ORDER BY i) AS fp2 FROM c)
SELECT CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'inf'::DOUBLE AS threshold
UNION ALL
SELECT CAST(i AS BIGINT), round(fps / t.F, 6), round(tps / t.T, 6), round(score, 6) FROM k, t
WHERE tp0 IS NULL OR tp2 IS NULL OR fp2 - 2 * fps + fp0 <> 0 OR tp2 - 2 * tps + tp0 <> 0""")
def q_roc_points(spark, sf_dir):
    return finish(metrics.roc_points(_scored(spark, sf_dir, 2)))


@register("pr_points", BASE + CURVE + """
SELECT round(tps / (SELECT sum(pos) FROM g), 6) AS recall,
       round(CASE WHEN tps + fps > 0 THEN tps / (tps + fps) ELSE 0.0 END, 6) AS precision, round(score, 6) AS threshold FROM c
UNION ALL SELECT 0.0, 1.0, NULL""")
def q_pr_points(spark, sf_dir):
    return finish(metrics.pr_points(_scored(spark, sf_dir, 2)))


@register("calibration_points", BASE + """,
n AS (SELECT CASE WHEN count(*) < 12 THEN 3 WHEN count(*) < 25 THEN 4 ELSE least(8, greatest(5, count(*) // 10)) END AS nb FROM s),
e AS (SELECT quantile_cont(p, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS q8,
             quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q5 FROM s),
b AS (SELECT s.*, CASE WHEN nb = 8 THEN len(list_filter(q8, lambda x: x < p)) ELSE len(list_filter(q5, lambda x: x < p)) END AS bin
      FROM s, n, e)
SELECT CAST(bin AS BIGINT) AS bin, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed_rate,
       CAST(count(*) AS BIGINT) AS n FROM b GROUP BY bin""")
def q_calibration_points(spark, sf_dir):
    return finish(metrics.calibration_points(_scored(spark, sf_dir)))
