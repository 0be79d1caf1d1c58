"""Catalog entries: rule-based insights over the student fixture, of the whole table and by programme."""

from __future__ import annotations

from cohort.operators import insights as ins
from cohort.operators.roles import detect_roles
from cohort.plans.common import register, finish, SP
from cohort.sources.fixtures import students


def _items(group: str = "") -> str:
    """The rules over table f, one SELECT each; ``group``: columns of f that come first."""
    g = f"{group}, " if group else ""
    return f"""items AS (
  SELECT {g}1 AS emitted, CASE WHEN att < 75 THEN 'Low Attendance Warning' WHEN att < 88 THEN 'Attendance Needs Monitoring'
         ELSE 'Attendance Trend Is Strong' END AS title, 'Attendance' AS label,
         CASE WHEN att < 75 THEN 'critical' WHEN att < 88 THEN 'warning' ELSE 'positive' END AS severity, att AS value
    FROM f WHERE att IS NOT NULL
  UNION ALL
  SELECT {g}2, CASE WHEN at_risk / total * 100 >= 15 THEN 'High-Risk Student Alert' ELSE 'Risk Level Is Controlled' END,
         'Student risk', CASE WHEN at_risk / total * 100 >= 30 THEN 'critical' WHEN at_risk / total * 100 >= 15 THEN 'warning'
         ELSE 'positive' END, at_risk / total * 100 FROM f WHERE labelled > 0
  UNION ALL
  SELECT {g}3, 'Prediction Trend', 'Pass/Fail pattern', CASE WHEN pr >= 75 THEN 'positive' WHEN pr >= 60 THEN 'warning'
         ELSE 'critical' END, pr FROM f WHERE pr IS NOT NULL AND fr IS NOT NULL
  UNION ALL
  SELECT {g}4, 'Performance Pattern', 'Score distribution', CASE WHEN low / total < 0.3 THEN 'warning' ELSE 'critical' END, low
    FROM f WHERE low > 0
  UNION ALL
  SELECT {g}4, 'Strong Performance Pattern', 'Score distribution', 'positive', high FROM f WHERE low = 0 AND high > 0
  UNION ALL
  SELECT {g}5, 'Top-Performing Group: ' || top_group, 'Group insight', 'positive', sc FROM f WHERE top_group IS NOT NULL
  UNION ALL
  SELECT {g}6, 'Study Habit Recommendation', 'Study pattern', 'positive', hi - lo FROM f WHERE hi - lo >= 8
  UNION ALL
  SELECT {g}6, 'Study Time Risk', 'Study pattern', 'warning', lo FROM f WHERE hi - lo < 8 AND lo < 60
  UNION ALL
  SELECT {g}7, 'Failure Risk Warning', 'Academic history', CASE WHEN rep / total >= 0.2 THEN 'critical' ELSE 'warning' END, rep
    FROM f WHERE rep > 0),
"""


def _sql():
    return "WITH " + SP + """,
tot AS (SELECT greatest(count(DISTINCT student_id), 1)::DOUBLE AS total FROM students),
k AS (SELECT avg(att) AS att, count_if(t = 'Fail')::DOUBLE AS at_risk, count_if(t IS NOT NULL) AS labelled,
             count_if(t = 'Pass') * 100.0 / nullif(count_if(t IS NOT NULL), 0) AS pr,
             count_if(t = 'Fail') * 100.0 / nullif(count_if(t IS NOT NULL), 0) AS fr,
             count_if(avg < 60)::DOUBLE AS low, count_if(avg >= 80)::DOUBLE AS high,
             count_if(failures >= 2)::DOUBLE AS rep FROM spr),
lv AS (SELECT 'programme' AS gc, 1 AS pos, programme AS level, avg FROM sp UNION ALL
       SELECT 'support_band', 2, support_band, avg FROM sp),
gm AS (SELECT gc, pos, level, avg(avg) AS sc FROM lv WHERE level IS NOT NULL GROUP BY gc, pos, level HAVING avg(avg) IS NOT NULL),
tg AS (SELECT gc || ': ' || level AS top_group, sc FROM gm ORDER BY sc DESC, pos, level LIMIT 1),
p AS (SELECT CAST(studytime AS DOUBLE) AS s, avg AS a FROM sp WHERE studytime IS NOT NULL AND avg IS NOT NULL),
md AS (SELECT median(s) AS m FROM p),
ms AS (SELECT avg(CASE WHEN s <= m THEN a END) AS lo, avg(CASE WHEN s > m THEN a END) AS hi FROM p, md),
f AS (SELECT * FROM tot, k, tg, ms),
""" + _items() + """ranked AS (SELECT *, CAST(CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3 ELSE 4 END AS BIGINT) AS severity_rank FROM items)
SELECT CAST(emitted AS BIGINT) AS emitted, title, label, severity, round(value, 6) AS value, severity_rank
FROM ranked ORDER BY severity_rank, emitted LIMIT 6"""


@register("insights", _sql())
def q_insights(spark, sf_dir):
    df = students(spark, sf_dir)
    roles = detect_roles(df)
    return finish(ins.insights(ins.figures(df, roles)))


def _sql_by():
    """The same figures and rules for every programme."""
    return "WITH " + SP + """,
k AS (SELECT programme, greatest(count(DISTINCT student_id), 1)::DOUBLE AS total, avg(att) AS att, count_if(t = 'Fail')::DOUBLE AS at_risk, count_if(t IS NOT NULL) AS labelled,
             count_if(t = 'Pass') * 100.0 / nullif(count_if(t IS NOT NULL), 0) AS pr,
             count_if(t = 'Fail') * 100.0 / nullif(count_if(t IS NOT NULL), 0) AS fr,
             count_if(avg < 60)::DOUBLE AS low, count_if(avg >= 80)::DOUBLE AS high,
             count_if(failures >= 2)::DOUBLE AS rep FROM spr GROUP BY programme),
gm AS (SELECT programme, support_band, avg(avg) AS sc FROM sp WHERE support_band IS NOT NULL GROUP BY ALL HAVING avg(avg) IS NOT NULL),
tg AS (SELECT programme, 'support_band: ' || support_band AS top_group, sc FROM gm QUALIFY row_number() OVER (PARTITION BY programme ORDER BY sc DESC, support_band) = 1),
p AS (SELECT programme, CAST(studytime AS DOUBLE) AS s, avg AS a FROM sp WHERE studytime IS NOT NULL AND avg IS NOT NULL),
md AS (SELECT programme, median(s) AS m FROM p GROUP BY programme),
ms AS (SELECT p.programme, avg(CASE WHEN s <= m THEN a END) AS lo, avg(CASE WHEN s > m THEN a END) AS hi
       FROM p JOIN md ON p.programme IS NOT DISTINCT FROM md.programme GROUP BY p.programme),
f AS (SELECT k.*, top_group, sc, lo, hi FROM k LEFT JOIN tg ON k.programme IS NOT DISTINCT FROM tg.programme
      LEFT JOIN ms ON k.programme IS NOT DISTINCT FROM ms.programme),
""" + _items("programme") + """ranked AS (SELECT *, CAST(CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3 ELSE 4 END AS BIGINT) AS severity_rank FROM items)
SELECT programme, CAST(emitted AS BIGINT) AS emitted, title, label, severity, round(value, 6) AS value, severity_rank
FROM ranked QUALIFY row_number() OVER (PARTITION BY programme ORDER BY severity_rank, emitted) <= 6"""


@register("insights_by_group", _sql_by())
def q_insights_by_group(spark, sf_dir):
    df = students(spark, sf_dir)
    return finish(ins.insights_by(ins.figures_by(df, detect_roles(df), ["programme"]), ["programme"]))
