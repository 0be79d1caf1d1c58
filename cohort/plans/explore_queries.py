"""Catalog entries: exploration figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.operators import explore, kpi
from cohort.operators.roles import detect_roles
from cohort.plans.common import register, finish, STUDENTS, SP
from cohort.sources.fixtures import students

NUM_COLS = ["studytime", "absences", "failures", "g1", "g2", "g3"]
PAIRS = [(a, b) for i, a in enumerate(NUM_COLS) for b in NUM_COLS[i + 1:]]


@register("frequency_table", f"""WITH {STUDENTS}
SELECT value, frequency, round(frequency * 100.0 / (SELECT count(*) FROM students), 6) AS percentage FROM (
  SELECT coalesce(CAST(result AS VARCHAR), 'Missing') AS value, CAST(count(*) AS BIGINT) AS frequency
  FROM students GROUP BY 1) x ORDER BY frequency DESC, value LIMIT 15""")
def q_frequency_table(spark, sf_dir):
    return finish(explore.frequency_table(students(spark, sf_dir), "result", 15))


@register("category_share", f"""WITH {STUDENTS}
SELECT value, frequency, round(frequency * 100.0 / (SELECT count(*) FROM students), 6) AS percentage FROM (
  SELECT coalesce(CAST(tutor_ref AS VARCHAR), 'Missing') AS value, CAST(count(*) AS BIGINT) AS frequency
  FROM students GROUP BY 1) x ORDER BY frequency DESC, value LIMIT 10""")
def q_category_share(spark, sf_dir):
    return finish(explore.frequency_table(students(spark, sf_dir), "tutor_ref", 10))


@register("correlation_matrix", f"WITH {STUDENTS}\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM students"
    for a, b in PAIRS))
def q_correlation_matrix(spark, sf_dir):
    return finish(explore.correlation_matrix(students(spark, sf_dir), NUM_COLS))


def _spearman_sql():
    long = "\nUNION ALL\n".join(
        f"SELECT {i} AS pair, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM students "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, (a, b) in enumerate(PAIRS))
    names = "\nUNION ALL\n".join(f"SELECT {i} AS pair, '{a}' AS column_a, '{b}' AS column_b"
                                 for i, (a, b) in enumerate(PAIRS))
    return (f"WITH {STUDENTS}, l AS ({long}),\n"
            "rk AS (SELECT pair, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2.0 AS rx,\n"
            "              rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2.0 AS ry FROM l),\n"
            f"n AS ({names})\n"
            "SELECT column_a, column_b, round(corr(rx, ry), 6) AS r FROM n LEFT JOIN rk ON n.pair = rk.pair "
            "GROUP BY column_a, column_b")


@register("correlation_spearman", _spearman_sql())
def q_correlation_spearman(spark, sf_dir):
    return finish(explore.correlation_spearman(students(spark, sf_dir), NUM_COLS))


@register("histogram", f"""WITH {STUDENTS},
m AS (SELECT min(g2) AS lo, max(g2) AS hi FROM students),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0 END AS width FROM m),
b AS (SELECT programme, CAST(least(floor((g2 - lo) / width), 19) AS BIGINT) AS bin, lo, width FROM students, w WHERE g2 IS NOT NULL)
SELECT programme, bin, round(lo + bin * width, 6) AS bin_start, round(lo + (bin + 1) * width, 6) AS bin_end,
       CAST(count(*) AS BIGINT) AS n FROM b GROUP BY programme, bin, lo, width""")
def q_histogram(spark, sf_dir):
    return finish(explore.histogram(students(spark, sf_dir), "g2", 20, by="programme"))


@register("score_bands", f"""WITH {SP},
v AS (SELECT least(greatest(avg, 0.0), 100.0) AS v FROM sp WHERE avg IS NOT NULL),
c AS (SELECT CASE WHEN v <= 40 THEN 0 WHEN v <= 50 THEN 1 WHEN v <= 60 THEN 2 WHEN v <= 70 THEN 3 WHEN v <= 85 THEN 4
             WHEN v <= 100 THEN 5 END AS band, count(*) AS n FROM v GROUP BY 1),
l AS (SELECT * FROM (VALUES (0, 0.0, 40.0), (1, 40.0, 50.0), (2, 50.0, 60.0), (3, 60.0, 70.0), (4, 70.0, 85.0), (5, 85.0, 100.0)) t(band, band_low, band_high)),
f AS (SELECT CAST(l.band AS BIGINT) AS band, CAST(band_low AS DOUBLE) AS band_low, CAST(band_high AS DOUBLE) AS band_high,
             CAST(coalesce(n, 0) AS BIGINT) AS n FROM l LEFT JOIN c ON l.band = c.band)
SELECT *, greatest(10.0, round(n / greatest(max(n) OVER (), 1) * 92, 0)) AS height FROM f""")
def q_score_bands(spark, sf_dir):
    df = students(spark, sf_dir)
    prepared, _ = kpi.prepare(df, detect_roles(df), keep=["g1", "g2", "g3"])
    return finish(explore.score_bands(prepared, kpi.AVG))


@register("score_quantiles", f"""WITH {SP},
v AS (SELECT least(greatest(avg, 0.0), 100.0) AS v FROM sp WHERE avg IS NOT NULL)
""" + "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS BIGINT) AS i, round(quantile_cont(v, {p}), 6) AS score FROM v"
    for i, p in enumerate([0.0, 0.25, 0.5, 0.75, 1.0])))
def q_score_quantiles(spark, sf_dir):
    df = students(spark, sf_dir)
    prepared, _ = kpi.prepare(df, detect_roles(df), keep=["g1", "g2", "g3"])
    return finish(explore.score_quantiles(prepared, kpi.AVG))


@register("box_stats", f"WITH {STUDENTS}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS subject, CAST(count({c}) AS BIGINT) AS n, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, "
    f"round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max FROM students"
    for c in ["g1", "g2", "g3"]))
def q_box_stats(spark, sf_dir):
    return finish(explore.box_stats(students(spark, sf_dir), ["g1", "g2", "g3"]))


@register("pair_not_null", f"WITH {STUDENTS}\nSELECT absences, g1, student_id FROM students "
                           "WHERE absences IS NOT NULL AND g1 IS NOT NULL")
def q_pair_not_null(spark, sf_dir):
    return explore.pair_not_null(students(spark, sf_dir), "absences", "g1", ["student_id"])


@register("scatter_points", f"WITH {SP}\nSELECT round(att, 6) AS attendance, round(avg, 6) AS average_score, risk AS risk_category "
                            "FROM spr WHERE att IS NOT NULL AND avg IS NOT NULL")
def q_scatter_points(spark, sf_dir):
    df = students(spark, sf_dir)
    prepared, _ = kpi.prepare(df, detect_roles(df))
    pts = prepared.select(F.col(kpi.ATT).alias("attendance"), F.col(kpi.AVG).alias("average_score"),
                          F.col(kpi.RISK).alias("risk_category"))
    return finish(explore.scatter_points(pts, "attendance", "average_score", "risk_category"))


@register("sorted_series", f"WITH {STUDENTS}\nSELECT studytime, round(avg(g2), 6) AS g2 FROM students "
                           "WHERE studytime IS NOT NULL AND g2 IS NOT NULL GROUP BY studytime ORDER BY studytime")
def q_sorted_series(spark, sf_dir):
    return finish(explore.sorted_series(students(spark, sf_dir), "studytime", "g2", aggregate=True))


@register("sorted_series_points", f"WITH {STUDENTS}\nSELECT studytime, g1 FROM students WHERE studytime IS NOT NULL AND g1 IS NOT NULL ORDER BY studytime, g1")
def q_sorted_series_points(spark, sf_dir):
    """Every point, in order."""
    return explore.sorted_series(students(spark, sf_dir), "studytime", "g1")


@register("scatter_grid", f"""WITH {STUDENTS},
p AS (SELECT CAST(studytime AS DOUBLE) AS x, g2 AS y FROM students),
m AS (SELECT min(x) AS x0, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 20 ELSE 1.0 END AS wx,
             min(y) AS y0, CASE WHEN max(y) > min(y) THEN (max(y) - min(y)) / 20 ELSE 1.0 END AS wy FROM p)
SELECT CAST(least(floor((x - x0) / wx), 19) AS BIGINT) AS bx, CAST(least(floor((y - y0) / wy), 19) AS BIGINT) AS "by", CAST(count(*) AS BIGINT) AS n
FROM p, m WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""")
def q_scatter_grid(spark, sf_dir):
    return finish(explore.scatter_grid(students(spark, sf_dir), "studytime", "g2", 20))


def _kendall_sql():
    long = "\nUNION ALL\n".join(
        f"SELECT {i} AS pair, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM students "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, (a, b) in enumerate(PAIRS))
    names = "\nUNION ALL\n".join(f"SELECT {i} AS pair, '{a}' AS column_a, '{b}' AS column_b"
                                 for i, (a, b) in enumerate(PAIRS))
    return (f"WITH {STUDENTS}, l AS ({long}),\n"
            "p AS (SELECT pair, x, y, count(*) AS w FROM l GROUP BY pair, x, y),\n"
            "s AS (SELECT a.pair, sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s\n"
            "      FROM p a JOIN p b ON a.pair = b.pair GROUP BY a.pair),\n"
            "tx AS (SELECT pair, sum(t * (t - 1) / 2) AS n1, sum(t) AS n FROM (SELECT pair, x, sum(w) AS t FROM p GROUP BY pair, x) q GROUP BY pair),\n"
            "ty AS (SELECT pair, sum(t * (t - 1) / 2) AS n2 FROM (SELECT pair, y, sum(w) AS t FROM p GROUP BY pair, y) q GROUP BY pair),\n"
            f"n AS ({names})\n"
            "SELECT column_a, column_b, round(s / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)), 6) AS tau\n"
            "FROM n LEFT JOIN s ON n.pair = s.pair LEFT JOIN tx ON n.pair = tx.pair LEFT JOIN ty ON n.pair = ty.pair")


@register("correlation_kendall", _kendall_sql())
def q_correlation_kendall(spark, sf_dir):
    return finish(explore.correlation_kendall(students(spark, sf_dir), NUM_COLS))
