"""Shared pieces for catalog entries: output normalisation and SQL snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort.functions.labels import PASS_TOKENS, FAIL_TOKENS
from cohort.sources.fixtures import STUDENTS_SQL, DOCS_SQL, SCORED_DUCK

QUERIES: dict = {}
ORACLES: dict = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places, fold -0.0, widen ints to bigint: stable cross-engine values."""
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = (F.round(c.cast("double"), 6) + F.lit(0.0))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


TARGET_SQL = (f"CASE WHEN lower(trim(CAST(result AS VARCHAR))) IN ({sql_list(PASS_TOKENS)}) THEN 'Pass' "
              f"WHEN lower(trim(CAST(result AS VARCHAR))) IN ({sql_list(FAIL_TOKENS)}) THEN 'Fail' END")

STUDENTS = f"students AS (SELECT * FROM ({STUDENTS_SQL}) s0)"

# Students with the derived per-row fields the Spark operators add:
#   t = Pass/Fail/NULL, avg = scaled null-skipping mean of g1..g3, att = absence-based attendance.
SP = STUDENTS + f""",
mx AS (SELECT greatest(max(g1), max(g2), max(g3)) AS smax, CAST(max(absences) AS DOUBLE) AS amax FROM students),
sp AS (
  SELECT s.*, {TARGET_SQL} AS t,
    (coalesce(g1, 0.0) + coalesce(g2, 0.0) + coalesce(g3, 0.0))
      / nullif((CASE WHEN g1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN g2 IS NULL THEN 0 ELSE 1 END)
               + (CASE WHEN g3 IS NULL THEN 0 ELSE 1 END), 0)
      * (CASE WHEN mx.smax <= 1.5 THEN 100.0 WHEN mx.smax <= 20 THEN 5.0 ELSE 1.0 END) AS avg,
    CASE WHEN absences IS NOT NULL THEN least(greatest(1.0 - CAST(absences AS DOUBLE) / greatest(mx.amax, 1.0), 0.0), 1.0) * 100 END AS att
  FROM students s, mx),
spr AS (
  SELECT *, CASE WHEN t = 'Pass' AND avg >= 75 THEN 'High Performers'
                 WHEN t = 'Fail' THEN 'At-Risk Students'
                 WHEN att < 75 THEN 'At-Risk Students'
                 WHEN avg < 60 THEN 'At-Risk Students'
                 WHEN att >= 75 AND att < 88 THEN 'Average Progress'
                 WHEN avg >= 75 THEN 'High Performers'
                 ELSE 'Average Progress' END AS risk
  FROM sp)"""

DOCS = f"docs AS ({DOCS_SQL})"
SCORED = DOCS + f",\nscored AS ({SCORED_DUCK})"
