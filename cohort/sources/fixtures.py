"""Test tables and the portable student fixture view.

The fixture SQL parses in both Spark SQL and DuckDB, so the same rows feed the
Spark operators and the DuckDB oracle.  It injects nulls, duplicate rows, dirty
Pass/Fail tokens and a high-cardinality string column into the order tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohort.session import scratch_path

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

STUDENTS_SQL = """WITH agg AS (
  SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_ret,
         CAST(sum(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS BIGINT) AS n_disc,
         min(l_quantity) AS q_min, max(l_quantity) AS q_max
  FROM lineitem GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey AS student_id, c.c_mktsegment AS programme, o.o_orderpriority AS support_band,
         CAST(o.o_custkey AS STRING) AS tutor_ref, a.n_lines AS studytime,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE a.n_ret END AS absences, a.n_disc AS failures,
         CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE a.q_min * CAST(0.4 AS DOUBLE) END AS g1,
         a.q_max * CAST(0.4 AS DOUBLE) AS g2,
         CASE WHEN o.o_orderkey % 17 = 0 THEN NULL
              ELSE CAST(floor((a.q_min + a.q_max) * CAST(0.2 AS DOUBLE)) AS DOUBLE) END AS g3,
         CASE o.o_orderstatus WHEN 'F' THEN 'Fail' WHEN 'O' THEN ' PASSED '
              ELSE CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE 'y' END END AS result,
         o.o_orderdate AS recorded_at
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN agg a ON a.l_orderkey = o.o_orderkey)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE student_id % 50 = 0"""

# Document fixture: binary target `quality` with a deterministic score column.
DOCS_SQL = """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

SCORED_SPARK = """SELECT doc_id, lang, source, n_chars, quality, toxic,
  CAST(conv(substr(md5(CAST(doc_id AS STRING)), 1, 4), 16, 10) AS DOUBLE) / 65535 AS p
FROM docs"""

SCORED_DUCK = """SELECT doc_id, lang, source, n_chars, quality, toxic,
  ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4))::BIGINT / 65535.0 AS p
FROM docs"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register the parquet tables as temp views (lazy; nothing is read here)."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["lineitem", "orders", "customer"])
    return spark.sql(STUDENTS_SQL)


def stored_students(spark: SparkSession, sf_dir: str, distinct: bool = False) -> DataFrame:
    """The rows of ``students``, or the distinct ones, written to the shared folder: a query of many passes joins the tables
    and sums the line items once."""
    rows = students(spark, sf_dir)
    rows = rows.dropDuplicates() if distinct else rows
    path = scratch_path(spark, f"students-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["documents", "labels"])
    return spark.sql(DOCS_SQL)


def scored_docs(spark: SparkSession, sf_dir: str, round_to: int | None = None) -> DataFrame:
    docs(spark, sf_dir).createOrReplaceTempView("docs")
    df = spark.sql(SCORED_SPARK)
    if round_to is not None:
        from pyspark.sql import functions as F
        df = df.withColumn("p", F.round("p", round_to))
    return df


def duck_students_cte() -> str:
    return f"students AS (SELECT * FROM ({STUDENTS_SQL}) s)"


def duck_with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def duck_docs_cte() -> str:
    return f"docs AS ({DOCS_SQL})"


def duck_scored_cte(round_to: int | None = None) -> str:
    body = SCORED_DUCK
    if round_to is not None:
        body = f"SELECT * REPLACE (round(p, {round_to}) AS p) FROM ({SCORED_DUCK}) q"
    return f"scored AS ({body})"
