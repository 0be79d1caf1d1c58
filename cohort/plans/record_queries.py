"""Catalog entries: record stores.  Each query writes under a fresh sub-folder
of the session's checkpoint folder and returns what was read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohort.session import scratch_path
from cohort.sources import records
from cohort.plans.common import register, finish, STUDENTS
from cohort.plans.score_queries import LIN, _linear
from cohort.sources.fixtures import students

ALL = ("student_id, programme, support_band, tutor_ref, studytime, absences, failures, g1, g2, g3, result, "
       "recorded_at")


def _base(spark):
    return scratch_path(spark, f"records-{uuid.uuid4().hex}")


def _saved(spark, sf_dir):
    base = _base(spark)
    df = students(spark, sf_dir)
    did = records.save_snapshot(df, "students.csv", base)
    return base, did


@register("save_snapshot", f"WITH {STUDENTS}\nSELECT {ALL} FROM students")
def q_save_snapshot(spark, sf_dir):
    base, did = _saved(spark, sf_dir)
    return records.load_snapshot(spark, base, did).drop("row_number")


@register("load_snapshot", f"WITH {STUDENTS}\nSELECT {ALL} FROM students")
def q_load_snapshot(spark, sf_dir):
    base, _ = _saved(spark, sf_dir)
    return records.load_snapshot(spark, base).drop("row_number")


@register("preview_snapshot", f"WITH {STUDENTS}\nSELECT CAST(count(*) AS BIGINT) AS n, CAST(min(rn) AS BIGINT) AS first_row, "
                              "CAST(max(rn) AS BIGINT) AS last_row FROM (SELECT row_number() OVER () AS rn FROM students) x "
                              "WHERE rn <= 100")
def q_preview_snapshot(spark, sf_dir):
    base, did = _saved(spark, sf_dir)
    p = records.preview_snapshot(spark, base, did, 100)
    return p.agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"))


@register("recent_uploads", f"WITH {STUDENTS}\nSELECT 'students.csv' AS file_name, CAST(count(*) AS BIGINT) AS row_count, "
                            "CAST(12 AS BIGINT) AS column_count, '" + ALL + "' AS column_names, CAST(3 AS BIGINT) AS place FROM students UNION ALL "
                            "SELECT 'customers.csv', CAST(count(*) AS BIGINT), 2, 'c_custkey, c_name', 2 FROM customer UNION ALL "
                            "SELECT 'nations.csv', CAST(count(*) AS BIGINT), 1, 'n_name', 1 FROM nation")
def q_recent_uploads(spark, sf_dir):
    base, _ = _saved(spark, sf_dir)
    records.save_snapshot(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name"), "customers.csv", base)
    records.save_snapshot(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name"), "nations.csv", base)
    newest = Window.orderBy(F.desc("created_at"), F.desc("dataset_id"))  # at most 25 rows
    return records.recent_uploads(spark, base).select("file_name", "row_count", "column_count", "column_names",
                                                      F.row_number().over(newest).cast("long").alias("place"))


@register("upload_rows", f"WITH {STUDENTS}\nSELECT 'students.csv' AS file_name, CAST(count(*) AS BIGINT) AS n FROM students")
def q_upload_rows(spark, sf_dir):
    base, _ = _saved(spark, sf_dir)
    return records.upload_rows(spark, base).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))


def _logged(spark, sf_dir):
    base = _base(spark)
    scored = _linear(spark, sf_dir)
    records.log_predictions(scored.where(F.col("errors").isNull()), "students", "Logistic Regression", base, ["student_id"])
    return base


_LOGGED = ("'students' AS dataset_name, 'Logistic Regression' AS model_name, study_time, absences, failures, previous_grade_1, previous_grade_2, "
           "predicted_label, round(pass_probability, 6) AS pass_probability, round(fail_probability, 6) AS fail_probability, risk_level, recommendation")


@register("log_predictions", LIN + f"\nSELECT {_LOGGED} FROM x WHERE errors IS NULL")
def q_log_predictions(spark, sf_dir):
    """The stored log without its random ids and times; rejected requests have no prediction to log."""
    return finish(records.history(spark, _logged(spark, sf_dir)).drop("prediction_id", "created_at", "day"))


@register("recent_predictions", LIN + f"\nSELECT {_LOGGED} FROM x WHERE errors IS NULL ORDER BY student_id DESC LIMIT 50")
def q_recent_predictions(spark, sf_dir):
    """The fixture's requests are logged in order of student_id, so the newest are those with the largest."""
    return finish(records.recent_predictions(spark, _logged(spark, sf_dir), 50).drop("prediction_id", "created_at", "day"))


@register("record_counts", f"WITH {STUDENTS}\nSELECT 'dataset_uploads' AS store, CAST(1 AS BIGINT) AS count UNION ALL "
                           "SELECT 'dataset_rows', CAST(count(*) AS BIGINT) FROM students UNION ALL SELECT 'prediction_history', CAST(0 AS BIGINT)")
def q_record_counts(spark, sf_dir):
    base, _ = _saved(spark, sf_dir)
    return records.record_counts(spark, base)


@register("purge_records", f"WITH {STUDENTS}\nSELECT 'dataset_uploads' AS store, CAST(1 AS BIGINT) AS deleted UNION ALL "
                           "SELECT 'dataset_rows', CAST(count(*) AS BIGINT) FROM students")
def q_purge_records(spark, sf_dir):
    base, _ = _saved(spark, sf_dir)
    return records.purge_records(spark, base, "datasets")


@register("migrate_history", f"WITH {STUDENTS}\nSELECT CAST(studytime AS DOUBLE) AS study_hours, g1 AS midsem_score FROM students")
def q_migrate_history(spark, sf_dir):
    base = _base(spark)
    old = students(spark, sf_dir).select(F.col("studytime").cast("double").alias("study_hours"),
                                         F.col("g1").alias("midsem_score"))
    old.write.mode("overwrite").parquet(f"{base}/history")
    name = records.migrate_history(spark, base)
    return records.archived(spark, base, name)


@register("export_csv", f"WITH {STUDENTS}\nSELECT CAST(student_id AS VARCHAR) AS student_id, programme, "
                        "CAST(g1 AS VARCHAR) AS g1 FROM students")
def q_export_csv(spark, sf_dir):
    base = _base(spark)
    df = students(spark, sf_dir).select("student_id", "programme", "g1")
    path = records.export_csv(df, f"{base}/export")
    return spark.read.option("header", True).csv(path)
