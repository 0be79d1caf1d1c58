"""Catalog entries: streaming operators, driven by a file stream of the fixture data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohort.functions.labels import normalize_target
from cohort.session import scratch_path
from cohort.operators import clean, kpi, models, score
from cohort.operators.roles import detect_roles
from cohort.plans.score_queries import INTERCEPT, WEIGHTS, sql_linear
from cohort.sources import records
from cohort.sources.store import Store
from cohort.streaming import streams
from cohort.plans.common import register, finish, STUDENTS, TARGET_SQL
from cohort.sources.fixtures import stored_students, students


COLUMNS = ["student_id", "studytime", "absences", "failures", "g1", "g2", "recorded_at"]
#: Parts of time in which the fixture's rows arrive.
SLICES = 4
HOUR = 3600
#: Rows of a file of the request stream, about, where there are more than four files' worth.
FILE_ROWS = 200_000


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _arrivals(rows, ts):
    """(stream, folder, delay in seconds): the rows written slice after slice of time, as a source would, then a
    marker of the end.  A batch has one slice's files or so, so the delay is the longest slice and a margin."""
    spark = rows.sparkSession
    path, t = _scratch(spark, "arrivals"), F.col(ts).cast("timestamp")
    rows.write.parquet(f"{path}-all")
    rows = spark.read.parquet(f"{path}-all")
    edges = rows.agg(F.percentile_approx(t, [i / SLICES for i in range(SLICES + 1)])).first()[0] or []
    files = max(1, spark.sparkContext.defaultParallelism // 4)
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        part = rows.where(t >= F.lit(low) if i else (t >= F.lit(low)) | t.isNull()).where(t < F.lit(high) if i < SLICES - 1 else F.lit(True))
        part.repartition(files).write.mode("append").parquet(path)
    delay = max([int((b - a).total_seconds()) for a, b in zip(edges, edges[1:])], default=0) + 2 * HOUR
    streams.end_marker(rows, ts, delay + 2 * HOUR).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path), rows, delay


@register("stream_pass_rate", f"""WITH {STUDENTS}, t AS (SELECT recorded_at, {TARGET_SQL} AS t FROM students)
SELECT time_bucket(INTERVAL 1 HOUR, recorded_at) AS window_start, time_bucket(INTERVAL 1 HOUR, recorded_at) + INTERVAL 1 HOUR AS window_end,
  CAST(count_if(t = 'Pass') AS BIGINT) AS passes, CAST(count(t) AS BIGINT) AS labelled,
  round(count_if(t = 'Pass') * 100.0 / count(t), 6) AS pass_rate, CAST(0 AS BIGINT) AS late FROM t GROUP BY 1, 2 HAVING count(t) > 0""")
def q_stream_pass_rate(spark, sf_dir):
    """The stream itself: windows appended as the watermark passes them, and the rows that came too late for each (none)."""
    df = students(spark, sf_dir).select("recorded_at", normalize_target(F.col("result")).alias("t"))
    stream, rows, delay = _arrivals(df, "recorded_at")
    out = streams.run_pass_rate(stream, "recorded_at", "t", _scratch(spark, "stream-out"), _scratch(spark, "ckpt"), watermark=f"{delay} seconds")
    out = out.join(streams.late_by_window(rows, out, "recorded_at"), "window_start", "left")
    return finish(out.where(F.col("labelled") > 0).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"), "passes", "labelled", "pass_rate",
        F.coalesce("late", F.lit(0)).cast("long").alias("late")))


def _stream_source(df):
    """(stream, the same rows as a table): files of bounded size in hash order, a quarter of them per micro-batch."""
    spark = df.sparkSession
    path = _scratch(spark, "stream-src")
    src = df.select(*COLUMNS)
    each = max(1, -(-src.count() // (SLICES * FILE_ROWS)))
    src.repartition(SLICES * each, F.xxhash64(F.lit(1), "student_id", "recorded_at")).write.parquet(path)
    return spark.readStream.schema(src.schema).option("maxFilesPerTrigger", each).parquet(path), spark.read.parquet(path)


@register("stream_dedup", f"WITH {STUDENTS}\nSELECT DISTINCT {', '.join(COLUMNS)}, false AS late FROM students")
def q_stream_dedup(spark, sf_dir):
    """First rows and late rows (none: the source is in order up to the delay), with state that expires."""
    stream, rows, delay = _arrivals(students(spark, sf_dir).select(*COLUMNS), "recorded_at")
    base = _scratch(spark, "dedup")
    streams.dedup_batches(stream, ["student_id"], "recorded_at", delay, base, _scratch(spark, "ckpt"))
    store, ddl = Store(spark, base), rows.schema
    first, late = (store.read_folders(store.folders(t), ddl).withColumn("late", F.lit(t == "late")) for t in ("first", "late"))
    return first.unionByName(late).where(F.col("student_id").isNotNull())  # without the marker


MAPPING = {"study_time": "studytime", "absences": "absences", "failures": "failures", "previous_grade_1": "g1", "previous_grade_2": "g2"}


@register("stream_score", sql_linear(centred=False) + """
SELECT student_id, errors IS NULL AS logged, errors, CAST(count(*) AS BIGINT) AS n, true AS same_as_batch FROM x GROUP BY student_id, errors""")
def q_stream_score(spark, sf_dir):
    """A fitted pipeline, stored and loaded by the stream: every request with its errors, whether it is in the log, and
    whether its logged probability is the one that the model gives in a batch."""
    df = stored_students(spark, sf_dir)
    roles = detect_roles(df)
    target = kpi.target_column(df, roles, kpi.scale_stats(df, roles), "fail")
    feats, _, _ = clean.model_features(df.withColumn("_t", target), MAPPING, keep=["student_id", "_t"])
    model, _ = score.train_scoring_model(feats, F.col("_t"))
    path = models.save_model(model, _scratch(spark, "model"))
    stream, rows = _stream_source(df)
    limits = clean.data_limits(clean.field_ranges(rows, MAPPING))
    base = _scratch(spark, "scores")
    requests, _, _ = clean.model_features(stream, MAPPING, keep=["student_id"])
    streams.score_stream(requests, path, limits, base, _scratch(spark, "ckpt"), "students", "Logistic Regression", ["student_id"])
    store = Store(spark, base)
    answers = store.read_folders(store.folders("answers"), None)
    batch = score.with_rejects(*score.score_table(model, clean.model_features(rows, MAPPING, keep=["student_id"])[0], ["student_id"], limits))
    logged = records.history(spark, base).groupBy(F.round("pass_probability", 9).alias("p")).agg(F.count(F.lit(1)).alias("in_log"))

    def by_request(frame, name):
        return frame.groupBy("student_id", "errors", F.round("pass_probability", 9).alias("p")).agg(F.count(F.lit(1)).alias(name))

    both = by_request(answers, "n").alias("a").join(by_request(batch, "m").alias("b"), F.col("a.student_id").eqNullSafe(F.col("b.student_id"))
                                                    & F.col("a.errors").eqNullSafe(F.col("b.errors")) & F.col("a.p").eqNullSafe(F.col("b.p")), "full")
    both = both.select("a.student_id", "a.errors", "a.p", "n", (F.col("n").eqNullSafe(F.col("m"))).alias("same_as_batch"))
    return both.join(logged, "p", "left").select("student_id", F.col("in_log").isNotNull().alias("logged"), "errors", "n", "same_as_batch")


@register("stream_score_linear", sql_linear(centred=False) + """
SELECT student_id, round(pass_probability, 6) AS pass_probability, predicted_label, risk_level, errors FROM x""")
def q_stream_score_linear(spark, sf_dir):
    """The scoring chain with stated coefficients, whose every value SQL can check."""
    stream, rows = _stream_source(stored_students(spark, sf_dir))
    limits = clean.data_limits(clean.field_ranges(rows, MAPPING))

    def batch_scores(b):
        feats, _, _ = clean.model_features(b, MAPPING, keep=["student_id"])
        checked = clean.scoring_input_check(feats, limits)
        valid = checked.where(F.size("errors") == 0).drop("errors")
        return score.with_rejects(score.score_linear(valid, WEIGHTS, INTERCEPT, {}, {}), checked.where(F.size("errors") > 0))

    sink = _scratch(spark, "stream-out")
    streams.stream_score(stream, batch_scores, sink, _scratch(spark, "ckpt"))
    return finish(spark.read.parquet(sink).select("student_id", "pass_probability", "predicted_label", "risk_level", "errors"))
