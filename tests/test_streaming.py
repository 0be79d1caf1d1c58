"""Streaming forms agree with their batch forms on the fixture data."""

import uuid

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stream_pass_rate_matches_batch(spark, tmp_path):
    from cohort.functions.labels import normalize_target
    from cohort.sources.fixtures import students
    from cohort.streaming import streams
    src = students(spark, SF).select("recorded_at", normalize_target(F.col("result")).alias("t"))
    path = str(tmp_path / "src")
    src.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(path)
    agg = streams.pass_rate_windows(stream, "recorded_at", "t", watermark="3650 days")
    name = f"pr_{uuid.uuid4().hex[:8]}"
    q = (agg.writeStream.format("memory").queryName(name).outputMode("complete")
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.window_start, r.passes, r.labelled) for r in spark.sql(f"SELECT * FROM {name}").collect()}
    want = {(r.window_start, r.passes, r.labelled) for r in streams.pass_rate_windows(src, "recorded_at", "t").collect()}
    assert got == want


def test_stream_dedup_matches_batch(spark, tmp_path):
    from cohort.sources.fixtures import students
    from cohort.streaming import streams
    src = students(spark, SF).select("student_id", "g1", "recorded_at")
    path = str(tmp_path / "src")
    src.repartition(6, F.xxhash64(F.lit(3), "student_id", "g1")).write.parquet(path)
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(path)
    delay = streams.watermark_for(src, "recorded_at")
    q = (streams.dedup_stream(stream, ["student_id"], "recorded_at", delay).writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) >= 5
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("student_id").distinct().count() == src.select("student_id").distinct().count()


def _stream(spark, path, batches, ddl):
    """A stream whose batches are the given lists of rows, one file each."""
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)


def _at(hour, minute=0):
    import datetime
    return datetime.datetime(2024, 1, 1 + hour // 24, hour % 24, minute)


def test_windows_are_appended_once_and_late_rows_are_counted(spark, tmp_path):
    from cohort.streaming import streams
    ddl = "at timestamp, t string"
    batches = [[(_at(0, 5), "Pass"), (_at(0, 20), "Fail"), (_at(1), None)],
               [(_at(4), "Pass")],
               [(_at(4, 10), None)],  # a batch judges lateness by the watermark of the batch before
               [(_at(0, 50), "Pass"), (_at(3), "Fail"), (_at(1, 30), "Pass")],  # the watermark is at 3:00
               [(_at(9), None)]]
    stream = _stream(spark, str(tmp_path / "src"), batches, ddl)
    sink, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    out = streams.run_pass_rate(stream, "at", "t", sink, ckpt, watermark="1 hour")
    got = sorted((r.window_start, r.passes, r.labelled, r.rows) for r in out.collect())
    assert got == [(_at(0), 1, 2, 2), (_at(1), 0, 0, 1), (_at(3), 0, 1, 1), (_at(4), 1, 1, 2)]
    rows = spark.read.schema(ddl).parquet(str(tmp_path / "src"))
    assert {(r.window_start, r.late) for r in streams.late_by_window(rows, out, "at").collect()} == {(_at(0), 1), (_at(1), 1)}
    again = streams.run_pass_rate(stream, "at", "t", sink, ckpt, watermark="1 hour")  # a restart appends nothing twice
    assert sorted((r.window_start, r.passes, r.labelled, r.rows) for r in again.collect()) == got


def test_end_marker_closes_every_window(spark, tmp_path):
    from cohort.streaming import streams
    ddl, path = "at timestamp, t string", str(tmp_path / "src")
    rows = [[(_at(h, m), "Pass")] for h, m in ((0, 5), (1, 5), (2, 5))]
    stream = _stream(spark, path, rows, ddl)
    streams.end_marker(spark.read.schema(ddl).parquet(path), "at", 3 * 3600).write.mode("append").parquet(path)
    out = streams.run_pass_rate(stream, "at", "t", str(tmp_path / "out"), str(tmp_path / "ckpt"), watermark="1 hour")
    assert sorted(r.window_start for r in out.collect()) == [_at(0), _at(1), _at(2)]
    assert streams.end_marker(spark.createDataFrame([], ddl), "at", 1).count() == 0


def test_dedup_batches_forgets_old_keys_and_keeps_late_rows(spark, tmp_path):
    from cohort.sources.store import Store
    from cohort.streaming import streams
    ddl = "k string, at timestamp, n int"
    batches = [[("a", _at(0), 1), ("a", _at(0, 1), 2), (None, _at(0), 3), ("b", _at(1), 4)],
               [("a", _at(1), 5), (None, _at(1), 6), ("c", _at(2), 7), ("d", None, 8)],
               [("e", _at(40), 9), ("c", _at(2), 10)],
               [("f", _at(3), 11), ("e", _at(40, 30), 12)],  # 3:00 is before 38:00
               [("a", _at(41), 13)]]                         # a was forgotten
    stream = _stream(spark, str(tmp_path / "src"), batches, ddl)
    base = str(tmp_path / "base")
    streams.dedup_batches(stream, ["k"], "at", 2 * 3600, base, str(tmp_path / "ckpt"))
    store = Store(spark, base)

    def numbers(table):
        return sorted(r.n for r in store.read(table, ddl).collect())

    assert numbers("first") == [1, 3, 4, 7, 9, 13] and numbers("late") == [8, 11]
    assert sorted(r.k for r in store.read("seen", "k string, _ts timestamp").collect()) == ["a", "e"]
    before = store.live()
    streams.dedup_batches(stream, ["k"], "at", 2 * 3600, base, str(tmp_path / "other"))  # all batches once more
    assert store.live() == before


def test_a_replayed_batch_is_logged_once(spark, tmp_path):
    from cohort.operators import clean, models, score
    from cohort.sources import records
    from cohort.sources.store import Store
    from cohort.streaming import streams
    form = "student_id int, study_time double, absences double, failures double, previous_grade_1 double, previous_grade_2 double"
    known = [(i, float(i % 5), float(i % 7), float(i % 3), float(i % 20), float((i * 3) % 20)) for i in range(60)]
    train = spark.createDataFrame(known, form)
    model, _ = score.train_scoring_model(train, F.when(F.col("previous_grade_1") >= 10, "Pass").otherwise("Fail"))
    path = models.save_model(model, str(tmp_path / "model"))
    batches = [known[:20], [*known[20:40], (99, None, 1.0, 0.0, 5.0, 5.0)], known[40:]]
    stream = _stream(spark, str(tmp_path / "src"), batches, form)
    limits = clean.data_limits(clean.field_ranges(train, {f: f for f in clean.FORM_FEATURES}))
    base = str(tmp_path / "base")
    for ckpt in ("one", "one", "two"):  # a restart, and a restart that has lost its checkpoint
        streams.score_stream(stream, path, limits, base, str(tmp_path / ckpt), "requests", "Logistic Regression", ["student_id"])
        assert records.history(spark, base).count() == 60
    store = Store(spark, base)
    answers = store.read_folders(store.folders("answers"), None)
    assert answers.count() == 61 and answers.where("errors IS NOT NULL").first().student_id == 99
    assert {r.student_id: r.pass_probability for r in answers.where("errors IS NULL").collect()} == {
        r.student_id: r.pass_probability for r in score.score_table(model, train, ["student_id"], limits)[0].collect()}
    assert records.history(spark, base).select("prediction_id").distinct().count() == 60
