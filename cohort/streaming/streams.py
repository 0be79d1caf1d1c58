"""Streaming extensions (not present in the surveyed code; clearly ours).

* ``pass_rate_windows``: pass rate per window, with a watermark and append mode on a stream; ``run_pass_rate`` runs it
  into Parquet and ``late_by_window`` tells what came too late for its window.
* ``score_stream``: scores micro-batches with a fitted, stored pipeline and appends them to the prediction log, each
  batch once, however often it is replayed.
* ``dedup_batches``: drops repeated submissions; the keys it remembers expire with the watermark, and rows that are
  older than the watermark go to a table of their own.
* ``dedup_stream``: the library's own deduplication within the watermark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.operators import score
from cohort.sources import records
from cohort.sources.store import Store


def pass_rate_windows(df: DataFrame, ts: str, label: str, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Pass rate per tumbling window; works on a static or a streaming frame."""
    t = F.col(ts).cast("timestamp")
    src = df.withColumn("_ts", t)
    if df.isStreaming:
        src = src.withWatermark("_ts", watermark)
    g = src.groupBy(F.window("_ts", window).alias("w")).agg(
        F.count_if(F.col(label) == "Pass").alias("passes"), F.count(F.col(label)).alias("labelled"), F.count(F.lit(1)).alias("rows"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "passes", "labelled",
                    F.try_divide(F.col("passes") * 100.0, F.col("labelled")).alias("pass_rate"), "rows")


def watermark_for(df: DataFrame, ts: str) -> str:
    """A delay that covers the whole disorder of a bounded source, so that no row of it is late."""
    row = df.agg(F.min(F.col(ts).cast("timestamp")).cast("long").alias("a"), F.max(F.col(ts).cast("timestamp")).cast("long").alias("b")).first()
    return f"{(row.b - row.a if row.a is not None else 0) + 86_400} seconds"


def run_pass_rate(stream: DataFrame, ts: str, label: str, sink: str, checkpoint: str, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Run the windows over what a stream holds so far; a window is appended to ``sink`` once, when the watermark has passed
    its end, and its state is dropped then.

    Returns the appended windows.  Windows that are still open stay in the stream's state for the next run with the
    same checkpoint; ``end_marker`` closes them where a source has an end.
    """
    out = pass_rate_windows(stream, ts, label, window, watermark)
    q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(out.schema).parquet(sink)


def end_marker(rows: DataFrame, ts: str, seconds: int) -> DataFrame:
    """One row of nulls, so many seconds after the last of ``rows``: as a stream's last row it moves the watermark past all
    windows.  The marker's own window stays open."""
    names = {f.name: f.dataType for f in rows.schema.fields}
    last = rows.agg(F.max(F.col(ts).cast("timestamp")).alias("t")).where(F.col("t").isNotNull())
    after = F.timestamp_seconds(F.unix_timestamp("t") + seconds)
    return last.select(*[after.cast(t).alias(c) if c == ts else F.lit(None).cast(t).alias(c) for c, t in names.items()])


def late_by_window(rows: DataFrame, emitted: DataFrame, ts: str, window: str = "1 hour") -> DataFrame:
    """(window_start, late): rows of the source that came after their window had been emitted, for closed windows."""
    seen = rows.groupBy(F.window(F.col(ts).cast("timestamp"), window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    seen = seen.select(F.col("w.start").alias("window_start"), "n")
    return (seen.join(emitted.select("window_start", "rows"), "window_start").where("n > rows")
            .select("window_start", (F.col("n") - F.col("rows")).alias("late")))


def dedup_stream(df: DataFrame, keys: list[str], ts: str, watermark: str = "1 hour") -> DataFrame:
    """First row of each key.  Rows older than the watermark are late and lost: the delay must cover the
    disorder of the source (``watermark_for`` measures it); ``dedup_batches`` keeps late rows."""
    src = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if df.isStreaming:
        return src.withWatermark("_ts", watermark).dropDuplicatesWithinWatermark(keys).drop("_ts")
    return src.dropDuplicates(keys).drop("_ts")


def _run(stream: DataFrame, handle, checkpoint: str, once: bool = True):
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if once else w).start()
    if once:
        q.awaitTermination()
    return q


def dedup_batches(stream: DataFrame, keys: list[str], ts: str, delay_seconds: int, base: str, checkpoint: str, once: bool = True):
    """Drop rows whose key came before, within a delay; returns the query (``once``: it has read what there is).

    The store at ``base`` holds the tables ``first`` (the first row of each key; of equal keys in one batch the
    earliest, then the smallest), ``late`` (rows older than the watermark, which is the largest event time of earlier
    batches less the delay, and rows without an event time), ``seen`` (keys with the event time of their first row) and
    ``clock`` (the largest event time).  A repetition that is not late and within the delay of its first row is dropped, so
    a key leaves ``seen`` two delays after its event time: the state grows with the delay, not with the stream.

    A batch is committed in one step for all tables under its number, so a replay changes nothing.
    """
    spark = stream.sparkSession
    store, names = Store(spark, base), stream.columns
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    seen_ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _ts timestamp"
    delay = F.make_dt_interval(secs=F.lit(delay_seconds))
    event = F.col(f"`{ts}`").cast("timestamp").alias("_ts")

    def handle(batch: DataFrame, batch_id: int):
        tables = store.live()[1]
        if batch_id <= max((int(k) for k in tables.get("clock", {})), default=-1):
            return
        seen = store.read_folders(list(tables.get("seen", {}).values()), seen_ddl)
        newest = store.read_folders(list(tables.get("clock", {}).values()), "_ts timestamp").agg(F.max("_ts")).first()[0]
        batch = batch.select(*[F.col(f"`{c}`") for c in names], event).persist()
        try:
            on_time = F.col("_ts").isNotNull() & (F.lit(True) if newest is None else F.col("_ts") >= F.lit(newest) - delay)
            order = F.struct("_ts", *[F.col(f"`{c}`") for c in names])
            first = batch.where(on_time).groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(order).alias("r")).select("r.*")
            same = reduce(lambda a, b: a & b, [F.col(f"n.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys])
            fresh = first.alias("n").join(seen.alias("s"), same, "left_anti").select(*[F.col(f"n.`{c}`") for c in names])
            staged = {"late": store.stage(batch.where(~on_time).select(*names), "late"), "first": store.stage(fresh, "first")}
            top = max((t for t in (newest, batch.agg(F.max("_ts")).first()[0]) if t), default=None)
        finally:
            batch.unpersist()
        added = store.read_folders([staged["first"]], stream.schema).select(*[F.col(f"`{k}`") for k in keys], event)
        kept = seen.unionByName(added).where(F.col("_ts") >= F.lit(top) - delay - delay)
        state = {"seen": store.stage(kept, "seen"), "clock": store.stage(spark.createDataFrame([(top,)], "_ts timestamp"), "clock")}

        def change(now: dict) -> dict:
            for table, folder in staged.items():
                now.setdefault(table, {})[str(batch_id)] = folder
            return now | {table: {str(batch_id): folder} for table, folder in state.items()}

        store.commit(change)

    return _run(stream, handle, checkpoint, once)


def score_stream(requests: DataFrame, model_path: str, limits: dict, base: str, checkpoint: str, name: str, model_name: str,
                 keep: list[str], once: bool = True):
    """Score a stream of requests (``keep`` columns and the form's features) with the pipeline stored at ``model_path`` and
    append the predictions to the log at ``base``; returns the query.

    Each batch commits its predictions and its ``answers`` (every request with its outputs, or null outputs and its
    errors) in one step under the stream's name and the batch's number.  A batch that is replayed, after a
    failure or by a restart from an older checkpoint, finds its key and changes nothing.
    """
    store, model = Store(requests.sparkSession, base), PipelineModel.load(model_path)

    def handle(batch: DataFrame, batch_id: int):
        key = f"{name}/{batch_id}"
        if key in store.live()[1].get("answers", {}):
            return
        answers = store.stage(score.with_rejects(*score.score_table(model, batch, keep, limits)), "answers")
        scored = store.read_folders([answers], None).where(F.col("errors").isNull())
        logged = store.stage(records.prediction_rows(scored, name, model_name), records.HISTORY)
        store.put({"answers": (key, answers), records.HISTORY: (key, logged)}, once=True)

    return _run(requests, handle, checkpoint, once)


def stream_score(requests: DataFrame, score_batch, sink_path: str, checkpoint: str, trigger_once: bool = True):
    """Run ``score_batch(batch_df) -> DataFrame`` on each micro-batch and append results.

    Each batch is written under batch_id=<n> with overwrite of that partition
    only, so a replayed batch after a failure rewrites the same output.
    """
    def handle(batch: DataFrame, batch_id: int):
        out = score_batch(batch).withColumn("batch_id", F.lit(batch_id))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_path))

    return _run(requests, handle, checkpoint, trigger_once)
