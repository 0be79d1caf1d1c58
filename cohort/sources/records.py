"""Record stores: dataset snapshots (one JSON document per row), their uploads table and a prediction log.

All are tables of one ``Store``: an upload's rows and its entry become visible in one step, a purge or a migration is
one new version of the manifest, and neither a reader nor a crash meets a half written store.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort.operators.ordered import running_sums
from cohort.sources.store import Store

UPLOADS_SCHEMA = ("dataset_id bigint, file_name string, row_count bigint, column_count bigint, "
                  "column_names string, schema_ddl string, created_at timestamp")
ROWS_SCHEMA = "row_number bigint, row_data string, created_at timestamp, dataset_id bigint"
HISTORY_COLUMNS = ["prediction_id", "dataset_name", "model_name", "study_time", "absences", "failures",
                   "previous_grade_1", "previous_grade_2", "predicted_label", "pass_probability",
                   "fail_probability", "risk_level", "recommendation", "created_at"]
HISTORY_SCHEMA = ("prediction_id string, dataset_name string, model_name string, study_time double, absences double, "
                  "failures double, previous_grade_1 double, previous_grade_2 double, predicted_label string, "
                  "pass_probability double, fail_probability double, risk_level string, recommendation string, "
                  "created_at timestamp, day date")
UPLOADS, ROWS, HISTORY = "uploads", "rows", "history"


def uploads(spark: SparkSession, base: str) -> DataFrame:
    return Store(spark, base).read(UPLOADS, UPLOADS_SCHEMA)


def rows_store(spark: SparkSession, base: str, dataset_id: int | None = None) -> DataFrame:
    """All rows, or those of one upload: a segment of its own, so nothing else is read."""
    return Store(spark, base).read(ROWS, ROWS_SCHEMA, None if dataset_id is None else [str(dataset_id)])


def history(spark: SparkSession, base: str) -> DataFrame:
    return Store(spark, base).read(HISTORY, HISTORY_SCHEMA)


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def dense_row_numbers(df: DataFrame, staging: str, name: str = "row_number") -> DataFrame:
    """1..n in the frame's current order via per-bucket running counts (no global window).

    The ids that give the order are written with the rows first: numbering reads one fixed table, so a
    recomputed or differently coalesced input can't repeat or skip numbers.
    """
    df.withColumn("_mid", F.monotonically_increasing_id()).write.mode("overwrite").parquet(staging)
    tagged = df.sparkSession.read.parquet(staging).withColumn("_one", F.lit(1))
    return running_sums(tagged, "_mid", ["_one"]).withColumnRenamed("cum__one", name).drop("_mid", "_one")


def save_snapshot(df: DataFrame, name: str, base: str) -> int:
    """Write rows as JSON documents (NaN as null) with their upload entry, in one step; returns dataset_id.

    Ids come from the clock in microseconds plus random bits, so concurrent uploads don't share one, and
    later uploads have larger ids.
    """
    spark = df.sparkSession
    dataset_id = (time.time_ns() // 1000 << 10) | (uuid.uuid4().int & 1023)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    clean, store, key = df.select(*cols), Store(spark, base), str(dataset_id)
    staging = f"{store.base}/staging/{uuid.uuid4().hex}"
    docs = dense_row_numbers(clean.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                                                    {"ignoreNullFields": "false"}).alias("row_data")), staging)
    now = _now()
    docs = docs.withColumn("created_at", F.lit(now)).withColumn("dataset_id", F.lit(dataset_id).cast("long"))
    rows = store.stage(docs, ROWS)
    n = store.read_folders([rows], ROWS_SCHEMA).count()
    meta = [(dataset_id, name, n, len(df.columns), json.dumps(df.columns), df.schema.simpleString(), now)]
    entry = store.stage(spark.createDataFrame(meta, UPLOADS_SCHEMA), UPLOADS)
    store.put({ROWS: (key, rows), UPLOADS: (key, entry)})
    store.files.delete(staging)
    return dataset_id


def load_snapshot(spark: SparkSession, base: str, dataset_id: int | None = None) -> DataFrame:
    """Rebuild a saved dataset in its stored column order (latest when no id)."""
    ups = uploads(spark, base)
    if dataset_id is None:
        dataset_id = ups.agg(F.max_by("dataset_id", "created_at")).first()[0]
    meta = ups.where(F.col("dataset_id") == dataset_id).first()
    if meta is None:
        raise KeyError(f"dataset {dataset_id} not found")
    schema = T._parse_datatype_string(meta.schema_ddl)
    names = json.loads(meta.column_names)
    rows = rows_store(spark, base, dataset_id)
    decoded = rows.select("row_number", F.from_json("row_data", schema).alias("r"))
    return decoded.select("row_number", *[F.col("r").getField(c).alias(c) for c in names])


def preview_snapshot(spark: SparkSession, base: str, dataset_id: int, limit: int = 100) -> DataFrame:
    return load_snapshot(spark, base, dataset_id).orderBy("row_number").limit(limit)


def recent_uploads(spark: SparkSession, base: str, limit: int = 25) -> DataFrame:
    ups = uploads(spark, base)
    return ups.orderBy(F.desc("created_at"), F.desc("dataset_id")).limit(limit).select(
        "dataset_id", "file_name", "row_count", "column_count",
        F.concat_ws(", ", F.from_json("column_names", "array<string>")).alias("column_names"), "created_at")


def upload_rows(spark: SparkSession, base: str) -> DataFrame:
    """Rows joined to their upload's entry."""
    return rows_store(spark, base).join(uploads(spark, base).select("dataset_id", "file_name"), "dataset_id")


def prediction_rows(scored: DataFrame, dataset_name: str, model_name: str, order: list[str] | None = None) -> DataFrame:
    """Scored requests as rows of the log.  Ids grow with the time of the call and, in it, with ``order`` (or else with the
    rows' place in the frame), so the newest predictions have a stable order."""
    now, call = _now(), time.time_ns() // 1000
    place = F.format_string("%020d-%020d", F.lit(call), F.monotonically_increasing_id())
    scored = scored.orderBy(*order) if order else scored
    return scored.select(place.alias("prediction_id"), F.lit(dataset_name).alias("dataset_name"),
                         F.lit(model_name).alias("model_name"),
                         *[F.col(c).cast("double").alias(c) for c in
                           ["study_time", "absences", "failures", "previous_grade_1", "previous_grade_2"]],
                         "predicted_label", "pass_probability", "fail_probability", "risk_level", "recommendation",
                         F.lit(now).alias("created_at"), F.lit(now.date()).alias("day"))


def log_predictions(scored: DataFrame, dataset_name: str, model_name: str, base: str, order: list[str] | None = None) -> int:
    """Append scored requests to the log; returns how many predictions it then holds."""
    spark = scored.sparkSession
    Store(spark, base).append(prediction_rows(scored, dataset_name, model_name, order), HISTORY)
    return history(spark, base).count()


def recent_predictions(spark: SparkSession, base: str, limit: int = 50) -> DataFrame:
    return history(spark, base).orderBy(F.desc("created_at"), F.desc("prediction_id")).limit(limit)


def record_counts(spark: SparkSession, base: str) -> DataFrame:
    """One row per store, 0 for an empty one; rows count once their upload is complete."""
    def total(df: DataFrame, store: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(store).alias("store"), "count")

    return (total(uploads(spark, base), "dataset_uploads").unionByName(total(upload_rows(spark, base), "dataset_rows"))
            .unionByName(total(history(spark, base), "prediction_history")))


PURGED = {"datasets": {UPLOADS: "dataset_uploads", ROWS: "dataset_rows"}, "history": {HISTORY: "prediction_history"}}
_SCHEMAS = {UPLOADS: UPLOADS_SCHEMA, ROWS: ROWS_SCHEMA, HISTORY: HISTORY_SCHEMA}


def purge_records(spark: SparkSession, base: str, which: str = "all", retention_seconds: float | None = None) -> DataFrame:
    """Drop saved datasets and/or history in one step; returns how many records went.

    Their files stay for readers that began before, until a ``vacuum``; with ``retention_seconds`` older ones go now.
    """
    names = {t: n for part, tables in PURGED.items() if which in ("all", part) for t, n in tables.items()}
    store = Store(spark, base)
    before, _ = store.commit(lambda tables: {t: s for t, s in tables.items() if t not in names})
    out = [(n, store.read_folders(list(before.get(t, {}).values()), _SCHEMAS[t]).count()) for t, n in names.items()]
    if retention_seconds is not None:
        store.vacuum(retention_seconds)
    return spark.createDataFrame(out, "store string, deleted bigint")


def migrate_history(spark: SparkSession, base: str) -> str | None:
    """Archive a history whose columns differ from the expected ones as table legacy_<n>; its files stay where they are.

    A plain Parquet folder ``history`` from before the manifest is taken into the store: as the log's first segment if its
    columns fit, else as an archive.  Returns the archive's name, None if nothing had to be archived.
    """
    store = Store(spark, base)
    plain = store.files.exists(f"{store.base}/{HISTORY}") and not any(HISTORY in s.values() for s in store.live()[1].values())
    folders = [HISTORY] if plain else store.folders(HISTORY)
    if not folders:
        return None
    fits = set(HISTORY_COLUMNS).issubset(store.read_folders(folders, None).columns)
    if fits and not plain:
        return None
    done: list[str] = []

    def change(tables: dict) -> dict:
        done.clear()
        if fits:
            return tables | {HISTORY: {HISTORY: HISTORY} | tables.get(HISTORY, {})}
        n = 1
        while f"legacy_{n}" in tables:
            n += 1
        done.append(f"legacy_{n}")
        rest = {k: f for k, f in tables.get(HISTORY, {}).items() if f not in folders}
        return tables | {HISTORY: rest, f"legacy_{n}": {f: f for f in folders}}

    store.commit(change)
    return done[0] if done else None


def archived(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The rows of an archive that ``migrate_history`` has made, with their own columns."""
    store = Store(spark, base)
    return store.read_folders(store.folders(name), None)


def export_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
