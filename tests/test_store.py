"""The manifest store: one-step changes, replays, readers and writers at the same time, purges and migrations."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from cohort.sources import records
from cohort.sources.store import Store

SCHEMA = "a int, b string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows(store, table="t"):
    return sorted(tuple(r) for r in store.read(table, SCHEMA).collect())


def frame(spark, *values):
    return spark.createDataFrame([(v, str(v)) for v in values], SCHEMA)


def test_empty_append_and_replace(spark, store):
    assert rows(store) == [] and store.live() == (0, {}) and store.columns("t") is None
    store.append(frame(spark, 1, 2), "t", "x")
    store.append(frame(spark, 3), "t")
    assert [a for a, _ in rows(store)] == [1, 2, 3]
    store.append(frame(spark, 7), "t", "x")  # the same key replaces its segment
    assert [a for a, _ in rows(store)] == [3, 7]


def test_a_replayed_write_changes_nothing(spark, store):
    first = store.stage(frame(spark, 1), "t")
    assert store.put({"t": ("batch-0", first)}, once=True)
    again = store.stage(frame(spark, 1), "t")
    assert not store.put({"t": ("batch-0", again)}, once=True)
    assert [a for a, _ in rows(store)] == [1] and store.live()[0] == 1


def test_a_write_that_breaks_off_is_not_seen(spark, store):
    store.append(frame(spark, 1), "t")
    store.stage(frame(spark, 2), "t")  # the writer dies before it commits
    assert [a for a, _ in rows(store)] == [1]
    assert store.vacuum(0) == 1 and [a for a, _ in rows(store)] == [1]


def test_a_reader_keeps_the_version_it_began_with(spark, store):
    store.append(frame(spark, 1, 2), "t", "x")
    before = store.read("t", SCHEMA)
    store.commit(lambda tables: {})
    assert before.count() == 2 and rows(store) == []
    assert store.vacuum(3600) == 0 and before.count() == 2
    assert store.vacuum(0) == 1


def test_concurrent_writers_lose_nothing(spark, store):
    folders = [store.stage(frame(spark, i), "t") for i in range(8)]
    threads = [threading.Thread(target=store.put, args=({"t": (str(i), f)},)) for i, f in enumerate(folders)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [a for a, _ in rows(store)] == list(range(8)) and store.live()[0] == 8


def test_compaction_keeps_rows_and_segments_that_come_meanwhile(spark, store, monkeypatch):
    for i in range(3):
        store.append(frame(spark, i), "t", str(i))
    stage = store.stage

    def late(df, table):
        folder = stage(df, table)
        monkeypatch.setattr(store, "stage", stage)
        store.append(frame(spark, 9), "t", "late")
        return folder

    monkeypatch.setattr(store, "stage", late)
    store.compact("t", SCHEMA, "all")
    assert [a for a, _ in rows(store)] == [0, 1, 2, 9] and list(store.live()[1]["t"]) == ["all", "late"]


def test_snapshots_are_seen_with_their_entry_or_not_at_all(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "records")
    a = records.save_snapshot(frame(spark, 1, 2, 3), "a.csv", base)
    monkeypatch.setattr(Store, "put", lambda *x, **y: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        records.save_snapshot(frame(spark, 4), "b.csv", base)
    monkeypatch.undo()
    assert records.upload_rows(spark, base).count() == records.rows_store(spark, base).count() == 3
    assert sorted(r.a for r in records.load_snapshot(spark, base, a).collect()) == [1, 2, 3]


def test_purge_counts_what_it_drops_and_leaves_the_rest(spark, tmp_path):
    base = str(tmp_path / "records")
    records.save_snapshot(frame(spark, 1, 2), "a.csv", base)
    log = spark.range(5).select(*[F.lit(1.0).alias(c) for c in ("study_time", "absences", "failures", "previous_grade_1", "previous_grade_2", "pass_probability", "fail_probability")],
                                *[F.lit("x").alias(c) for c in ("predicted_label", "risk_level", "recommendation")])
    assert records.log_predictions(log, "d", "m", base) == 5
    gone = {r.store: r.deleted for r in records.purge_records(spark, base, "datasets", retention_seconds=0).collect()}
    assert gone == {"dataset_uploads": 1, "dataset_rows": 2}
    assert {r.store: r["count"] for r in records.record_counts(spark, base).collect()} == {"dataset_uploads": 0, "dataset_rows": 0, "prediction_history": 5}
    assert {r.store: r.deleted for r in records.purge_records(spark, base).collect()} == {"dataset_uploads": 0, "dataset_rows": 0, "prediction_history": 5}


def test_migration_archives_or_adopts_a_plain_folder(spark, tmp_path):
    base = str(tmp_path / "old")
    frame(spark, 1).write.parquet(f"{base}/history")
    assert records.migrate_history(spark, base) == "legacy_1" and records.migrate_history(spark, base) is None
    assert records.archived(spark, base, "legacy_1").columns == ["a", "b"] and records.history(spark, base).count() == 0
    base = str(tmp_path / uuid.uuid4().hex)
    spark.range(2).select(*[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in records.HISTORY_SCHEMA.split(", ")]).write.parquet(f"{base}/history")
    assert records.migrate_history(spark, base) is None and records.history(spark, base).count() == 2
