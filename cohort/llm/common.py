"""Helpers shared by the operators: bounded Arrow batches, written intermediate tables, input frames."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.session import scratch_path

#: Rows in one Arrow batch.  A batch of very long texts stays within a few tens of MB.
BATCH_ROWS = 256


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts differ in length by four orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, so later readers (and retries
    after a lost executor) start from files that every executor can see."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    # what the step shuffled isn't needed any more; executors drop it once the driver's garbage is collected
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_text(df: DataFrame, text: str, keep: list[str], make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
             schema: str) -> DataFrame:
    """Run ``make()(texts) -> result columns`` over Arrow batches of ``df``; ``keep`` columns pass through.

    ``make`` is called once per task, so models load once.  Null texts arrive as null.  The columns of
    ``df`` other than ``keep`` and ``text`` are pruned before the batch leaves the JVM; ``keep`` names
    must differ from the result names of ``schema``.
    """
    bounded_batches(df.sparkSession)
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    results = [c.strip().split(" ")[0].strip("`") for c in _split_top(schema)]
    if clash := sorted(set(keep) & set(results)):
        raise ValueError(f"columns to keep have names of results: {', '.join(clash)}")
    names = [*keep, *results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for b in batches:
            work = work or make()
            out = work(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *out], names=names)

    return src.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def _split_top(schema: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in schema:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and not depth:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return [*parts, cur]
