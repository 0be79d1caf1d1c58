"""Ordered computations without single-partition windows.

``running_sums`` gives inclusive running totals over a key, optionally within groups.  One range shuffle by (group, key)
puts the rows in order over the partitions; each partition adds up its own rows and the result is written once.
A group goes over a partition's end at most once, so what a partition must add to the rows of its first group is one
row of numbers: as many carries as there are partitions, whatever the number of groups.  The input is read twice (the
sample that balances the ranges, and the shuffle), the written rows once for the carries and then by the caller.
Partition numbers are stored with the rows, so a retry or another plan on top can't change them.

Callers aggregate to distinct keys first, so one hot key value is a single row here; a hot group is cut like any other.

``exact_percentiles`` ranks distinct values with it, so no task ever holds all values of a column.
"""

from __future__ import annotations

import uuid
from functools import reduce
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort.session import scratch_path


def _opens(columns: list[pa.Array], n: int) -> np.ndarray:
    """Where a row's group differs from that of the row before (the first row's isn't judged); null equals null."""
    out = np.zeros(n, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(c.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        out[1:] |= pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def _added(df: DataFrame, sums: list[str]) -> list[T.StructField]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [T.StructField(f"cum_{c}", T.DoubleType() if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else T.LongType()) for c in sums]


def running_sums(df: DataFrame, key: str, sums: list[str], group: list[str] | None = None,
                 descending: bool = False, buckets: int | None = None, ties: list[str] | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum of c in key order) for each c in sums, whole or floating-point numbers; a null adds
    nothing.  Keys keep their type; null keys come first, or last if ``descending``; rows with equal keys follow the order
    of the ``ties`` columns.  ``buckets``: number of range partitions (the session's by default).
    """
    group, spark = list(group or []), df.sparkSession
    order = [*[F.asc(f"`{g}`") for g in group], F.desc(f"`{key}`") if descending else F.asc(f"`{key}`"), *[F.asc(f"`{t}`") for t in ties or []]]
    src = df.repartitionByRange(*([buckets] if buckets else []), *order).sortWithinPartitions(*order)
    names, added = df.columns, _added(df, sums)
    schema = T.StructType([*df.schema.fields, *added, *[T.StructField(c, T.LongType()) for c in ("_part", "_segment", "_at")]])
    at, of = [names.index(c) for c in sums], [names.index(g) for g in group]
    whole = [isinstance(f.dataType, T.LongType) for f in added]

    def local(batches):
        part, segment, place, last, totals = TaskContext.get().partitionId(), 0, 0, None, [0] * len(sums)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            columns = [b.column(i) for i in of]
            opens = _opens([pa.concat_arrays([x, c]) for x, c in zip(last, columns)], n + 1)[1:] if last is not None else _opens(columns, n)
            last = [c.slice(n - 1) for c in columns]
            seg = np.cumsum(opens)
            first = np.flatnonzero(opens) if opens[0] else np.concatenate(([0], np.flatnonzero(opens)))
            of_row = seg - 1 if opens[0] else seg
            out = []
            for j, i in enumerate(at):
                v = pc.fill_null(b.column(i), 0).to_numpy(zero_copy_only=False).astype(np.int64 if whole[j] else np.longdouble)
                c = np.cumsum(v)
                before = c[first] - v[first]
                if not opens[0]:
                    before[0] -= totals[j]
                c = c - before[of_row]
                totals[j] = c[-1]
                out.append(pa.array(c.astype(np.int64 if whole[j] else np.float64)))
            marks = [np.full(n, part), segment + seg, place + np.arange(n)]
            segment, place = segment + int(seg[-1]), place + n
            yield pa.RecordBatch.from_arrays([*b.columns, *out, *[pa.array(m, pa.int64()) for m in marks]], names=schema.names)

    path = scratch_path(spark, f"ordered-{uuid.uuid4().hex}")
    src.mapInArrow(local, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    cums = [F.col(f"`cum_{c}`") for c in sums]
    if not group:
        ends = rows.groupBy("_part").agg(F.max_by(F.struct(*cums), "_at").alias("t")).select("_part", F.lit(0).alias("segments"), F.lit(None).alias("a"), F.lit(None).alias("z"), "t")
    else:
        g, spot = F.struct(*[F.col(f"`{c}`") for c in group]), F.struct("_segment", "_at")
        ends = rows.groupBy("_part").agg(F.max("_segment").alias("segments"), F.min_by(g, spot).alias("a"), F.max_by(g, spot).alias("z"), F.max_by(F.struct(*cums), spot).alias("t"))
    carries, before, total = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row a partition
        end = list(r["t"])
        if before is not None and _same(before[0], r["a"]):
            carries.append((r["_part"], *total))
            if r["segments"] == 0:
                end = [x + y for x, y in zip(end, total)]
        before, total = (r["z"],), end
    if not carries:
        return rows.select(*[F.col(f"`{c}`") for c in names], *cums)
    more = spark.createDataFrame(carries, T.StructType([T.StructField("_of", T.LongType()), *[T.StructField(f"_c{j}", f.dataType) for j, f in enumerate(added)]]))
    rows = rows.join(F.broadcast(more), (F.col("_part") == F.col("_of")) & (F.col("_segment") == 0), "left")
    return rows.select(*[F.col(f"`{c}`") for c in names],
                       *[(x + F.coalesce(F.col(f"_c{j}"), F.lit(0))).cast(added[j].dataType).alias(added[j].name) for j, x in enumerate(cums)])


def previous_rows(df: DataFrame, key: str, take: list[str], group: list[str], ties: list[str] | None = None) -> DataFrame:
    """Add ``_previous``: the ``take`` columns of the row before in key order within its group; the group's first row has
    those of its last.  Groups are few: a row for each part of a group in each partition reaches the driver.
    """
    spark, names = df.sparkSession, df.columns
    order = [F.asc(f"`{c}`") for c in [*group, key, *(ties or [])]]
    src = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = {f.name: f for f in df.schema.fields}
    marks = [T.StructField(c, T.LongType()) for c in ("_part", "_segment", "_at")]
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"_p{j}", kinds[c].dataType) for j, c in enumerate(take)], *marks])
    of, at = [names.index(g) for g in group], [names.index(c) for c in take]

    def local(batches):
        part, segment, place, last = TaskContext.get().partitionId(), 0, 0, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            held = [pa.concat_arrays([x, b.column(i)]) for x, i in zip(last, [*of, *at])] if last is not None else [
                pa.concat_arrays([b.column(i).slice(0, 1), b.column(i)]) for i in [*of, *at]]
            opens = _opens(held[:len(of)], n + 1)[1:]
            seg = segment + np.cumsum(opens)
            last = [h.slice(n) for h in held]
            numbers = [np.full(n, part), seg, place + np.arange(n)]
            segment, place = int(seg[-1]), place + n
            yield pa.RecordBatch.from_arrays([*b.columns, *[h.slice(0, n) for h in held[len(of):]], *[pa.array(m, pa.int64()) for m in numbers]], names=schema.names)

    path = scratch_path(spark, f"ordered-{uuid.uuid4().hex}")
    src.mapInArrow(local, schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    ends = rows.groupBy("_part", "_segment").agg(F.min("_at").alias("_at"), F.first(F.struct(*[F.col(f"`{g}`") for g in group])).alias("g"),
                                                 F.max_by(F.struct(*[F.col(f"`{c}`") for c in take]), "_at").alias("z")).collect()
    ends.sort(key=lambda r: (r["_part"], r["_segment"]))
    donors, i = [], 0
    while i < len(ends):
        j = i + 1
        while j < len(ends) and _same(ends[i]["g"], ends[j]["g"]):
            j += 1
        donors += [(ends[k]["_part"], ends[k]["_at"], ends[k - 1 if k > i else j - 1]["z"]) for k in range(i, j)]
        i = j
    pair = T.StructType([kinds[c] for c in take])
    firsts = spark.createDataFrame(donors, T.StructType([T.StructField("_of", T.LongType()), T.StructField("_first", T.LongType()), T.StructField("_z", pair)]))
    rows = rows.join(F.broadcast(firsts), (F.col("_part") == F.col("_of")) & (F.col("_at") == F.col("_first")), "left")
    inner = F.struct(*[F.col(f"_p{j}").alias(c) for j, c in enumerate(take)])
    return rows.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col("_z"), inner).alias("_previous"))


def _same(a, b) -> bool:
    """Equality of groups: null equals null, NaN equals NaN."""
    return (a is None and b is None) or all(x == y or (x != x and y != y) for x, y in zip(a, b))


def average_ranks(df: DataFrame, value: str, group: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Distinct (group, value) with the average 1-based rank of value within its group; a row counts
    ``weight`` times."""
    group = group or []
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(n.alias("_n"))
    ranked = running_sums(counts, value, ["_n"], group)
    return ranked.select(*group, value, (F.col("cum__n") - (F.col("_n") - 1) / 2.0).alias("avg_rank"))


def exact_percentiles(df: DataFrame, columns: dict, probs: list[float]) -> dict[str, list[float | None]]:
    """Exact percentiles (linear interpolation) of named columns: {name: [value per probability]}.

    All columns are unpivoted to (name, value) and counted by value, so a frequent value is one row; running
    counts then give each value's ranks.  Only the values at the wanted ranks reach the driver.  Null values
    are left out; a column without values gives None.
    """
    found = group_percentiles(df, columns, probs, [])
    at = {r["_c"]: r["p"] for r in found.collect()}  # one row per column
    return {name: at.get(name, [None] * len(probs)) for name in columns}


def group_percentiles(df: DataFrame, columns: dict, probs: list[float], group: list[str]) -> DataFrame:
    """(group, _c, p array<double>): exact percentiles of each named column in each group; a column without values in
    a group has no row.  Groups are not held by the driver."""
    pairs = [F.struct(F.lit(name).alias("_c"), c.cast("double").alias("_v")) for name, c in columns.items()]
    groups = [F.col(f"`{g}`") for g in group]
    counts = df.select(*groups, F.inline(F.array(*pairs))).where(F.col("_v").isNotNull()).groupBy(*groups, "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(counts, "_v", ["_n"], [*group, "_c"])
    sizes = ranked.groupBy(*groups, "_c").agg(F.max("cum__n").alias("_m"))
    same = reduce(lambda a, b: a & b, [F.col(f"r.`{g}`").eqNullSafe(F.col(f"s.`{g}`")) for g in [*group, "_c"]])
    rows = ranked.alias("r").join(sizes.alias("s"), same).select("r.*", "_m")
    last, held, out = F.col("_m") - 1, [], []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * last
        k = F.floor(place)
        for name, rank in (("a", k), ("b", F.least(k + 1, last))):  # the first value whose running count passes a rank holds it
            held.append(F.min(F.when(F.col("cum__n") > rank, F.col("_v"))).alias(f"_{name}{i}"))
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        out.append(F.when(a == b, a).otherwise((k + 1 - place) * a + (place - k) * b))
    found = rows.groupBy(*groups, "_c", "_m").agg(*held)
    return found.select(*groups, "_c", F.array(*out).alias("p"))
