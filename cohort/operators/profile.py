"""Profiling: missing values, distinct counts, describe, identifier and
cardinality checks, completeness, fingerprints.

Wide tables are handled by unpivoting to (column, value) once, so distinct
counts are one two-level aggregate instead of one Expand copy per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort.operators.ordered import exact_percentiles
from cohort.functions.exprs import (col, num_expr, normalize_name, is_numeric_type, is_categorical_type,
                                    is_datetime_type)

# ---- fixed values (identifier heuristics) -----------------------------------
ID_EXPLICIT = ["id", "studentid", "studentnumber", "studentno", "registrationnumber", "regnumber",
               "matricnumber", "admissionnumber", "indexnumber", "candidateid", "userid", "recordid",
               "serialnumber"]
ID_FUZZY = ["studentid", "registration", "matric", "recordid", "serial", "candidateid"]
ID_SUFFIXES = ["id", "number", "no"]
UNIQUENESS_THRESHOLD = 0.9
CARDINALITY_THRESHOLD = 30
# ---------------------------------------------------------------------------


def present(name: str, dt: T.DataType):
    """Non-missing test: NULL and floating NaN are both missing."""
    c = col(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def value_text(name: str, dt: T.DataType):
    """A canonical string for equality tests across types (-0.0 folded, NaN missing)."""
    c = col(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), (c.cast("double") + F.lit(0.0)).cast("string"))
    return c.cast("string")


def missing_frame(df: DataFrame) -> DataFrame:
    """(column_name, position, data_type, non_null, missing, missing_pct, n_rows): one aggregate."""
    fields = df.schema.fields
    wide = df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.count_if(present(f.name, f.dataType)).alias(f"c{i}") for i, f in enumerate(fields)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("position"),
                 F.lit(f.dataType.simpleString()).alias("data_type"),
                 F.col(f"c{i}").alias("non_null"), (F.col("n") - F.col(f"c{i}")).alias("missing"),
                 F.try_divide(F.col("n") - F.col(f"c{i}"), F.col("n") / 100.0).alias("missing_pct"),
                 F.col("n").alias("n_rows"))
        for i, f in enumerate(fields)])))


def column_profile(df: DataFrame) -> DataFrame:
    return missing_frame(df).select("column_name", "position", "data_type", "missing", "missing_pct")


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unpivot to (column_name, value) with canonical strings; missing values dropped."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), value_text(c, types[c]).alias("value"))
        for c in columns]))).where(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, cnt): partial aggregation collapses hot values map-side."""
    return long_values(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))


def distinct_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns if columns is not None else df.columns
    counts = value_counts(df, columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct"))
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in columns], "column_name string")
    # every column appears, also those that are entirely missing (0 distinct)
    return names.join(counts, "column_name", "left").select(
        "column_name", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    return {r.column_name: r.distinct for r in distinct_frame(df, columns).collect()}


def quality_report(df: DataFrame) -> DataFrame:
    miss = missing_frame(df)
    dist = distinct_frame(df)
    return miss.join(dist, "column_name").select(
        "column_name", "position", "data_type", "missing", "missing_pct", F.col("distinct").alias("unique_values"))


def completeness(df: DataFrame) -> DataFrame:
    fields = df.schema.fields
    n_numeric = sum(1 for f in fields if is_numeric_type(f.dataType))
    miss = missing_frame(df)
    cells = F.first("n_rows") * F.lit(len(fields))
    return miss.agg(
        F.coalesce(F.first("n_rows"), F.lit(0)).cast("long").alias("row_count"),
        F.lit(len(fields)).cast("long").alias("column_count"),
        F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("total_missing"),
        F.lit(n_numeric).cast("long").alias("numeric_columns"),
        F.lit(len(fields) - n_numeric).cast("long").alias("non_numeric_columns"),
        F.when(cells > 0, F.lit(100.0) - F.sum("missing") * 100.0 / cells).otherwise(F.lit(100.0))
        .alias("completeness_pct"))


def describe_all(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, unique, top, freq, mean, std (n-1), min, quartiles, max per column.

    Numeric statistics come from one aggregate, quartiles from distributed ranks; unique/top/freq for
    non-numeric columns from one value-count aggregate (top ties: smallest value).
    """
    columns = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in columns if is_numeric_type(types[c])]
    other = [c for c in columns if c not in numeric]
    spark = df.sparkSession
    schema = ("column_name string, count bigint, unique bigint, top string, freq bigint, mean double, "
              "std double, min double, p25 double, p50 double, p75 double, max double")
    parts = []
    if numeric:
        aggs = []
        quart = exact_percentiles(df, {c: num_expr(c, types[c]) for c in numeric}, [0.25, 0.5, 0.75])
        for i, c in enumerate(numeric):
            x = num_expr(c, types[c])
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        wide = df.agg(*aggs)
        parts.append(wide.select(F.inline(F.array(*[F.struct(
            F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"),
            F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top"),
            F.lit(None).cast("long").alias("freq"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
            F.col(f"lo{i}").alias("min"), *[F.lit(quart[c][j]).cast("double").alias(name) for j, name in enumerate(["p25", "p50", "p75"])],
            F.col(f"hi{i}").alias("max")) for i, c in enumerate(numeric)]))))
    if other:
        vc = value_counts(df, other)
        best = vc.groupBy("column_name").agg(
            F.sum("cnt").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("cnt")).alias("k"), F.col("value").alias("v"))).alias("m"))
        names = spark.createDataFrame([(c,) for c in other], "column_name string")
        parts.append(names.join(best, "column_name", "left").select(
            "column_name", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
            F.col("unique").cast("long").alias("unique"), F.col("m.v").alias("top"),
            (-F.col("m.k")).cast("long").alias("freq"),
            *[F.lit(None).cast("double").alias(n) for n in ["mean", "std", "min", "p25", "p50", "p75", "max"]]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_stats(df: DataFrame) -> list[dict]:
    """Per-column facts from three passes (missing counts, distinct counts,
    numeric min/max/fraction) collected as k rows of metadata."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in df.columns if is_numeric_type(types[c])]
    miss = {r.column_name: r for r in missing_frame(df).collect()}
    dist = {r.column_name: r.distinct for r in distinct_frame(df).collect()}
    nums = {}
    if numeric:
        aggs = []
        for i, c in enumerate(numeric):
            x = num_expr(c, types[c])
            aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.count_if(x % 1 != 0).alias(f"f{i}")]
        row = df.agg(*aggs).first()
        nums = {c: (row[f"lo{i}"], row[f"hi{i}"], row[f"f{i}"]) for i, c in enumerate(numeric)}
    out = []
    for i, c in enumerate(df.columns):
        m = miss[c]
        lo, hi, frac = nums.get(c, (None, None, None))
        out.append({"column_name": c, "position": i, "non_null": m.non_null, "n_rows": m.n_rows,
                    "distinct": dist.get(c, 0), "lo": lo, "hi": hi, "fractional": frac,
                    "is_number": is_numeric_type(types[c]), "is_string": isinstance(types[c], T.StringType),
                    "is_categorical": is_categorical_type(types[c])})
    return out


def _is_sequential(s: dict) -> bool:
    n, d = s["non_null"], s["distinct"]
    return (s["is_number"] and n >= 3 and s["fractional"] == 0 and s["hi"] is not None
            and s["hi"] - s["lo"] + 1 == d and d >= max(3, n - 1))


def _ratio(s: dict) -> float:
    return s["distinct"] / s["non_null"] if s["non_null"] > 0 else 0.0


def sequential_ids(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Whole numbers whose sorted gaps are all 0 or 1 with few repeats.

    Gaps in {0, 1} over sorted values is the same as max - min + 1 == distinct,
    so no sort is needed.
    """
    stats = column_stats(df)
    rows = [(s["column_name"], _is_sequential(s)) for s in stats
            if s["is_number"] and (columns is None or s["column_name"] in columns)]
    return df.sparkSession.createDataFrame(rows, "column_name string, sequential boolean")


def unique_ratio(df: DataFrame) -> DataFrame:
    miss = missing_frame(df)
    dist = distinct_frame(df)
    return miss.join(dist, "column_name").select(
        "column_name", F.when(F.col("non_null") > 0, F.col("distinct") / F.col("non_null"))
        .otherwise(F.lit(0.0)).alias("unique_ratio"))


def _name_reason(name: str) -> str | None:
    norm = normalize_name(name)
    if norm in ID_EXPLICIT:
        return "explicit name"
    if any(t in norm for t in ID_FUZZY) or any(norm.endswith(s) for s in ID_SUFFIXES):
        return "name pattern"
    return None


def _identifier_reason(s: dict, threshold: float) -> str | None:
    reason = _name_reason(s["column_name"])
    if reason:
        return reason
    almost = s["n_rows"] > 0 and _ratio(s) >= threshold
    if almost and _is_sequential(s):
        return "sequence"
    if almost and s["is_string"]:
        return "near-unique text"
    return None


def identifier_columns(df: DataFrame, threshold: float = UNIQUENESS_THRESHOLD, stats: list | None = None) -> DataFrame:
    """(column_name, position, is_identifier, reason) for every column."""
    stats = stats or column_stats(df)
    rows = []
    for s in stats:
        reason = _identifier_reason(s, threshold)
        rows.append((s["column_name"], s["position"], reason is not None, reason))
    return df.sparkSession.createDataFrame(rows, "column_name string, position int, is_identifier boolean, reason string")


def high_cardinality(df: DataFrame, columns: list[str] | None = None,
                     threshold: int = CARDINALITY_THRESHOLD) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = columns or [c for c in df.columns if is_categorical_type(types[c])]
    return distinct_frame(df, columns).select(
        "column_name", "distinct", (F.col("distinct") > threshold).alias("high_cardinality"))


def _plan_rows(stats: list[dict], threshold: int) -> list[tuple]:
    rows = []
    for s in stats:
        reason = _identifier_reason(s, UNIQUENESS_THRESHOLD)
        if reason is not None:
            grp = "identifier"
        elif s["is_number"]:
            grp = "numeric"
        elif s["is_categorical"] and s["distinct"] > threshold:
            grp = "high_cardinality"
        elif s["is_categorical"]:
            grp = "categorical"
        else:
            grp = "unused"
        rows.append((s["column_name"], s["position"], grp, reason))
    return rows


def column_plan(df: DataFrame, threshold: int = CARDINALITY_THRESHOLD) -> DataFrame:
    """(column_name, position, grp, reason): numeric / categorical kept, or why excluded."""
    return df.sparkSession.createDataFrame(_plan_rows(column_stats(df), threshold),
                                           "column_name string, position int, grp string, reason string")


def plan_lists(df: DataFrame, threshold: int = CARDINALITY_THRESHOLD) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "identifier": [], "high_cardinality": [],
                                 "unused": []}
    for name, _, grp, _ in _plan_rows(column_stats(df), threshold):
        out[grp].append(name)
    return out


def row_text(df: DataFrame):
    """One canonical string per row (NULL marked) for hashing."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws("|", *[F.coalesce(value_text(c, types[c]), F.lit("\\N")) for c in df.columns])


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content signature: rows, columns, xor and sum of md5 row hashes."""
    h = F.md5(row_text(df))
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.coalesce(F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("long")), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(F.conv(F.substring("h", 17, 8), 16, 10).cast("decimal(38,0)")),
                   F.lit(0).cast("decimal(38,0)")).cast("string").alias("sum_hash"))
