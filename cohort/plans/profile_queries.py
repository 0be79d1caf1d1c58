"""Catalog entries: profiling and data-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.operators import profile
from cohort.plans.common import register, finish, STUDENTS
from cohort.sources.fixtures import students, table

# Spark type names of the fixture columns (the SQL oracle cannot introspect names/types).
STUDENT_COLS = [("student_id", "bigint"), ("programme", "string"), ("support_band", "string"),
                ("tutor_ref", "string"), ("studytime", "bigint"), ("absences", "bigint"), ("failures", "bigint"),
                ("g1", "double"), ("g2", "double"), ("g3", "double"), ("result", "string"),
                ("recorded_at", "timestamp_ntz")]
CUSTOMER_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")]
NUMERIC = {"bigint", "int", "double"}


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _vtext(c, t):
    return f"CAST(({c} + 0.0) AS VARCHAR)" if t == "double" else f"CAST({c} AS VARCHAR)"


def _missing_sql(src, cols):
    return _union([f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS data_type, "
                   f"CAST(count({c}) AS BIGINT) AS non_null, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
                   f"round((count(*) - count({c})) / (count(*) / 100.0), 6) AS missing_pct FROM {src}"
                   for i, (c, t) in enumerate(cols)])


def _distinct_sql(src, cols):
    return _union([f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {_vtext(c, t)}) AS BIGINT) AS distinct_n "
                   f"FROM {src}" for c, t in cols])


@register("column_profile", f"WITH {STUDENTS}, m AS ({_missing_sql('students', STUDENT_COLS)})\n"
                            "SELECT column_name, position, data_type, missing, missing_pct FROM m")
def q_column_profile(spark, sf_dir):
    return finish(profile.column_profile(students(spark, sf_dir)))


@register("quality_report", f"WITH {STUDENTS}, m AS ({_missing_sql('students', STUDENT_COLS)}),\n"
                            f"d AS ({_distinct_sql('students', STUDENT_COLS)})\n"
                            "SELECT m.column_name, position, data_type, missing, missing_pct, distinct_n AS unique_values "
                            "FROM m JOIN d ON m.column_name = d.column_name")
def q_quality_report(spark, sf_dir):
    return finish(profile.quality_report(students(spark, sf_dir)))


@register("completeness", f"WITH {STUDENTS}, m AS ({_missing_sql('students', STUDENT_COLS)})\n"
                          f"SELECT CAST(max(non_null + missing) AS BIGINT) AS row_count, CAST({len(STUDENT_COLS)} AS BIGINT) AS column_count, "
                          "CAST(sum(missing) AS BIGINT) AS total_missing, "
                          f"CAST({sum(1 for _, t in STUDENT_COLS if t in NUMERIC)} AS BIGINT) AS numeric_columns, "
                          f"CAST({sum(1 for _, t in STUDENT_COLS if t not in NUMERIC)} AS BIGINT) AS non_numeric_columns, "
                          f"round(100.0 - sum(missing) * 100.0 / (max(non_null + missing) * {len(STUDENT_COLS)}), 6) AS completeness_pct FROM m")
def q_completeness(spark, sf_dir):
    return finish(profile.completeness(students(spark, sf_dir)))


def _describe_sql(src, cols):
    parts = []
    for c, t in cols:
        if t in NUMERIC:
            x = f"CAST({c} AS DOUBLE)"
            parts.append(
                f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, CAST(NULL AS BIGINT) AS \"unique\", "
                f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, round(avg({x}), 6) AS mean, "
                f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
                f"round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50, "
                f"round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM {src}")
        else:
            v = _vtext(c, t)
            parts.append(
                f"SELECT '{c}' AS column_name, CAST(sum(cnt) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS \"unique\", "
                f"arg_min(v, (-cnt, v)) AS top, CAST(max(cnt) AS BIGINT) AS freq, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, "
                f"NULL::DOUBLE AS min, NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, NULL::DOUBLE AS p75, NULL::DOUBLE AS max "
                f"FROM (SELECT {v} AS v, count(*) AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY 1) x")
    return _union(parts)


@register("describe_all", f"WITH {STUDENTS}\n{_describe_sql('students', STUDENT_COLS)}")
def q_describe_all(spark, sf_dir):
    return finish(profile.describe_all(students(spark, sf_dir)))


def _seq_sql(src, cols):
    parts = []
    for c, t in cols:
        if t not in NUMERIC:
            continue
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, coalesce(count({c}) >= 3 AND count_if({x} % 1 <> 0) = 0 "
            f"AND max({x}) - min({x}) + 1 = count(DISTINCT {_vtext(c, t)}) "
            f"AND count(DISTINCT {_vtext(c, t)}) >= greatest(3, count({c}) - 1), false) AS sequential FROM {src}")
    return _union(parts)


@register("sequential_ids", f"WITH {STUDENTS}\n{_seq_sql('students', STUDENT_COLS)}")
def q_sequential_ids(spark, sf_dir):
    return profile.sequential_ids(students(spark, sf_dir))


def _ratio_sql(src, cols):
    return _union([f"SELECT '{c}' AS column_name, CASE WHEN count({c}) > 0 THEN "
                   f"count(DISTINCT {_vtext(c, t)}) / count({c}) ELSE 0.0 END AS unique_ratio FROM {src}"
                   for c, t in cols])


@register("unique_ratio", f"WITH {STUDENTS}, r AS ({_ratio_sql('students', STUDENT_COLS)})\n"
                          "SELECT column_name, round(unique_ratio, 6) AS unique_ratio FROM r")
def q_unique_ratio(spark, sf_dir):
    return finish(profile.unique_ratio(students(spark, sf_dir)))


def _identifier_sql(src, cols):
    parts = []
    for i, (c, t) in enumerate(cols):
        reason = profile._name_reason(c)
        x = f"CAST({c} AS DOUBLE)"
        ratio = f"(CASE WHEN count({c}) > 0 THEN count(DISTINCT {_vtext(c, t)}) / count({c}) ELSE 0.0 END)"
        if t in NUMERIC:
            seq = (f"(count({c}) >= 3 AND count_if({x} % 1 <> 0) = 0 AND max({x}) - min({x}) + 1 = "
                   f"count(DISTINCT {_vtext(c, t)}) AND count(DISTINCT {_vtext(c, t)}) >= greatest(3, count({c}) - 1))")
            data_rule = f"WHEN {ratio} >= 0.9 AND coalesce({seq}, false) THEN 'sequence'"
        elif t == "string":
            data_rule = f"WHEN {ratio} >= 0.9 THEN 'near-unique text'"
        else:
            data_rule = ""
        name_rule = f"WHEN true THEN '{reason}'" if reason else ""
        expr = f"CASE {name_rule} {data_rule} END" if (name_rule or data_rule) else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT '{c}' AS column_name, {i} AS position, ({expr}) IS NOT NULL AS is_identifier, "
                     f"{expr} AS reason FROM {src}")
    return _union(parts)


@register("identifier_columns", _identifier_sql("customer", CUSTOMER_COLS))
def q_identifier_columns(spark, sf_dir):
    return finish(profile.identifier_columns(table(spark, sf_dir, "customer")))


@register("high_cardinality", _union([
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct, count(DISTINCT {c}) > 30 AS high_cardinality FROM part"
    for c in ["p_name", "p_brand", "p_type"]]))
def q_high_cardinality(spark, sf_dir):
    return profile.high_cardinality(table(spark, sf_dir, "part"))


def _plan_sql():
    # part: p_partkey sequence id; p_name above the cut; p_brand (25) and p_type categorical; others numeric.
    cols = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
            ("p_size", "int"), ("p_retailprice", "double")]
    ident = _identifier_sql("part", cols)
    card = _union([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) > 30 AS hc FROM part"
                   for c, t in cols if t == "string"])
    kinds = _union([f"SELECT '{c}' AS column_name, '{'numeric' if t in NUMERIC else 'categorical'}' AS kind"
                    for c, t in cols])
    return (f"WITH i AS ({ident}), h AS ({card}), k AS ({kinds})\n"
            "SELECT i.column_name, position, CASE WHEN is_identifier THEN 'identifier' WHEN kind = 'numeric' THEN 'numeric' "
            "WHEN kind = 'categorical' AND hc THEN 'high_cardinality' WHEN kind = 'categorical' THEN 'categorical' "
            "ELSE 'unused' END AS grp, reason FROM i JOIN k ON i.column_name = k.column_name "
            "LEFT JOIN h ON i.column_name = h.column_name")


@register("column_plan", _plan_sql())
def q_column_plan(spark, sf_dir):
    return finish(profile.column_plan(table(spark, sf_dir, "part")))


def _fingerprint_sql():
    cols = STUDENT_COLS
    text = " || '|' || ".join(f"coalesce({_vtext(c, t)}, '\\N')" for c, t in cols)
    return (f"WITH {STUDENTS}, h AS (SELECT md5({text}) AS h FROM students)\n"
            "SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(" + str(len(cols)) + " AS BIGINT) AS column_count, "
            "coalesce(bit_xor(('0x' || substr(h, 1, 15))::BIGINT), 0) AS xor_hash, "
            "CAST(coalesce(sum(('0x' || substr(h, 17, 8))::BIGINT), 0) AS VARCHAR) AS sum_hash FROM h")


@register("fingerprint", _fingerprint_sql())
def q_fingerprint(spark, sf_dir):
    return profile.fingerprint(students(spark, sf_dir))
