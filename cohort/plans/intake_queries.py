"""Catalog entries: delimited intake (files written from the fixture by Spark), text tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohort.session import scratch_path
from cohort.sources import delimited
from cohort.plans.common import register, finish, STUDENTS
from cohort.sources.fixtures import students, table

ALL = ["student_id", "programme", "support_band", "tutor_ref", "studytime", "absences", "failures", "g1", "g2", "g3",
       "result", "recorded_at"]


def _write_csv(spark, sf_dir, sep):
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    df = students(spark, sf_dir).withColumn("recorded_at", F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss"))
    (df.write.option("header", True).option("sep", sep).option("nullValue", "NA")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


SQL_TYPED = (f"WITH {STUDENTS}\nSELECT student_id, programme, support_band, CAST(tutor_ref AS BIGINT) AS tutor_ref, studytime, absences, failures, "
             "g1, g2, g3, result, strftime(recorded_at, '%Y-%m-%d %H:%M:%S') AS recorded_at FROM students")


@register("read_delimited", SQL_TYPED)
def q_read_delimited(spark, sf_dir):
    path = _write_csv(spark, sf_dir, ";")
    return finish(delimited.read_delimited(spark, path))


@register("infer_types", SQL_TYPED)
def q_infer_types(spark, sf_dir):
    path = _write_csv(spark, sf_dir, "|")
    raw = delimited.read_delimited(spark, path, infer=False)
    return finish(delimited.infer_types(raw))


@register("union_tables", f"WITH {STUDENTS}\nSELECT student_id, programme, NULL::DOUBLE AS g1 FROM students WHERE student_id % 2 = 0 "
                          "UNION ALL SELECT student_id, NULL AS programme, g1 FROM students WHERE student_id % 2 = 1")
def q_union_tables(spark, sf_dir):
    s = students(spark, sf_dir)
    a = s.where(F.col("student_id") % 2 == 0).select("student_id", "programme")
    b = s.where(F.col("student_id") % 2 == 1).select("student_id", "g1")
    return delimited.union_tables([a, b])


def _text_tables_sql() -> str:
    """The same extraction by list functions: hide separators within quotes, split, check widths, name columns."""
    def cells(sep):
        hidden = f"array_to_string(list_transform(string_split(line, '\"'), lambda s, i: CASE WHEN i % 2 = 0 THEN replace(s, {sep}, chr(1)) ELSE s END), '\"')"
        safe = f"CASE WHEN len(string_split(line, '\"')) % 2 = 1 THEN {hidden} ELSE line END"
        plain = f"replace(trim(c, ' '), chr(1), {sep})"
        return (f"list_transform(string_split({safe}, {sep}), lambda c: CASE WHEN length({plain}) >= 2 AND {plain}[1] = '\"' AND {plain}[-1] = '\"' "
                f"THEN replace(substr({plain}, 2, length({plain}) - 2), '\"\"', '\"') ELSE {plain} END)")

    seps = ["'|'", "chr(9)", "','", "';'"]
    rows = " UNION ALL ".join(f"SELECT doc_id, no, {k} AS k, {cells(s)} AS cells FROM l WHERE contains(line, {s})" for k, s in enumerate(seps))
    return f"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS no, trim(unnest(ls), ' ') AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
r AS ({rows}),
h AS (SELECT doc_id, k, count(*) AS n, arg_min(cells, no) AS head, min(no) AS first, max(len(cells)) AS widest FROM r GROUP BY doc_id, k),
c AS (SELECT doc_id, min(k) AS k FROM h WHERE n >= 2 AND len(head) >= 2 AND widest <= len(head) GROUP BY doc_id),
t AS (SELECT h.doc_id, h.k, first, list_transform(head, lambda x, i: CASE WHEN x = '' THEN 'column_' || i ELSE x END) AS base FROM h JOIN c ON h.doc_id = c.doc_id AND h.k = c.k),
nm AS (SELECT *, list_transform(base, lambda x, i: CASE WHEN len(list_filter(base[1:i], lambda y: y = x)) > 1
        THEN x || '_' || len(list_filter(base[1:i], lambda y: y = x)) ELSE x END) AS names FROM t),
e AS (SELECT r.doc_id, r.no, names, cells, unnest(range(1, len(cells) + 1)) AS i FROM r JOIN nm ON r.doc_id = nm.doc_id AND r.k = nm.k AND r.no > nm.first)
SELECT doc_id, CAST(no AS INTEGER) AS row_no, names[i] AS column_name, nullif(cells[i], '') AS value FROM e"""


@register("extract_text_tables", _text_tables_sql())
def q_extract_text_tables(spark, sf_dir):
    return delimited.extract_text_tables(table(spark, sf_dir, "documents"))
