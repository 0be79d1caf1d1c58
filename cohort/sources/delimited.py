"""Delimited intake: separator sniffing, distributed CSV read, missing-token
normalisation and type inference in one aggregate pass."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort.functions.exprs import col, PLAIN_NUMBER

# ---- fixed values (missing-value tokens of the pandas CSV reader) -----------------
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                  "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SEPARATORS = [",", ";", "\t", "|"]
TEXT_TABLE_SEPARATORS = ["|", "\t", ",", ";"]
# ---------------------------------------------------------------------------
BAD_LINE = "__line"  # the raw text of rows whose field count isn't the header's
INTEGER = r"^\s*[+-]?[0-9]+\s*$"


def _outside_quotes(line: str) -> str:
    return re.sub(r'"(?:[^"]|"")*"', "", line)


def header_line(spark: SparkSession, path: str) -> str:
    """The first line that isn't blank, as it stands in the file."""
    row = spark.read.text(path).where(F.trim("value") != "").first()
    return row.value.lstrip("\ufeff") if row else ""


def sniff_separator(header: str) -> str:
    """The separator that occurs most often in the header outside quotes (ties: the order of SEPARATORS)."""
    bare = _outside_quotes(header)
    return max(SEPARATORS, key=lambda sep: (bare.count(sep), -SEPARATORS.index(sep)))


def header_names(header: str, sep: str) -> list[str]:
    """Names as written: no renaming of blank or repeated ones."""
    return next(csv.reader([header], delimiter=sep), []) if header else []


def check_header(columns: list[str]) -> None:
    if not columns:
        raise ValueError("The file has no header.")
    if any(not str(c).strip() for c in columns):
        raise ValueError("A column of the header has no name.")
    if len(set(columns)) != len(columns):
        raise ValueError("A name occurs more than once in the header.")


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, infer: bool = True, multi_line: bool = False,
                   with_rejects: bool = False):
    """Read a headed delimited file (or folder) distributed; all columns as text, then typed.

    Rows with more fields than the header are rejects: they stay out, and ``with_rejects`` returns them as a
    second frame (``line``).  Shorter rows are filled with nulls.  ``multi_line`` reads quoted line breaks;
    each file is then one task, so it is off unless asked for.
    """
    header = header_line(spark, path)
    sep = sep or sniff_separator(header)
    names = header_names(header, sep)
    check_header(names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BAD_LINE]])
    raw = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep).option("quote", '"')
           .option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE).csv(path))
    fields = F.size(F.split(F.regexp_replace(F.col(BAD_LINE), r'"(?:[^"]|"")*"', ""), re.escape(sep), -1))
    wide = F.coalesce(fields > len(names), F.lit(False))
    # the field count of a row is only checked where all its columns are read
    rows = raw.where(~wide).select(*[col(n) for n in names])
    rows = infer_types(rows) if infer else rows
    return (rows, raw.where(wide & (F.length(F.concat_ws("", *[col(n) for n in names], BAD_LINE)) > 0)).select(F.col(BAD_LINE).alias("line"))) if with_rejects else rows


def normalise_missing(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(col(c).isin(MISSING_TOKENS) | col(c).isNull(), F.lit(None).cast("string"))
                       .otherwise(col(c)).alias(c) for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast each text column to bigint / double / boolean when every value fits, else keep text.

    One aggregate counts, per column, the non-missing values and how many parse
    as each type; the casts are then a single projection.
    """
    clean = normalise_missing(df)
    aggs = []
    for i, c in enumerate(clean.columns):
        v = col(c)
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count_if(v.rlike(INTEGER) & F.trim(v).try_cast("long").isNotNull()).alias(f"i{i}"),
                 F.count_if(v.rlike(PLAIN_NUMBER)).alias(f"d{i}"),
                 F.count_if(F.trim(v).isin("True", "False", "true", "false", "TRUE", "FALSE")).alias(f"b{i}")]
    row = clean.agg(*aggs).first()
    out = []
    for i, c in enumerate(clean.columns):
        n = row[f"n{i}"]
        if n > 0 and row[f"i{i}"] == n:
            out.append(F.trim(col(c)).try_cast("long").alias(c))
        elif n > 0 and row[f"d{i}"] == n:
            out.append(F.trim(col(c)).try_cast("double").alias(c))
        elif n > 0 and row[f"b{i}"] == n:
            out.append((F.lower(F.trim(col(c))) == "true").alias(c))
        elif n == 0:
            out.append(col(c).cast("double").alias(c))  # an all-missing column reads as float NaN in pandas
        else:
            out.append(col(c))
    return clean.select(*out)


def _cells(line: Column, sep: str) -> Column:
    """Fields of a line: separators within balanced quotes don't count, surrounding quotes go."""
    parts = F.split(line, '"', -1)
    hidden = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 1, F.translate(s, sep, "\x01")).otherwise(s)), '"')
    safe = F.when(F.size(parts) % 2 == 1, hidden).otherwise(line)
    cells = F.split(safe, re.escape(sep), -1)

    def plain(c: Column) -> Column:
        t = F.translate(F.trim(c), "\x01", sep)
        quoted = t.rlike('(?s)^".*"$') & (F.length(t) >= 2)
        return F.when(quoted, F.regexp_replace(F.substring(t, 2, F.length(t) - 2), '""', '"')).otherwise(t)

    return F.transform(cells, plain)


def extract_text_tables(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Delimited tables inside free text, per document, as (doc_id, row_no, column_name, value).

    Separators are tried in order (pipe, tab, comma, semicolon); the lines that contain the separator form
    the table when there are at least two of them, the first has at least two fields and no other line is
    wider.  Fields may be quoted; an empty field is null.  A blank name becomes column_<i>, a repeated one gets
    _2, _3, ...  Everything happens within the document's row: array functions, no shuffle.
    """
    lines = F.transform(F.split(F.col(text_col), "\n", -1), lambda s, i: F.struct(i.alias("no"), F.trim(s).alias("line")))
    src = texts.select(F.col(id_col).alias("doc_id"), lines.alias("lines"))

    def table_of(sep: str) -> Column:
        held = F.filter("lines", lambda x: F.contains(x["line"], F.lit(sep)))
        return F.transform(held, lambda x: F.struct(x["no"].alias("no"), _cells(x["line"], sep).alias("cells")))

    def fits(t: Column) -> Column:
        width = F.size(F.get(t, F.lit(0))["cells"])
        return (F.size(t) >= 2) & (width >= 2) & ~F.exists(t, lambda x: F.size(x["cells"]) > width)

    for i, sep in enumerate(TEXT_TABLE_SEPARATORS):
        src = src.withColumn(f"t{i}", table_of(sep))
    chosen = F.coalesce(*[F.when(fits(F.col(f"t{i}")), F.col(f"t{i}")) for i in range(len(TEXT_TABLE_SEPARATORS))])
    src = src.select("doc_id", chosen.alias("t")).where(F.col("t").isNotNull())
    base = F.transform(F.get("t", F.lit(0))["cells"], lambda c, i: F.when(c == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(c))
    src = src.withColumn("base", base)
    nth = F.transform("base", lambda c, i: F.size(F.filter(F.slice("base", F.lit(1), i + 1), lambda d: d == c)))
    names = F.zip_with("base", nth, lambda c, k: F.when(k > 1, F.concat(c, F.lit("_"), k.cast("string"))).otherwise(c))
    src = src.withColumn("names", names)
    cells = F.transform(F.slice("t", F.lit(2), F.size("t")), lambda r: F.transform(r["cells"], lambda c, i: F.struct(
        r["no"].alias("row_no"), F.get("names", i).alias("column_name"), F.when(c != "", c).alias("value"))))
    return src.select("doc_id", F.inline(F.flatten(cells)))


def union_tables(frames: list[DataFrame]) -> DataFrame:
    acc = frames[0]
    for f in frames[1:]:
        acc = acc.unionByName(f, allowMissingColumns=True)
    return acc
