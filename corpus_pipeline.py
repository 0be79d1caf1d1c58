"""A training-data pipeline over ``documents``: language filter, near-duplicate removal, benchmark
decontamination, redaction of personal data, byte-level BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame that ``run`` writes as Parquet and reads again as
the next stage's ``docs``.  All but the last return the columns of ``documents``.

* ``language``: drops documents without a recognised main language.  The model learns from the rows of
  ``docs`` whose language is given; where none is, every document stays.
* ``near_duplicates``: of each group of linked documents the one with the smallest doc_id stays.
* ``decontamination``: drops documents that hold an exact or edited copy of a ``benchmark`` item.
* ``personal_data``: replaces found spans by their kind in brackets; ``n_chars`` follows the new text.
* ``encoding``: token ids of each text, their number, and the text that they decode to.

Null and empty texts: the language stage drops them (no letter).  Repeated rows: one stays.  Rows that share a doc_id but
not a text are judged by their own text.  Very long texts go through every stage whole.  Extra columns are carried to the
last stage, which returns its own columns; names that start with two underscores are the stages' own.  An empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.llm import bpe_tree, decontaminate, language_mixture, ngram_join, pii_boost
from cohort.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_mixture.filter_languages(docs, language_mixture.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "text")
    rows = pii_boost.find_spans(packed, pii_boost.fit(docs), keep=["__row"])
    clean = rows.withColumn("__clean", pii_boost.redacted(F.col("text"), F.col("spans")))
    held = {"text": F.col("__clean"), "n_chars": F.length("__clean").cast("long")}
    return clean.select(*[held.get(c, F.col(f"__row.`{c}`") if c != "text" else None).alias(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe_tree.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])
    out = bpe_tree.decode(ids, path, keep=["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("encoding", encoding)]

#: The language model, the trained redaction and the BPE merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
