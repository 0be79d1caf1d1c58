"""The registered queries of this subpackage: each applies its operator to the whole table with production
parameters and derives the result columns that its contract names."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.llm import (bpe_tree, decontaminate, importance_resampling, language_mixture, ngram_join, periodic_runs, pii_boost,
                        quality_ledger, retrieval_packing, shard_matrix, token_counts, token_files, url_templates)
from cohort.llm.common import bounded_batches, scratch, table


def _flat(lists: pa.Array) -> tuple[np.ndarray, list[int]]:
    """(flat values, offsets) of an Arrow list column."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    off = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), off.tolist()


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:least(i + 4, len(ws))], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
"""


def op2_shard_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_matrix.assign_shards(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = pii_boost.find_spans(docs, pii_boost.fit(docs), keep=["doc_id"])
    return rows.select("doc_id", *pii_boost.counted(F.col("base")), F.sha2(pii_boost.listed(F.col("base")), 256).alias("base_sha256"), pii_boost.listed(F.col("spans")).alias("spans"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "n_bytes"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_ledger.ledger(quality_ledger.measure(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    base = ~quality_ledger.passes("base")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                          (~base & quality_ledger.passes("v1")).alias("kept"), "failed", F.lit("v1").alias("policy"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i AS p FROM rep UNION ALL SELECT doc_id, i + 1 FROM rep
        UNION ALL SELECT doc_id, i + 2 FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_alpha_words,
        length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g'))::BIGINT AS n_lower,
        len(list_filter(ls, lambda x: x[1] = '-' OR x[1] = '*'))::BIGINT AS n_bullet_lines,
        len(list_filter(ls, lambda x: ends_with(x, '...')))::BIGINT AS n_ellipsis_lines
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN n_words > 100000 THEN 4 ELSE 0 END + CASE WHEN word_chars < 3 * n_words THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 10 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 32 ELSE 0 END
        + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 64 ELSE 0 END + CASE WHEN 10 * n_alpha_words < 8 * n_words THEN 128 ELSE 0 END
        + CASE WHEN 2 * n_upper > n_upper + n_lower THEN 256 ELSE 0 END + CASE WHEN 10 * n_bullet_lines > 9 * n_lines THEN 512 ELSE 0 END
        + CASE WHEN 10 * n_ellipsis_lines > 3 * n_lines THEN 1024 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept,
       failed, 'v1' AS policy FROM f
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    bounded_batches(spark)
    rows = token_files.with_start(spark, path).select("doc_id", "start", "n_tokens", "tokens")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:3])

    def run(batches):
        for b in batches:
            ids, off = _flat(b.column(3))
            crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=[*b.schema.names[:3], "ids_crc32"])

    return rows.mapInArrow(run, f"{kept}, ids_crc32 long")


def op8_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe_tree.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])
    decoded = bpe_tree.decode(ids, path, keep=["doc_id"])

    def run(batches):
        for b in batches:
            flat, off = _flat(b.column(1))
            sha = [hashlib.sha256(flat[x:y].tobytes()).hexdigest() for x, y in zip(off, off[1:])]
            back = [hashlib.sha256(x).hexdigest() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off).astype(np.int64)), pa.array(sha), pa.array(back)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return decoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _remainder() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3))


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _remainder() == 1)
    model = language_mixture.train(docs.where("NOT held_out"))
    found = language_mixture.predict(docs, model, keep=["doc_id", "held_out"])
    langs = F.array_join(F.transform("langs", lambda x: F.concat_ws(":", x["lang"], F.format_number(x["share"], 3))), ",")
    return found.select("doc_id", "held_out", "lang_pred", "score", langs.alias("langs"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


def planted_period(key: int, words: list[bytes]) -> list[bytes]:
    """The words with the contract's periodic tail: one document in ten repeats a stretch from some word on."""
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)

    def run(batches):  # a row without a key keeps its text
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            text = [t if k is None or t is None or zlib.crc32(str(k).encode()) % 10 else b" ".join(planted_period(k, t.encode().split())).decode() for k, t in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
    rows = periodic_runs.periodic_runs(docs, keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = rows.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.shorter")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), length.alias("length"),
                       period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = retrieval_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - row_number() OVER (), text FROM benchmark)),
g AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
h AS (SELECT f, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS bytes
      FROM (SELECT DISTINCT f FROM g)),
b AS (SELECT f, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
      FROM h, tab),
x AS (SELECT doc_id, bucket, count(*) AS c FROM g JOIN b USING (f) GROUP BY ALL),
n AS (SELECT bucket, sum(CASE WHEN doc_id >= 0 THEN c ELSE 0 END) AS s, sum(CASE WHEN doc_id < 0 THEN c ELSE 0 END) AS t FROM x GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
m AS (SELECT doc_id, sum(c)::BIGINT AS n_features, floor(sum(gain * c)::DOUBLE / sum(c)::DOUBLE)::BIGINT AS weight FROM x JOIN gain USING (bucket)
      WHERE doc_id >= 0 GROUP BY doc_id),
r AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM w LEFT JOIN m ON w.doc_id = m.doc_id WHERE w.doc_id >= 0),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM r WHERE n_words >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM r LEFT JOIN p ON r.doc_id = p.doc_id
"""


QUERIES = {f.__name__: f for f in (
    op1_ngram_join, op2_shard_matrix, op3_decontaminate, op4_pii_boost, op9_language_mixture, op10_url_templates, op5_token_counts, op6_quality_ledger,
    op7_token_files, op8_bpe_tree, op11_periodic_runs, op12_retrieval_packing, op13_importance_resampling)}
ORACLES = {"op1_ngram_join": OP1_SQL, "op6_quality_ledger": OP6_SQL, "op13_importance_resampling": OP13_SQL}
