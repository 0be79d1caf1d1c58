"""Language mixtures (held-out accuracy, mixed texts) and the quality ledger (against SQL)."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from cohort.llm import language_mixture as lm
from cohort.llm import quality_ledger as ql
from cohort.llm import queries
from llm_cases import ODD_TEXTS, SF


def test_held_out_accuracy(spark):
    found = queries.op9_language_mixture(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.count() > 40
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert found.where("score < 0 OR score > 1").count() == 0


def test_mixture_finds_both_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm.train(docs)
    text = {r.lang: r.t for r in docs.groupBy("lang").agg(F.max_by("text", F.when(F.col("n_chars") < 4000, F.col("n_chars"))).alias("t")).collect()}
    both = text["de"][:900] + " " + text["fr"][:600]
    (gram,) = lm.trigrams(pa.array([both]))
    found = model.mixture(gram)
    assert [x for x, _ in found][:2] == ["de", "fr"] and 0.45 < found[0][1] < 0.75
    (gram,) = lm.trigrams(pa.array([text["es"][:600]]))
    assert [x for x, _ in model.mixture(gram)] == ["es"]


def test_language_edge_cases(spark, odd, empty):
    model = lm.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {i: r for i, r in zip(range(99), lm.predict(odd, model, keep=["doc_id"]).collect())}
    by_text = dict(zip(range(99), ODD_TEXTS))
    for i, t in by_text.items():
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert lm.predict(empty, model, keep=["doc_id"]).count() == 0
    none = lm.train(empty)
    assert none.langs == [] and {r.lang_pred for r in lm.predict(odd, none).collect()} == {"und"}
    kept = lm.filter_languages(spark.read.parquet(f"{SF}/documents.parquet"), model)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() >= 0.99 * 200


def test_ledger_equals_sql(spark):
    got = sorted(tuple(r) for r in queries.op6_quality_ledger(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.sql(queries.OP6_SQL).fetchall())


def test_ledger_edge_cases_equal_sql(spark, odd, empty):
    rows = [(i, t) for i, t in enumerate([*ODD_TEXTS, "- a\n- b\n- c", "x...\ny...\nz", "a b c a b c a", "l\nl\nl\nl\n \nl", "one two three four"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ql.ledger(ql.measure(df, keep=["doc_id"])).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows if "\x00" not in (r[1] or "")])
    want = con.sql(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed FROM ({queries.OP6_SQL})").fetchall()
    got = {r.doc_id: tuple(r) for r in got.collect()}
    assert all(got[w[0]] == w for w in want)
    assert ql.ledger(ql.measure(empty, keep=["doc_id"])).count() == 0


def test_policies_and_ablation(spark):
    entries = ql.ledger(ql.measure(spark.read.parquet(f"{SF}/documents.parquet"), keep=["doc_id"]))
    bits = [r.failed for r in entries.collect()]
    held = [b & ql.mask(ql.POLICIES["v1"]) for b in bits]
    for r in ql.ablation(entries, "v1").collect():
        assert r.n_failed == sum(b >> r.bit & 1 for b in held) and r.n_only == sum(b == 1 << r.bit for b in held)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = queries.op6_quality_ledger(spark, SF).join(labels, "doc_id").where("NOT base_failed")
    assert judged.where("quality = 1 AND NOT kept").count() <= 1 and judged.where("quality = 0 AND kept").count() <= 1
