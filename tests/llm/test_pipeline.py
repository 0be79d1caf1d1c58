"""The pipeline, stage by stage, on the smallest table."""

import re

import public_tokenizers as P
import pytest

import corpus_pipeline
from cohort.llm import bpe_tree, decontaminate, ngram_join
from cohort.llm.common import written
from llm_cases import SF, base


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_stages_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "encoding"]
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    counts = [df.count() for df in stages]
    assert counts == sorted(counts, reverse=True) and counts[1] >= 0.99 * counts[0] and counts[-1] > 0.7 * counts[0]


def test_each_stage_does_its_work(spark, stages):
    comps = ngram_join.jaccard_components(stages[1]).collect()
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({r.component_id for r in comps})
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contaminated(stages[2], items).collect()}
    assert bad and {r.doc_id for r in stages[3].collect()} == {r.doc_id for r in stages[2].collect()} - bad
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[3:5])
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert base(r.text) == [] and r.n_chars == len(r.text)
        if not base(before[k].text):
            assert re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "", r.text) == r.text or r.text == before[k].text
    ranks = bpe_tree.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    token = {v: k for k, v in ranks.items()}
    for r in stages[5].collect():
        assert r.text == after[r.doc_id].text and b"".join(token[i] for i in r.ids).decode() == r.text and r.n_tokens == len(r.ids)


def test_odd_and_empty_tables(spark, odd, empty):
    plain = odd.selectExpr("doc_id", "text", "'fr' AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars", "n_tokens", "ids")
    for docs in (plain, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), f"odd-{name}")
        assert docs.columns == ["doc_id", "n_tokens", "ids", "text"]
