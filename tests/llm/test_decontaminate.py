"""Decontamination: exact and edited passages are caught, other documents stay; blocks agree."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cohort.llm import decontaminate as dc
from cohort.llm import queries
from llm_cases import ODD_TEXTS, SF


def brute_align(item, part):
    """Plain Smith-Waterman score."""
    h = [[0.0] * (len(part) + 1) for _ in range(len(item) + 1)]
    best = 0.0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(part, 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + (dc.MATCH if a == b else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_scores_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 20)).astype(np.uint64)
        score, same, first, end = dc.align(a, b)
        assert score == brute_align(a.tolist(), b.tolist()) and 0 <= first <= end <= len(b) and same <= min(len(a), end - first)


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def edited(rnd, words, rate, voc):
    out = []
    for w in words:
        r = rnd.random()
        if r < rate / 3:
            continue
        out += [rnd.choice(voc)] if r < rate * 2 / 3 else [w, rnd.choice(voc)] if r < rate else [w]
    return out


def test_leaks_are_caught_and_clean_documents_stay(spark, items, documents):
    rnd = random.Random(2)
    passages = {r.item_id: r.text for r in items.collect()}
    clean = [(k, t) for k, t in documents if not any(p in t for p in passages.values())]
    voc = [w for _, t in clean[:60] for w in t.split()]
    planted = []
    for i, (item, p) in enumerate(passages.items()):
        for j, rate in enumerate((0.0, 0.15, 0.3)):
            body = clean[(i + j) % 40][1]
            planted.append((100_000 + 10 * item + j, f"{body} {' '.join(edited(rnd, p.split(), rate, voc)).upper() if j == 0 else ' '.join(edited(rnd, p.split(), rate, voc))} {body}"))
    df = spark.createDataFrame([*clean, *planted], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(df, items).collect()}
    assert {(100_000 + 10 * i + j, i) for i in passages for j in range(2)} <= found
    assert sum((100_000 + 10 * i + 2, i) in found for i in passages) >= 0.95 * len(passages)
    assert not {k for k, _ in clean} & {k for k, _ in found}
    kept = {r.doc_id for r in dc.drop_contaminated(df, items).collect()}
    assert kept == {k for k, _ in [*clean, *planted]} - {k for k, _ in found}


def test_blocks_agree(spark, items, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted((r.doc_id, r.item_id, r.n_same) for r in dc.contaminated(docs, items).collect())
    monkeypatch.setattr(dc, "BLOCK_BYTES", 2_000)
    assert sorted((r.doc_id, r.item_id, r.n_same) for r in dc.contaminated(docs, items).collect()) == one


def test_query_finds_every_exact_passage(spark, items, documents):
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontaminate(spark, SF).collect()}
    want = {(k, r.item_id) for r in items.collect() for k, t in documents if r.text in t}
    assert want and want <= got and len(got) <= len(want) + 1


def test_edge_cases(spark, odd, empty, items):
    assert dc.contaminated(empty, items).count() == 0 and dc.contaminated(odd, items.limit(0)).count() == 0
    assert dc.drop_contaminated(odd, items).count() == len(ODD_TEXTS)
    short = spark.createDataFrame([(1, "same text"), (2, None), (3, ""), (4, "..."), (5, "nowhere")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(odd, short).collect()) == [(15, 1), (16, 1)]
    kept = dc.drop_contaminated(odd, short)
    assert kept.columns == odd.columns and kept.count() == len(ODD_TEXTS) - 2


def test_a_leak_in_most_documents_keeps_its_seeds(spark):
    passage = "the quick brown fox jumps over the lazy dog near the old river bank at dawn"
    docs = spark.createDataFrame([(i, f"w{i} x{i} {passage} y{i}") for i in range(300)] + [(900, "the quick brown bird")], "doc_id long, text string")
    item = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(r.doc_id for r in dc.contaminated(docs, item).collect()) == list(range(300))


@pytest.mark.parametrize("version", [lambda ws, c: [f"other{i}" if i % 4 == 3 else x for i, x in enumerate(ws)], lambda ws, c: ws[:20]])
def test_an_edited_leak_is_caught_however_often_it_stands(spark, version):
    """Under half of the 3-grams are intact; the copies themselves make those common."""
    items, docs = [], []
    for item, copies in enumerate((1, 9, 1_000)):
        ws = [f"i{item}w{j}" for j in range(40)]
        part = version(ws, copies)
        grams = {tuple(ws[j: j + 3]) for j in range(38)}
        assert 2 * sum(tuple(part[j: j + 3]) in grams for j in range(len(part) - 2)) < len(grams) and 2 * len(set(part) & set(ws)) >= 40
        items.append((item, " ".join(ws)))
        docs += [(10_000 * item + i, f"before {i} b{i} {' '.join(part)} after {i} a{i}") for i in range(copies)]
    clean = [(90_000 + i, f"i0w0 i0w1 i0w2 other {i} words") for i in range(50)]
    df, bench = spark.createDataFrame([*docs, *clean], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect()) == sorted((k, k // 10_000) for k, _ in docs)
    assert sorted(r.doc_id for r in dc.drop_contaminated(df, bench).collect()) == sorted(k for k, _ in clean)


def test_a_verbatim_passage_of_a_long_item_is_caught(spark):
    ws = {1: [f"a{j}" for j in range(1_000)], 2: [f"b{j}" for j in range(59)]}
    parts = [ws[1][300:700], ws[2][20:45], ws[1][:dc.RUN], ws[2][-dc.RUN:], ws[1][5:4 + dc.RUN], ws[2][:6] + ["x"] + ws[2][7:13]]
    docs = spark.createDataFrame([(i, " ".join(p if i in (2, 4) else ["before", *p, "after"])) for i, p in enumerate(parts)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(x)) for k, x in ws.items()], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_same) for r in dc.contaminated(docs, items).collect())
    assert got == [(0, 1, 400), (1, 2, 25), (2, 1, dc.RUN), (3, 2, dc.RUN)]


def test_short_array_of_items():
    block = dc.Block.of([7], pa.array(["one two"]))
    assert dc.align_hits(block, dc.BareWords(pa.array(["zero one two three", "one", "two one"]))) == [(0, 0, 4.0, 2, 1, 3)]


def test_results_equal_alignment_of_every_item_with_every_whole_text(spark, items, documents):
    """Brute force: no seeds and no windows."""
    rnd = random.Random(12)
    passages = [(r.item_id, r.text) for r in items.collect()][:12]
    voc = [w for _, t in documents[:30] for w in t.split()]
    rows = [(k, t) for k, t in documents[:60] if len(t.split()) < 400]
    for i, (item, p) in enumerate(passages):
        for j, rate in enumerate((0.0, 0.2)):
            rows.append((10_000 + 10 * i + j, " ".join([*voc[i * 20:i * 20 + 60], *edited(rnd, p.split(), rate, voc), *voc[i * 30:i * 30 + 40]])))
    want = set()
    for item, p in passages:
        a = dc.BareWords(pa.array([p])).hash
        for k, t in rows:
            b = dc.BareWords(pa.array([t])).hash
            same = dc.align(a, b)[1]
            run = any(dc.has_run(a, b[max(s, 0):s + len(a)], max(-s, 0)) for s in range(-len(a) + 1, len(b)) if len(b[max(s, 0):s + len(a)]))
            if len(b) and (run or dc.is_contaminated(same, len(a))):
                want.add((k, item))
    got = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) >= 24


def test_phrases_of_many_items_seed_in_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    phrase = "which of the following statements about the passage above is the one that fits best"
    made = [(i, f"{phrase} {' '.join(f'w{rnd.randrange(40)}' for _ in range(6))}") for i in range(300)] + [(1_000 + i, phrase) for i in range(3)]
    docs = [(1, f"some words before {made[7][1]} and after"), (2, "a quiet text about nothing of the kind at all"), (3, f"x {phrase} y"),
            (4, " ".join(w if i % 7 else "zz" for i, w in enumerate(made[9][1].split())))]
    df, its = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(made, "item_id long, text string")
    block, _ = next(dc.blocks(its, "item_id", "text"))
    assert len(block.common) > 5 and max(map(len, block.ids)) == 3
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(df, its).collect()}
    monkeypatch.setattr(dc, "MOST_OWNERS", 10**9)  # every n-gram seeds by itself
    assert found == {(r.doc_id, r.item_id) for r in dc.contaminated(df, its).collect()}
    assert {(1, 7), (3, 1_000), (3, 1_001), (3, 1_002), (4, 9)} <= found and not any(d == 2 for d, _ in found)


def test_long_items_align_in_bounded_memory():
    import tracemalloc
    rng = np.random.default_rng(1)
    item = rng.integers(0, 1 << 40, 20_000).astype(np.uint64)
    part = np.concatenate((rng.integers(0, 1 << 40, 3_000), item[4_000:16_000], rng.integers(0, 1 << 40, 3_000))).astype(np.uint64)
    tracemalloc.start()
    score, same, first, end = dc.align(item, part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (score, same, first, end) == (24_000.0, 12_000, 3_000, 15_000) and peak < 120 << 20


def test_blocks_are_written_one_by_one(spark, items, documents, monkeypatch):
    df = spark.createDataFrame(documents[:80], "doc_id long, text string")
    whole = {tuple(r) for r in dc.contaminated(df, items).collect()}, {r.doc_id for r in dc.drop_contaminated(df, items).collect()}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1 << 9)
    assert whole == ({tuple(r) for r in dc.contaminated(df, items).collect()}, {r.doc_id for r in dc.drop_contaminated(df, items).collect()})
