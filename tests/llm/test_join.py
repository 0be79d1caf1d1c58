"""The n-gram Jaccard join against brute force on real texts, near copies and edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cohort.llm import ngram_join, queries
from llm_cases import ODD_TEXTS, SF


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 5 >= max(len(sets[a]), len(sets[b])) * 4:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    parent[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = k if least[r] is None else min(least[r], k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


@pytest.fixture(scope="module")
def rows(documents):
    rnd = random.Random(5)
    out = list(documents)
    base = documents[10][1].split()
    for i in range(120):  # near copies around the threshold of one another
        w = list(base)
        for _ in range(rnd.randint(1, max(2, len(base) // 30))):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        out.append((10_000 + i, " ".join(w)))
    out += [(20_000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    five = "one two three four five six seven eight nine".split()
    out += [(30_000, " ".join(five)), (30_001, " ".join(five[:-1])), (30_002, " ".join(five[:-2])), (30_003, "one two"), (30_004, "ONE\ttwo")]
    return out


def test_components_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(k, t, 1, "c") for k, t in rows], "doc_id long, text string, component_id int, cls string").repartition(5)
    got = ngram_join.jaccard_components(df)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_blocks_of_long_lists_lose_no_link(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "COLUMNS", 64)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(df)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_required_matches_stay_within_the_set():
    for n in range(1, 200):
        for shape in (np.zeros(n), np.ones(n), np.linspace(0, 500, n)):
            l = ngram_join.choose_matches(shape + 0.05, n)
            assert 1 <= l <= ngram_join.needed(n) and n - ngram_join.needed(n) + l <= n


def test_keep_one(spark, rows):
    df = spark.createDataFrame([*rows, rows[0], (None, "only here null"), (None, "only here null")], "doc_id long, text string")
    want = sorted(k for k, _, c in brute(rows) if k == c)
    kept = [r.doc_id for r in ngram_join.keep_one(df).collect()]
    assert sorted(k for k in kept if k is not None) == want
    assert kept.count(None) == 1


def test_keep_one_tells_rows_with_one_key_apart(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, "another text that shares its key with the first"), (2, base + " more"), (3, " "), (3, None), (1, base)]
    kept = sorted((r.doc_id, r.text or "") for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [(1, "another text that shares its key with the first"), (1, base), (3, ""), (3, " ")]


def test_empty_and_null_tables(spark, empty):
    assert ngram_join.jaccard_components(empty).count() == 0
    assert ngram_join.keep_one(empty).columns == empty.columns
    nulls = spark.createDataFrame([(None, None), (None, "a b c"), (1, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.jaccard_components(nulls).collect()) == [
        ("1", 0, "1"), ("None", 0, "None"), ("None", 1, "None")]


def test_query_equals_brute_force(spark, documents):
    got = sorted(tuple(r) for r in queries.op1_ngram_join(spark, SF).collect())
    assert got == brute(documents)


def test_signatures_never_refute_a_link():
    rnd = random.Random(2)
    refuted = 0
    for _ in range(3_000):
        n = rnd.choice([1, 3, 20, 60, 130, 400])
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = set(rnd.sample(sorted(a), max(1, int(n * rnd.choice([0.5, 0.7, 0.9, 1.0]))))) | {rnd.getrandbits(64) for _ in range(rnd.randint(0, n // 3))}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        link = 5 * len(a & b) >= 4 * len(a | b)
        may = ngram_join.may_link(ngram_join.signature(x), ngram_join.signature(y))
        assert may or not link
        refuted += not may
    assert refuted > 1_000
    assert ngram_join.signature(np.zeros(300, np.uint64)) is None and ngram_join.may_link(None, b"x")


def test_members_of_blocks_that_may_join_are_kept():
    rnd = random.Random(8)
    for _ in range(30):
        base = [rnd.getrandbits(64) for _ in range(rnd.choice([30, 70]))]
        sets = [np.array(sorted({*rnd.sample(base, rnd.randint(len(base) // 2, len(base))), *[rnd.getrandbits(64) for _ in range(rnd.randint(0, 6))]}), np.uint64) for _ in range(20)]
        comps = [bytes([rnd.randrange(4)]) for _ in sets]
        sigs = [None if i == 3 else ngram_join.signature(s) for i, s in enumerate(sets)]
        for first, second in ((np.arange(20), np.arange(20)), (np.arange(8), np.arange(8, 20))):
            want = {k for i in first for j in second if comps[i] != comps[j] and ngram_join.may_link(sigs[i], sigs[j]) for k in (i, j)}
            assert set(ngram_join.may_join(sigs, comps, first, second).tolist()) == want
