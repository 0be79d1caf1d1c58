"""Periodic runs, retrieval packing and importance resampling against brute force and the contracts' own words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohort.llm import importance_resampling, periodic_runs, queries, retrieval_packing
from llm_cases import ODD_TEXTS, SF

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


def brute_runs(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(6, 4 * q) and (s, length) not in best:
                best[s, length] = q
            i += 1
    return sorted((s, length, q) for (s, length), q in best.items())


def brute_collapsed(w, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def tailed(key, text):
    w, h = split(text), zlib.crc32(str(key).encode())
    n, g = len(w), zlib.crc32(str(key).encode()) // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_of_random_words_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(600):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            w = [rnd.randrange(rnd.randint(1, 3)) for _ in range(rnd.randint(0, 60))]
            if w and rnd.random() < 0.6:
                a, p = rnd.randrange(len(w)), rnd.randint(1, 6)
                w = [w[i] if i < a else w[min(a + (i - a) % p, len(w) - 1)] for i in range(len(w))]
            texts.append(w)
        off = np.cumsum([0, *map(len, texts)])
        got = periodic_runs.find_runs(np.array([x for t in texts for x in t], np.int64), off)
        want = [(int(o) + s, length, q) for t, o in zip(texts, off) for s, length, q in brute_runs(t)]
        assert sorted(zip(*[g.tolist() for g in got])) == sorted(want)


@pytest.mark.parametrize("tests", [1, 50])
def test_runs_do_not_depend_on_how_many_suffixes_are_tested_at_once(monkeypatch, tests):
    w = np.array([0, 1, 0, 1, 0, 1, 0, 1, 2, 2, 2, 2, 2, 2, 0, 1, 0, 1, 0, 1, 0, 1] * 5)
    want = brute_runs(w.tolist())
    monkeypatch.setattr(periodic_runs, "TESTS", tests)
    assert sorted(zip(*[g.tolist() for g in periodic_runs.find_runs(w, np.array([0, len(w)]))])) == want


def test_long_texts_are_fast():
    rnd = np.random.default_rng(0)
    for w, n in ((np.zeros(400_000, np.int64), 1), (np.arange(400_000) % 977, 1), (rnd.integers(0, 50_000, 400_000), 0)):
        assert len(periodic_runs.find_runs(w, np.array([0, len(w)]))[0]) == n


def test_runs_of_odd_rows(spark, odd, empty):
    rows = periodic_runs.periodic_runs(odd, keep=["doc_id", "ids"]).collect()
    assert len(rows) == len(ODD_TEXTS)
    for r in rows:
        w = split(ODD_TEXTS[r.ids])
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == brute_runs(w)
        assert r.collapsed == brute_collapsed(w, brute_runs(w))
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_op11_equals_brute_force(spark, documents, monkeypatch):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(documents)
    with_runs = 0
    for k, t in documents:
        w = tailed(k, t)
        runs = brute_runs(w) if len(w) < 3_000 else None
        if runs is None:
            continue
        r = got[k]
        with_runs += bool(runs)
        assert r.n_runs == len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()
    assert with_runs > 5


def ids_of(texts, end):
    tok = Tokenizer.from_file(WORD_FILE)
    return [tok.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def check_packing(pieces, docs, window=4096):
    """Each id in one piece, sequences gapless from 0 and no longer than the window; returns the sequences' lengths."""
    of, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p["doc"]].append(p)
        seqs[p["seq"]].append(p)
    assert len(of) == len(docs)
    for k, ids in docs.items():
        at = 0
        for p in sorted(of[k], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["crc"] == zlib.crc32(np.array(ids[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window
    return [sum(p["length"] for p in s) for s in seqs.values()]


def test_op12_packs_every_id_once(spark, documents):
    rows = [{"doc": r.doc_id, "start": r.start, "length": r.length, "crc": r.ids_crc32, "doc_tokens": r.doc_tokens, "seq": r.sequence_id, "offset": r.offset}
            for r in queries.op12_retrieval_packing(spark, SF).collect()]
    lengths = check_packing(rows, dict(zip([k for k, _ in documents], ids_of([t for _, t in documents], 2))))
    assert sum(x < 4096 for x in lengths) <= 1  # the one shard's last window


def test_packing_of_odd_rows_hot_routes_and_small_shards(spark, empty):
    texts = [*ODD_TEXTS, *["copied text of some words"] * 400, *[f"other {i} words {i * 7}" for i in range(200)]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    out = retrieval_packing.pack(df, WORD_FILE, 2, window=64, shard_ids=640)
    rows = [{"doc": r.doc_id, "start": r.start, "length": r.length, "crc": zlib.crc32(r.ids), "doc_tokens": r.doc_tokens, "seq": r.sequence_id, "offset": r.offset}
            for r in out.collect()]
    lengths = check_packing(rows, dict(enumerate(ids_of(texts, 2))), 64)
    assert sum(x < 64 for x in lengths) <= 16  # one a shard
    assert retrieval_packing.pack(empty, WORD_FILE, 2).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted(r.length for r in retrieval_packing.pack(nulls, WORD_FILE, 2).collect()) == [1, 3, 3]


def brute_fill(docs, window):
    """Pieces (document, from, length, sequence) by plain BM25: the seed's best unused neighbours, the last one cut."""
    size, n = len(docs), [len(d) for d in docs]
    df = Counter(t for d in docs for t in set(d))
    tf = [Counter(d) for d in docs]
    mean = sum(n) / size

    def score(seed, doc):
        return sum(math.log1p((size - df[t] + 0.5) / (df[t] + 0.5)) * tf[doc][t] * 2.2 / (tf[doc][t] + 1.2 * (0.25 + 0.75 * n[doc] / mean)) for t in tf[seed] if t in tf[doc] and df[t] <= max(1, retrieval_packing.COMMON * size))

    used, out, seq, space, carried = set(), [], 0, window, None

    def put(doc):
        nonlocal seq, space
        low = 0
        while low < n[doc]:
            k = min(space, n[doc] - low)
            out.append((doc, low, k, seq))
            low, space = low + k, space - k
            if not space:
                seq, space = seq + 1, window
        return seq

    while len(used) < size or carried is not None:
        seed = carried
        if seed is None:
            seed = min(set(range(size)) - used)
            used.add(seed)
            at = seq
            if put(seed) > at:
                carried = seed if space < window else None
                continue
        carried = None
        while space < window:
            near = [d for d in range(size) if d not in used and score(seed, d) > 0]
            if not near:
                break
            doc = max(near, key=lambda d: (round(score(seed, d), 9), -d))
            used.add(doc)
            at = seq
            if put(doc) > at:
                carried = doc if space < window else None
                break
    return out


def test_windows_are_filled_by_the_seeds_best_unused_neighbours():
    rnd = random.Random(4)
    for _ in range(40):
        docs = [[rnd.randrange(12) for _ in range(rnd.randint(1, 15))] for _ in range(rnd.randint(1, 40))]
        got = retrieval_packing.fill(np.array([x for d in docs for x in d]), np.array([len(d) for d in docs]), 16)
        assert list(zip(*[g.tolist() for g in got])) == brute_fill(docs, 16)


def test_routes_are_the_most_telling_tokens():
    ids = np.array([5, 5, 5, 40_000, 7, 7, 9])
    assert retrieval_packing.routes(ids, np.array([4, 2, 1])).tolist() == [40_000, 7, 9]


def test_op13_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = sorted(con.execute(queries.ORACLES["op13_importance_resampling"]).fetchall())
    assert sorted(tuple(r) for r in queries.op13_importance_resampling(spark, SF).collect()) == want
    assert sum(r[4] is not None for r in want) > 10


def test_features_are_runs_of_words():
    words = importance_resampling.words_of("Zwölf  Ab-c\x00d1 ÉÀ")
    assert [w.decode() for w in words] == ["zwölf", "ab", "c", "d1", "ÉÀ"]
    grams = ["zwölf", "ab", "c", "d1", "ÉÀ", "zwölf ab", "ab c", "c d1", "d1 ÉÀ"]
    assert importance_resampling.buckets_of(words) == Counter(zlib.crc32(g.encode()) % 10_000 for g in grams)
    assert importance_resampling.buckets_of(words, 3) == Counter(zlib.crc32(g.encode()) % 10_000 for g in [*grams, "zwölf ab c", "ab c d1", "c d1 ÉÀ"])


def test_resampling_of_odd_rows(spark, odd, empty):
    out = importance_resampling.resample(odd, odd, least_words=2, percent=50).collect()
    assert len(out) == len(ODD_TEXTS)
    able = [r for r in out if r.n_words >= 2]
    drawn = sorted((r for r in able if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(able) // 2 + 1))
    assert min(r.score for r in drawn) >= max((r.score for r in able if r["rank"] is None), default=-10**9)
    assert all(r.weight == 0 and r["rank"] is None for r in out if r.n_features == 0)
    assert all(r.weight == -1 or r.weight == 0 for r in out)  # the target is the corpus
    assert importance_resampling.resample(empty, odd).count() == 0
    assert importance_resampling.resample(odd, empty).count() == len(ODD_TEXTS)


def test_copies_of_one_row_have_consecutive_ranks(spark):
    rows = [(1, "a b c " * 10)] * 50 + [(i, f"w{i} " * 30) for i in range(2, 52)]
    out = importance_resampling.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([("a b",)], "text string"), percent=100)
    ranks = {r["rank"]: r.doc_id for r in out.collect()}
    assert sorted(ranks) == list(range(1, 101))
    at = [k for k, d in ranks.items() if d == 1]
    assert max(at) - min(at) == 49


def test_equal_neighbours_are_taken_in_order_however_many_there_are():
    rnd = random.Random(8)
    for _ in range(3):
        docs = [[rnd.randrange(6)] * rnd.randint(1, 2) for _ in range(900)]
        got = retrieval_packing.fill(np.array([x for d in docs for x in d]), np.array([len(d) for d in docs]), 16)
        assert list(zip(*[g.tolist() for g in got])) == brute_fill(docs, 16)
