"""Token counts, byte-level BPE and token files against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cohort.llm import bpe_tree, queries, token_counts, token_files
from cohort.llm.common import scratch
from llm_cases import ODD_TEXTS, SF

PIECES, RANKS, WORDS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(documents):
    rnd = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "a", "The", "É", "日本", "<|endoftext|>", "<s>", "e\u0301", "\x00", "\x1c", "\x85", "\xa0", "123", "!!", "🙂", "'s", "I'LL", "µ", "²", "ABAB", "aaaa", "\u2581"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    return [t for _, t in documents] + made + ["a" * 3_000, " " * 1_000, "ab" * 2_000] + [t for t in ODD_TEXTS if t]


def test_counts_equal_the_library(texts):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.count_texts(texts, PIECES) == [len(x) for x in sp.encode(texts, num_threads=1)]


def test_tree_equals_the_library(texts):
    import tiktoken
    ranks = bpe_tree.load_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids, split = bpe_tree._worker(RANKS, P.PATTERN)
    for t in texts:
        assert np.frombuffer(b"".join(map(ids.__getitem__, split(t))), "<u4").tolist() == enc.encode_ordinary(t)


def test_word_files_equal_the_library(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORDS)
    flat, n = token_files.encoder(WORDS).encode(texts, 1)
    want = [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert n.tolist() == list(map(len, want))
    assert flat.tolist() == [i for w in want for i in w]


def test_a_pre_token_is_remembered_once_whatever_stands_beside_it(monkeypatch):
    from tokenizers import Tokenizer
    tok, enc = Tokenizer.from_file(WORDS), token_files.Encoder(WORDS)
    stems = [a + b + c for a in "bdé" for b in "aeiou" for c in "lnrst"]
    texts = [" ".join(f"{mark}{s}{end}" for s in stems) for mark in ("", "(", "\x1c") for end in ("", ",", "...", "'s", "7", "\xa0", "y" * 80)]
    want = [i for t in texts for i in [*tok.encode(t, add_special_tokens=False).ids, 1]]
    assert enc.encode(texts, 1)[0].tolist() == want
    remembered = [k for known in vars(enc).values() if isinstance(known, dict) for k in known if isinstance(k, str)]
    assert sorted(remembered) == sorted([*stems, "(", "\x1c", ",", "...", "'s", "7"])
    monkeypatch.setattr(token_files, "REMEMBER", 40)
    assert [i for t in texts for i in enc.encode([t], 1)[0].tolist()] == want


def test_odd_rows(spark, odd):
    n = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(odd.drop("n_tokens"), PIECES, keep=["doc_id"]).collect()}
    assert n[0] == n[1] == 0 and n[2] == 1 and n[15] == n[16]
    rows = bpe_tree.decode(bpe_tree.encode(odd.drop("ids"), RANKS, P.PATTERN, keep=["doc_id"]), RANKS, keep=["doc_id"]).collect()
    assert len(rows) == len(ODD_TEXTS)
    back = sorted(bytes(r.decoded) for r in rows)
    assert back == sorted((t or "").encode() for t in ODD_TEXTS)


def test_empty_table(spark, empty):
    assert token_counts.count_tokens(empty, PIECES, keep=["doc_id"]).count() == 0
    assert bpe_tree.encode(empty, RANKS, P.PATTERN, keep=["doc_id"]).count() == 0
    path = scratch(spark, "none")
    token_files.write_tokens(empty, path, WORDS, 1)
    assert token_files.with_start(spark, path).count() == 0


def test_files_are_ordered_and_read_selectively(spark, odd):
    path = scratch(spark, "some")
    token_files.write_tokens(odd.repartition(3), path, WORDS, 1)
    rows = sorted(token_files.with_start(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None] + sorted(i for i in range(len(ODD_TEXTS)) if i not in (3, 9))
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.tokens[-1]) == (at, len(r.tokens), 1)
        at += r.n_tokens
    part = token_files.read_tokens(spark, path, 4, 6, columns=["doc_id", "n_tokens"])
    assert sorted(r.doc_id for r in part.collect()) == [4, 5, 6]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,4)" in plan and "tokens:array" not in plan


def test_queries_against_libraries(spark, documents):
    import tiktoken
    from tokenizers import Tokenizer
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_tree.load_ranks(RANKS), special_tokens={})
    op8 = {r.doc_id: r for r in queries.op8_bpe_tree(spark, SF).collect()}
    tok, at = Tokenizer.from_file(WORDS), 0
    op7 = {r.doc_id: r for r in queries.op7_token_files(spark, SF).collect()}
    for i, t in documents:
        ids = enc.encode_ordinary(t)
        assert op8[i].n_tokens == len(ids) and op8[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert op8[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        assert (op7[i].start, op7[i].n_tokens, op7[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    op5 = queries.op5_token_counts(spark, SF).where(F.col("over_limit") != (F.col("n_tokens") > 4096))
    assert op5.count() == 0


def test_long_words_are_counted_in_time(texts):
    import string
    import time

    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rnd = random.Random(3)
    letters = string.ascii_letters + string.digits + "+/"
    long = ["".join(rnd.choice(letters) for _ in range(1_000_000)), "".join(rnd.choice("etaoinshr") for _ in range(200_000)), "a" * 200_000,
            "ab" * 100_000, "thethe" * 20_000, " " * 100_000, "".join(rnd.choice("aé日x") for _ in range(100_000)), "x".join(string.ascii_lowercase * 2_000)]
    t0 = time.time()
    got = token_counts.count_texts(long, PIECES)
    assert time.time() - t0 < 60
    assert got == [len(x) for x in sp.encode(long, num_threads=1)]


def test_queue_and_rounds_agree(texts):
    pieces = token_counts.model(PIECES)
    words = sorted({p for t in texts for p in token_counts.SPLIT.findall(" " + t) if len(p) <= 200})[:4_000]
    assert pieces.count(words).tolist() == [pieces.queued(w) for w in words]


def test_names_to_keep_must_not_be_names_of_results(odd):
    with pytest.raises(ValueError):
        token_counts.count_tokens(odd, PIECES, keep=["doc_id", "n_tokens"])
