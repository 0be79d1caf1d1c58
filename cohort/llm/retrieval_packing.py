"""Lexical retrieval packing: token windows filled with documents that a BM25 index finds alike.

Each text is encoded once.  Windows of ``WINDOW`` ids that a long document fills alone are finished at once; what is left
of each document, fewer ids than a window, is packed:

1. Route.  A document's route is its most telling token: frequent in it, and late among the vocabulary's merges,
   which go from common to rare.  Routes with all their ids are dealt to shards of about ``SHARD_IDS`` ids, neighbouring
   routes together; a route with more ids than a shard (a third of all rows may be copies) is spread over several.
   The driver holds one number a route, at most one for each id of the vocabulary.
2. Retrieve.  A task builds one shard's BM25 inverted index over token ids, without the commonest.  The seed document opens a window; the
   unused documents with the highest scores for the seed's tokens follow while they fit, and the first that doesn't
   is cut to fill the window and seeds the next one with its rest.  Where the seed has no unused neighbours left, the next
   unused document of the shard is the seed.

So every window but a shard's last is full, and a shard's index, scores and ids are bounded by its size whatever the
table's.  The last window of a shard is the only one that its reader pads.

Defined cases: null and empty texts are one end id, packed like others; a very long text is windows of its own and a
rest; repeated rows and null keys are documents like others (rows are told apart by their place in the
written table); equal scores go to the earlier row of the shard; other columns are dropped, so extra columns
can't clash; an empty table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import bounded_batches, written
from cohort.llm.token_files import encoder

#: Ids of a sequence.
WINDOW = 4096
#: Ids of a shard, about.
SHARD_IDS = 1 << 21
#: Bounds of BM25's growth with a term's count, and of its correction for length.
K1, B = 1.2, 0.75
#: Share of a shard's documents that a token of its index is in at most.
COMMON = 0.25

PIECE = "start long, length long, doc_tokens long, ids binary"


def _distinct(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, count) of each row's distinct tokens, by row and token."""
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    size = int(ids.max()) + 1
    key, count = np.unique(of * size + ids, return_counts=True)
    return key // size, key % size, count


def routes(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The most telling token of each of the texts whose ids stand one after another, ``n`` each (1 or more)."""
    row, token, count = _distinct(ids.astype(np.int64), np.repeat(np.arange(len(n)), n))
    weight = count / (count + K1) * np.log2(2 + token)
    best = np.maximum.reduceat(weight, np.searchsorted(row, np.arange(len(n))))
    top = np.flatnonzero(weight == best[row])
    return token[top[np.searchsorted(row[top], np.arange(len(n)))]]


def encoded_pieces(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, start, length, doc_tokens, ids, route): a document's full windows, with a null route, and its rest."""
    bounded_batches(df.sparkSession)
    src = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = src.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, n = encoder(tokenizer).encode(b.column(1).to_pylist(), end_id)
            ends = np.cumsum(n)
            pieces = -(-n // window)
            row = np.repeat(np.arange(len(n)), pieces)
            start = window * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            length = np.minimum(n[row] - start, window)
            rest = length < window
            route = np.full(len(row), -1)
            at = (ends - n)[row] + start
            raw = ids.astype("<i4", copy=False)
            if rest.any():
                joined = np.concatenate([raw[a:a + k] for a, k in zip(at[rest].tolist(), length[rest].tolist())])
                route[rest] = routes(joined, length[rest])
            data = [raw[a:a + k].tobytes() for a, k in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(n[row], pa.int64()),
                pa.array(data, pa.binary()), pa.array(route.astype(np.int32), mask=~rest)],
                names=["key", "start", "length", "doc_tokens", "ids", "route"])

    return src.mapInArrow(run, f"key {kind}, {PIECE}, route int")


def shard_map(pieces: DataFrame, shard_ids: int = SHARD_IDS) -> list[tuple[int, int, int]]:
    """(route, first shard, shards) of every route, from the ids of each route; one row a route, which the vocabulary bounds."""
    sums = pieces.where("route IS NOT NULL").groupBy("route").agg(F.sum("length").alias("n")).orderBy("route").toArrow()
    out, shard, filled = [], 0, 0
    for route, n in zip(sums["route"].to_pylist(), sums["n"].to_pylist()):
        spread = -(-n // shard_ids)
        if filled and filled + n > shard_ids:
            shard, filled = shard + 1, 0
        out.append((route, shard, spread))
        if spread > 1:
            shard += spread
        else:
            filled += n
    return out


class Index:
    """BM25 over the token ids of one shard's documents; ``scores`` of a document's tokens for all documents.

    Tokens in more than ``COMMON`` of the documents are not indexed: they tell them apart little and their lists are
    nearly all of the index.
    """

    def __init__(self, ids: np.ndarray, n: np.ndarray):
        self.size = size = len(n)
        row, token, count = _distinct(ids.astype(np.int64), np.repeat(np.arange(size), n))
        df = np.bincount(token)
        rare = df[token] <= max(1, COMMON * size)
        row, token, count = row[rare], token[rare], count[rare]
        weight = np.log1p((size - df[token] + 0.5) / (df[token] + 0.5)) * count * (K1 + 1)
        weight /= count + K1 * (1 - B + B * n / n.mean())[row]
        self.of = np.searchsorted(row, np.arange(size + 1))
        self.token = token
        by = np.argsort(token, kind="stable")
        self.rows, self.weight = row[by], weight[by]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(df)))))

    def scores(self, doc: int) -> np.ndarray:
        terms = self.token[self.of[doc]:self.of[doc + 1]]
        lists = [slice(a, b) for a, b in zip(self.begin[terms].tolist(), self.begin[terms + 1].tolist())]
        if not lists:
            return np.zeros(self.size)
        return np.bincount(np.concatenate([self.rows[x] for x in lists]), np.concatenate([self.weight[x] for x in lists]), self.size)


def fill(ids: np.ndarray, n: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, from, length, sequence) of each piece, in order, of the documents of one shard (fewer ids than a window each)."""
    index, used = Index(ids, n), np.zeros(len(n), bool)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    seq, space, unused, carried = 0, window, 0, -1
    mean = max(1, int(n.mean()))
    while True:
        if carried >= 0:  # the rest of a document that was cut has opened the window
            seed, carried = carried, -1
        else:
            while unused < len(n) and used[unused]:
                unused += 1
            if unused == len(n):
                break
            seed = unused
            used[seed] = True
            chosen = np.array([seed])
            seq, space, carried = _place(out, chosen, n, seq, space, window)
            if carried >= 0:
                continue
        while space < window:  # neighbours of the seed, best first, as many as may be needed
            score = index.scores(seed)
            score[used] = 0
            most = 2 * (space // mean) + 16
            found = np.flatnonzero(score > 0)
            if len(found) > most:  # the best, with all that equal the last of them, are sorted; the next turn finds the others
                found = found[score[found] >= np.partition(score[found], len(found) - most)[len(found) - most]]
            found = found[np.lexsort((found, -score[found]))]
            found = found[:int(np.searchsorted(np.cumsum(n[found]), space)) + 1]
            if not len(found):
                break
            used[found] = True
            seq, space, carried = _place(out, found, n, seq, space, window)
            if carried >= 0 or space == window:
                break
    return tuple(np.concatenate([o[c] for o in out]) for c in range(4)) if out else (np.empty(0, np.int64),) * 4


def _place(out: list, docs: np.ndarray, n: np.ndarray, seq: int, space: int, window: int) -> tuple[int, int, int]:
    """Add whole documents to the window; only the last may not fit and opens the next with its rest.

    Returns the open sequence, its space, and the document that was cut, else -1."""
    length = n[docs].copy()
    over = int(length.sum()) - space
    if over < 0:
        out.append((docs, np.zeros(len(docs), np.int64), length, np.full(len(docs), seq)))
        return seq, -over, -1
    length[-1] -= over
    out.append((docs, np.zeros(len(docs), np.int64), length, np.full(len(docs), seq)))
    if over == 0:
        return seq + 1, window, -1
    last = docs[-1:]
    out.append((last, length[-1:].copy(), np.array([over]), np.array([seq + 1])))
    return seq + 1, window - over, int(last[0])


def pack(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", window: int = WINDOW,
         shard_ids: int = SHARD_IDS) -> DataFrame:
    """(key, start, length, doc_tokens, ids, sequence_id, offset) of every piece.

    ``ids`` are the piece's token ids as little-endian 32-bit integers, from ``start`` of its document's ids on and at
    ``offset`` of its sequence.  Sequences cut from one document have odd numbers, packed ones even numbers.
    """
    spark = df.sparkSession
    pieces = written(encoded_pieces(df, tokenizer, end_id, key, text, window), "pieces")
    kind = pieces.schema["key"].dataType.simpleString()
    shards = spark.createDataFrame(shard_map(pieces, shard_ids), "route int, first int, shards int")  # bounded by the vocabulary
    rest = pieces.where("route IS NOT NULL").withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(shards), "route")
    spread = F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")
    rest = rest.select((F.col("first") + spread).alias("shard"), "row", "key", "start", "doc_tokens", "ids")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row").combine_chunks()
        data = table["ids"].to_pylist()
        ids = np.frombuffer(b"".join(data), "<i4")
        n = np.array([len(x) // 4 for x in data], np.int64)
        doc, low, length, seq = fill(ids, n, window)
        opens = np.ones(len(seq), bool)
        opens[1:] = seq[1:] != seq[:-1]
        before = np.cumsum(length) - length
        offset = before - np.maximum.accumulate(np.where(opens, before, 0))
        start = table["start"].to_numpy()[doc] + low
        cut = [data[d][4 * a:4 * (a + k)] for d, a, k in zip(doc.tolist(), low.tolist(), length.tolist())]
        shard = table["shard"][0].as_py()
        return pa.table([table["key"].take(pa.array(doc)), pa.array(start), pa.array(length), table["doc_tokens"].take(pa.array(doc)),
                         pa.array(cut, pa.binary()), pa.array(2 * ((shard << 32) + seq)), pa.array(offset)],
                        names=["key", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

    packed = rest.groupBy("shard").applyInArrow(run, f"key {kind}, {PIECE}, sequence_id long, offset long")
    alone = (pieces.where("route IS NULL").select("key", "start", "length", "doc_tokens", "ids", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"),
             F.lit(0).cast("long").alias("offset")))
    return packed.unionByName(alone).withColumnRenamed("key", key)
