"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch are ragged rows in one numpy array of symbols.  In each round every row applies
its lowest-rank pair at the same time as all other rows; rows without a mergeable pair leave.  What is
left are the surviving symbols, which are counted.

Within a row all non-overlapping occurrences of the lowest-rank pair merge in one round where no pair that
the merged symbol takes part in has a rank as low (then the order can't matter); else only the leftmost
one does.  The counts are those of the library's priority queue.

A long pre-token is cut wherever two neighbouring characters stand together in no piece: no merge can cross that
place.  A stretch that stays longer than ``LONG`` is merged pair by pair from a queue, in the same order, so that its
time grows with its length and not with the square.

Defined cases: null and empty texts have 0 tokens; repeated rows each have a row; a very long word of any letters takes
time in proportion to its length; extra columns are dropped unless named in ``keep``, and a name in ``keep`` that is also a
result's is refused; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohort.llm.common import map_text

#: Distinct pre-tokens that a Python worker remembers; beyond it the memory starts anew.
REMEMBER = 1_000_000
#: Symbols merged at once.
CHUNK = 1 << 18
#: Pre-tokens up to this length are remembered; longer ones are cut.
SHORT = 64
#: Longest row that merges in rounds.
LONG = 256
NONE = np.iinfo(np.int64).max
#: A space run with what follows up to the next space or line end; the model has no piece that crosses these borders.
SPLIT = re.compile(r" +[^ \n]*|\n|[^ \n]+")


class PieceModel:
    """Merge tables of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(sp.id_to_piece(i).replace("▁", " "), sp.get_score(i)) for i in range(sp.get_piece_size())
                  if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(" " in p.lstrip(" ") or "\n" in p for p, _ in pieces):
            raise ValueError("a piece crosses a pre-token border; this model needs another split")
        text = {p for p, _ in pieces}
        self.symbol: dict[str, int] = {p: i for i, (p, _) in enumerate(pieces)}
        for p in sorted({c for p in text for c in p} - text):  # characters that only occur within pieces
            self.symbol[p] = len(self.symbol)
        self.known = np.zeros(len(self.symbol), bool)
        self.known[: len(pieces)] = True
        self.chars = {c: i for c, i in self.symbol.items() if len(c) == 1}
        order = {s: r for r, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        self.n = len(self.symbol)
        pairs: dict[int, tuple[int, int]] = {}
        for p, s in pieces:
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = order[s], self.symbol[p]
        self.key = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.key.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.key.tolist()], np.int64)
        least = np.full(self.n, NONE)
        np.minimum.at(least, self.key // self.n, self.rank)
        np.minimum.at(least, self.key % self.n, self.rank)
        ties = np.bincount([order[s] for p, s in pieces if len(p) > 1], minlength=len(order)) > 1
        self.safe = (least[self.merged] > self.rank) & ~ties[self.rank]  # by pair
        self.pairs = pairs
        self.together = {p[k:k + 2] for p in text for k in range(len(p) - 1)}

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, index) of adjacent symbols; symbols below 0 are characters that the model doesn't know."""
        key = np.where((a < 0) | (b < 0), -1, a * self.n + b)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE), at

    def cut(self, word: str) -> list[str]:
        """The word's parts between which no piece stands."""
        ends = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.together]
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)])]

    def queued(self, word: str) -> int:
        """Surviving symbols of one word, its lowest-rank and then leftmost pair merged first."""
        get, pairs, n = self.chars.get, self.pairs, self.n
        sym = [get(c, -len(c.encode("utf-8", "replace"))) for c in word]
        size = len(sym)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))

        def entry(i: int, j: int):
            a, b = sym[i], sym[j]
            found = pairs.get(a * n + b) if a >= 0 and b >= 0 else None
            return (found[0], i, a, b, found[1]) if found else None

        queue = [e for i in range(size - 1) if (e := entry(i, i + 1))]
        heapify(queue)
        while queue:
            _, i, a, b, merged = heappop(queue)
            j = after[i]
            if j >= size or sym[i] != a or sym[j] != b:
                continue  # one of the two has been merged otherwise
            sym[i], sym[j] = merged, None
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if e := entry(i, k):
                    heappush(queue, e)
            if (h := before[i]) >= 0 and (e := entry(h, i)):
                heappush(queue, e)
        counts, left = np.zeros(1, np.int64), np.array([s for s in sym if s is not None], np.int64)
        self._add(counts, left, np.zeros(len(left), np.int64))
        return int(counts[0])

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token; an unknown character counts as its UTF-8 bytes."""
        counts = np.zeros(len(pretokens), np.int64)
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        get = self.chars.get
        sym = np.fromiter((get(c, -len(c.encode("utf-8", "replace"))) for p in pretokens for c in p), np.int64, int(sizes.sum()))
        row = np.repeat(np.arange(len(pretokens)), sizes)
        while len(sym) > 1:
            rank, pair = self.pair(sym[:-1], sym[1:])
            rank[row[:-1] != row[1:]] = NONE
            rank = np.append(rank, NONE)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(row)))
            active = np.repeat(least < NONE, length)
            if not active.all():  # finished rows leave
                self._add(counts, sym[~active], row[~active])
                if not active.any():
                    return counts
                sym, row, rank, pair = sym[active], row[active], rank[active], np.append(pair, 0)[active]
                length, least = length[least < NONE], least[least < NONE]
            at = np.flatnonzero(rank == np.repeat(least, length))
            # occurrences that overlap: every second one of a run, from the left
            new_run = np.append(True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]))
            start = np.flatnonzero(new_run)
            within = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            leftmost = np.append(True, row[at[1:]] != row[at[:-1]])
            at = at[np.where(self.safe[pair[at]], within % 2 == 0, leftmost)]
            sym[at] = self.merged[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, row = sym[keep], row[keep]
        self._add(counts, sym, row)
        return counts

    def _add(self, counts: np.ndarray, sym: np.ndarray, row: np.ndarray) -> None:
        # a character that occurs only within pieces stays unknown when it is left alone
        n = np.where(sym < 0, -sym, 1)
        lost = (sym >= 0) & ~self.known[np.maximum(sym, 0)]
        if lost.any():
            name = {v: k for k, v in self.chars.items()}
            n[lost] = [len(name[s].encode()) for s in sym[lost].tolist()]
        np.add.at(counts, row, n)


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


@cache
def _known(path: str) -> dict[str, int]:
    return {}


def count_texts(texts: list[str | None], path: str) -> list[int]:
    """Token counts of a batch; pre-tokens not met before are merged together."""
    known, pieces = _known(path), model(path)
    if len(known) > REMEMBER:
        known.clear()
    split = [SPLIT.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
    fresh = {p for s in split for p in s if p not in known}
    parts = {p: pieces.cut(p) for p in fresh if len(p) > SHORT}  # long ones: their parts are counted instead
    words = {p for p in fresh if len(p) <= SHORT}.union(*parts.values())
    own = {p: pieces.queued(p) for p in words if len(p) > LONG}
    new, part, size = sorted((p for p in words if len(p) <= LONG and p not in known), key=len), [], 0
    for i, p in enumerate(new):
        part.append(p)
        size += len(p)
        if size >= CHUNK or i == len(new) - 1:
            for q, n in zip(part, pieces.count(part).tolist()):
                (known if len(q) <= SHORT else own)[q] = n
            part, size = [], 0
    own |= {p: sum(own[q] if len(q) > SHORT else known[q] for q in s) for p, s in parts.items()}
    if own:
        return [sum(own[p] if len(p) > SHORT else known[p] for p in s) for s in split]
    return [sum(map(known.__getitem__, s)) for s in split]


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``n_tokens long``."""
    def make():
        return lambda texts: [pa.array(count_texts(texts.to_pylist(), path), pa.int64())]

    return map_text(df, text, list(keep or []), make, "n_tokens long")
