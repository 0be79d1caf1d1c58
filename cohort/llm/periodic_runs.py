"""Periodic run detection in texts: stretches of words that repeat with a period, four times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) of at least
max(6, 4 q) words that no neighbouring word extends with period q.

Method: a branching-tandem test on an enhanced suffix array.

1. Words become numbers and prefix doubling sorts all suffixes of a chunk of texts at once; each round sorts only
   suffixes that are still equal, and its ranks are kept, so whether two blocks of 2^k words are equal is one
   comparison.  Texts never mix: the first rank holds the text.
2. The lengths of common prefixes of neighbours in suffix order (LCP) come from these ranks, and each LCP interval from
   the nearest smaller values to the left and right of a position.  No tree is built.
3. An interval of depth d holds the suffixes that share d words.  A square of period d at i that the next word doesn't
   continue has i and i + d in the interval, in different children.  So for every suffix i in a child other than the
   largest, the inverse suffix array tells whether i + d or i - d lies in the interval outside that child.  A suffix is in a
   smaller child at most log n times.
4. Each square found is the last of its run.  Rotating it to the left, by blocks of 2^k words, finds where the run begins;
   squares with the same stretch merge, the smallest period stays, and stretches under the least length go.

All steps are numpy operations over chunks of whole texts, of ``CHUNK_WORDS`` words or of one longer text.

Defined cases: null, empty and blank texts have no words and no runs, and collapse to an empty text; ties, repeated
rows and null keys are rows like others (each text is judged alone); a very long text makes a chunk of its own, whose
arrays grow with its words times the logarithm of its longest repeat; extra columns pass if they are named in
``keep``, whose names must differ from the results'; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohort.llm.common import map_text

#: Least length of a run: so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of texts that are sorted together.
CHUNK_WORDS = 1 << 17
#: Suffixes of smaller children that are tested at once.
TESTS = 1 << 20


def _levels(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by the first 2^k words for k = 0, 1, ...) of all texts' suffixes, text by text."""
    n = len(words)
    order = np.lexsort((words, doc))
    head = np.ones(n, bool)
    head[1:] = (words[order[1:]] != words[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    rank, sa = np.empty(n, np.int64), order
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, step = [rank.astype(np.int32)], 1
    slot = _shared_slots(head)
    while len(slot):
        at = sa[slot]
        next_ = np.minimum(at + step, n - 1)
        then = np.where((at + step < n) & (doc[next_] == doc[at]), rank[next_] + 1, 0)
        key = rank[at] * (n + 1) + then
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        sa[slot] = at
        head = np.ones(len(slot), bool)
        head[1:] = key[1:] != key[:-1]
        rank[at] = slot[np.maximum.accumulate(np.where(head, np.arange(len(slot)), 0))]
        levels.append(rank.astype(np.int32))
        step *= 2
        slot = slot[_shared_slots(head)]
    return sa, levels


def _shared_slots(head: np.ndarray) -> np.ndarray:
    """Places of groups with more than one member, where ``head`` marks the first of each group."""
    alone = head.copy()
    alone[:-1] &= head[1:]
    return np.flatnonzero(~alone)


def _common_prefix(a: np.ndarray, b: np.ndarray, end: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of suffixes a and b of one text; ``end`` is where their text ends."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        inside = np.maximum(x, y) + (1 << k) <= end
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        out += (inside & (levels[k][x] == levels[k][y])).astype(np.int64) << k
    return out


def _rotations(start: np.ndarray, period: np.ndarray, first: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How far squares can be rotated to the left within their text, which begins at ``first``."""
    out = np.zeros(len(start), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x = start - out - (1 << k)
        inside = x >= first
        x = np.where(inside, x, 0)
        y = np.where(inside, x + period, 0)
        out += (inside & (levels[k][x] == levels[k][y])).astype(np.int64) << k
    return out


def _nearest_smaller(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position with lcp > 0, the nearest positions to the left and right with a smaller value.

    The minimum of the 2^k values from each position on lets all positions walk outwards in steps of 2^k.
    ``lcp`` begins and ends with 0.
    """
    n, at = len(lcp), np.flatnonzero(lcp > 0)
    value, table = lcp[at], [lcp]
    while (1 << len(table)) <= n:
        half = 1 << (len(table) - 1)
        low = np.minimum(table[-1][:-half], table[-1][half:])
        if not low.any():  # every block of this size has a zero, so no walk is longer
            break
        table.append(low)
    left, right = at.copy(), at + 1  # all of [left, at] and of [at, right) are at least the value
    for k in range(len(table) - 1, -1, -1):
        low, size = table[k], 1 << k
        ok = left >= size
        ok &= low[np.where(ok, left - size, 0)] >= value
        left -= ok.astype(np.int64) << k
        ok = right + size <= n
        ok &= low[np.where(ok, right, 0)] >= value
        right += ok.astype(np.int64) << k
    return left - 1, right


def _squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching squares; ``first`` and ``end`` bound the text of each position."""
    at = np.flatnonzero(lcp > 0)
    left, right = _nearest_smaller(lcp)
    # an interval holds the suffixes left ... right - 1; its children are cut at the places of its depth
    by = np.lexsort((at, lcp[at], left))
    left, right, at = left[by], right[by], at[by]
    depth = lcp[at]
    opens = np.ones(len(at), bool)
    opens[1:] = (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])
    low = np.where(opens, left, np.concatenate(([0], at[:-1])))  # child that ends at this place
    closes = np.concatenate((opens[1:], [True]))
    of = np.cumsum(opens) - 1  # interval of each place
    child_low = np.concatenate((low, at[closes]))
    child_high = np.concatenate((at, right[closes]))
    child_of = np.concatenate((of, of[closes]))
    lefts, rights, depths = left[opens], right[opens], depth[opens]
    size = child_high - child_low
    by = np.lexsort((-size, child_of))
    largest = np.ones(len(by), bool)
    largest[1:] = child_of[by][1:] != child_of[by][:-1]
    small = by[~largest]
    total = np.cumsum(size[small])
    found, done = [], 0
    while done < len(small):
        upto = int(np.searchsorted(total, (total[done - 1] if done else 0) + TESTS, "right"))
        part = small[done:max(upto, done + 1)]
        done += len(part)
        count = size[part]
        place = np.repeat(child_low[part] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        child = np.repeat(part, count)
        node = child_of[child]
        i, d = sa[place], depths[node]
        for j, start in ((i + d, i), (i - d, i - d)):
            ok = (j >= first[i]) & (j < end[i])
            other = isa[np.where(ok, j, 0)]
            ok &= (other >= lefts[node]) & (other < rights[node]) & ~((other >= child_low[child]) & (other < child_high[child]))
            found.append((start[ok], d[ok]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period.

    ``words`` are the word numbers of all texts one after another, ``offsets`` where each text begins and the last ends.
    """
    n = len(words)
    none = np.empty(0, np.int64)
    if n < LEAST_WORDS:
        return none, none, none
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first, end = offsets[doc], offsets[doc + 1]
    sa, levels = _levels(words, doc)
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)
    near = np.flatnonzero(doc[sa[1:]] == doc[sa[:-1]])
    lcp[near + 1] = _common_prefix(sa[near], sa[near + 1], end[sa[near]], levels)
    if not lcp.any():
        return none, none, none
    start, period = _squares(sa, isa, lcp, first, end)
    stop = start + 2 * period
    start = start - _rotations(start, period, first[start], levels)
    long = stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start, stop, period = start[long], stop[long], period[long]
    by = np.lexsort((period, stop, start))
    start, stop, period = start[by], stop[by], period[by]
    once = np.ones(len(start), bool)
    once[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])  # the smallest period of a stretch
    start, stop, period = start[once], stop[once], period[once]
    by = np.lexsort((period, start))
    return start[by], (stop - start)[by], period[by]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) == 0


def _chunk(texts: list[list[bytes]]) -> list[tuple]:
    """(words, starts, lengths, periods, collapsed text) of each text."""
    known: dict[bytes, int] = {}
    offsets = np.cumsum([0, *map(len, texts)])
    words = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
    start, length, period = find_runs(words, offsets)
    keep = kept_words(len(words), start, length, period)
    of = np.searchsorted(start, offsets)
    out = []
    for i, (t, a, b) in enumerate(zip(texts, offsets.tolist(), offsets[1:].tolist())):
        x, y = of[i], of[i + 1]
        left = [w for w, k in zip(t, keep[a:b].tolist()) if k] if x < y else t
        out.append((len(t), start[x:y] - a, length[x:y], period[x:y], b" ".join(left).decode()))
    return out


def _work(texts: pa.Array) -> list[pa.Array]:
    rows, held, size = [], [], 0
    for text in texts.to_pylist():
        words = text.encode().split() if text else []  # splits at space and 0x09-0x0D
        if held and size + len(words) > CHUNK_WORDS:
            rows += _chunk(held)
            held, size = [], 0
        held.append(words)
        size += len(words)
    rows += _chunk(held)
    flat = [pa.array(np.concatenate([r[c] for r in rows]) if rows else [], pa.int64()) for c in (1, 2, 3)]
    offsets = pa.array(np.cumsum([0, *[len(r[1]) for r in rows]]), pa.int32())
    runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, names=["start", "length", "period"]))
    return [pa.array([r[0] for r in rows], pa.int64()), runs, pa.array([r[4] for r in rows], pa.string())]


def periodic_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``n_words``, ``runs`` (start, length and period in words, by start, then period) and
    ``collapsed``: the words that no run contains after its first period, joined by single spaces."""
    return map_text(df, text, keep or [], lambda: _work, "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
