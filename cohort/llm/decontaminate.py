"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. An n-gram (3 words) that few test items hold is a seed.  How often the training documents hold it says nothing about
   whether it leaked, as a leak itself may stand in thousands of them; so rarity is judged by the benchmark alone.  Of an
   n-gram that more than ``MOST_OWNERS`` items share, two must stand at the same distance in the document and in the item, at
   most ``REACH`` words apart: two seeds on one diagonal.  So a phrase of many items doesn't multiply each place
   where a document has it.  Items with the same words are aligned once.
2. A document that holds a seed is aligned with the seed's item around the place of the seed: local alignment
   over words, with affordable substitutions and gaps, so edited and paraphrased copies still score.  Windows that
   share too few words with the item to reach the threshold by any alignment are passed over.
3. A document is contaminated by an item when the aligned identical words make up a large part of the item, or when
   it holds a long run of the item's words, whatever part of the item that is.

Test items are handled in blocks of bounded size: each block's n-grams and word sequences are what a task, and the
driver, hold at a time, and a benchmark of any size is just more blocks.  Each block is one pass over the texts; with more
than one, a pass is written before the next begins.  Texts never move; only hits leave the tasks.  An alignment
keeps every so many rows of its table and computes the others again on its way back, so its memory grows with the longer
sequence times the root of the shorter one.

Words are maximal runs of characters other than space and 0x09-0x0D, lower-cased, without punctuation at
their ends.  Defined cases: very long texts and items are searched whole; documents or items that are null or have no words match nothing; an item with
fewer words than the n-gram has its whole sequence as its one seed and must occur whole; repeated rows each
count and each give a row; documents with a null key are aligned like others and give a null key; other columns
are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import bounded_batches, written
from cohort.llm.text import Words, mix

GRAM = 3
#: Items that share an n-gram up to which it is a seed by itself; words between two that seed together.
MOST_OWNERS, REACH = 16, 8
#: UTF-8 bytes of test items in one block.
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: Part of an item's words that must align identically.
LEAST_PART = 0.5
#: Identical words that an alignment must have at least (a shorter item must occur whole).
LEAST_WORDS = 8
#: So many identical words in a row are contamination by themselves.
RUN = 13

_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


class BareWords(Words):
    """Words without punctuation at their ends; what is punctuation only stays as it is."""

    def __init__(self, texts: pa.Array):
        super().__init__(pc.utf8_lower(texts))
        for edge, step in ((self.start, 1), (self.end, -1)):
            live = np.flatnonzero(self._strip(np.arange(len(edge)), step))
            while len(live):
                edge[live] += step
                live = live[self._strip(live, step)]

    def _strip(self, live: np.ndarray, step: int) -> np.ndarray:
        last = self.start[live] if step > 0 else self.end[live] - 1
        return _PUNCT[self.data[last]] & (self.end[live] - self.start[live] > 1)

    def seeds(self, i: int, gram: np.ndarray) -> np.ndarray:
        """The n-grams of text i by position; a shorter text's whole sequence."""
        a, b = int(self.of[i]), int(self.of[i + 1])
        return gram[a: b - GRAM + 1] if b - a >= GRAM else _short(self.hash[a:b])


def _short(h: np.ndarray) -> np.ndarray:
    """A sequence of one or two words has one seed: its first word's hash."""
    return h[:1]


def align(item: np.ndarray, part: np.ndarray) -> tuple[float, int, int, int]:
    """Smith-Waterman over word hashes: (score, identical words, first, end) of the best local alignment;
    ``first`` and ``end`` are word positions in ``part``."""
    m, n = len(item), len(part)
    if not m or not n:
        return 0.0, 0, 0, 0
    slope = GAP * np.arange(n + 1)

    def after(above: np.ndarray, i: int) -> np.ndarray:
        diagonal = above[:-1] + np.where(part == item[i - 1], MATCH, MISMATCH)
        row = np.concatenate(([0.0], np.maximum(np.maximum(diagonal, above[1:] + GAP), 0.0)))
        return np.maximum(np.maximum.accumulate(row - slope) + slope, 0.0)  # gaps along the row

    step = int(np.ceil(np.sqrt(m)))
    row, kept, best = np.zeros(n + 1), [], (0.0, 0, 0)
    for i in range(1, m + 1):
        if (i - 1) % step == 0:
            kept.append(row.astype(np.float32))  # sums of whole numbers, exact
        row = after(row, i)
        j = int(row.argmax())
        if row[j] > best[0]:
            best = float(row[j]), i, j
    score, i, end = best
    j, same, low, rows = end, 0, m + 1, []
    while i and j:
        if i - 1 < low:  # the rows from the last kept one on
            low = (i - 1) // step * step
            rows = [kept[low // step].astype(float)]
            for k in range(low + 1, i + 1):
                rows.append(after(rows[-1], k))
        here, above = rows[i - low], rows[i - 1 - low]
        if here[j] <= 0:
            break
        equal = item[i - 1] == part[j - 1]
        if here[j] == above[j - 1] + (MATCH if equal else MISMATCH):
            same += bool(equal)
            i, j = i - 1, j - 1
        elif here[j] == above[j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, same, int(j), end


@dataclass
class Block:
    """A bounded part of the benchmark: its items by their word sequence, and which of them hold which seed.

    ``keys`` are sorted: n-grams that few items hold, and pairs of those in ``common`` with their distance."""

    ids: list[list]  # ids of the items with each word sequence
    words: list[np.ndarray]
    grams: list[np.ndarray]
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted n-grams
    owner: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # item of each key (keys may repeat)
    place: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # position within the item
    common: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted n-grams that many items hold

    @staticmethod
    def of(ids: list, texts: pa.Array) -> Block:
        w = BareWords(texts)
        gram = w.grams(GRAM)
        items: dict[bytes, tuple[list, np.ndarray, np.ndarray]] = {}
        for i, k in enumerate(ids):
            if w.of[i + 1] > w.of[i]:
                words = w.hash[w.of[i]: w.of[i + 1]]
                items.setdefault(words.tobytes(), ([], words, w.seeds(i, gram)))[0].append(k)
        return Block([x[0] for x in items.values()], [x[1] for x in items.values()], [x[2] for x in items.values()]).index()

    def index(self) -> Block:
        """Look-up of the n-gram positions of each item."""
        keys = np.concatenate(self.grams or [np.empty(0, np.uint64)])
        size = np.array([len(g) for g in self.grams], np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
        long = size[owner] > 1  # an item that is one n-gram has no second seed
        held = np.unique(np.stack([keys[long], owner[long].astype(np.uint64)]), axis=1)[0]
        values, owners = np.unique(held, return_counts=True)
        self.common = values[owners > MOST_OWNERS]
        pairs, first = _pairs(keys, np.isin(keys, self.common), owner)
        alone = ~np.isin(keys, self.common) | ~long
        keys, owner, place = (np.concatenate(x) for x in ((keys[alone], pairs), (owner[alone], owner[first]), (place[alone], place[first])))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.place = keys[order], owner[order], place[order]
        return self

    def hits(self, w: BareWords) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, where the item would start, seeds that say so) of the seeds in texts, sorted; the start is a
        word position of the batch."""
        none = np.empty(0, np.int64)
        if not len(self.keys) or not len(w.hash):
            return none, none, none, none
        text = np.repeat(np.arange(len(w.of) - 1), np.diff(w.of))
        whole = np.flatnonzero(np.arange(len(text)) + GRAM <= w.of[1:][text])
        gram = w.grams(GRAM)
        found = [self._places(gram[whole], whole)]
        if len(self.common):
            inside = np.zeros(len(gram), bool)
            inside[whole] = np.isin(gram[whole], self.common)
            found.append(self._places(*_pairs(gram, inside, text)))
        if any(len(x) < GRAM for x in self.words):
            found.append(self._places(w.hash, np.arange(len(text))))
        pos, at = (np.concatenate(x) for x in zip(*found))
        out, n = np.unique(np.stack([text[pos], self.owner[at], pos - self.place[at]]), axis=1, return_counts=True)
        return out[0], out[1], out[2], n

    def _places(self, values: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, place in the look-up) of every pair of equal n-grams."""
        first = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        live = np.flatnonzero(self.keys[first] == values)
        first = first[live]
        n = np.searchsorted(self.keys, values[live], "right") - first
        return np.repeat(pos[live], n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _pairs(gram: np.ndarray, common: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of the first) of every two common n-grams of one text that are at most REACH words apart."""
    keys, first = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for d in range(1, REACH + 1):
        at = np.flatnonzero(common[:-d] & common[d:] & (text[:-d] == text[d:])) if len(gram) > d else np.empty(0, np.int64)
        keys.append(mix(gram[at] * np.uint64(2 * d + 1) + mix(gram[at + d] + np.uint64(d))))
        first.append(at)
    return np.concatenate(keys), np.concatenate(first)


def blocks(items: DataFrame, key: str, text: str):
    """Blocks of the benchmark, each of bounded size."""
    src = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for i in range(n):  # the caller is done with a block when it asks for the next
        part = src if n == 1 else src.where(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == i)
        rows = part.orderBy("key", "text").toArrow()
        if rows.num_rows:
            yield Block.of(rows["key"].to_pylist(), rows["text"].combine_chunks()), n > 1


def is_contaminated(same: int, m: int) -> bool:
    return same >= min(m, max(LEAST_WORDS, LEAST_PART * m))


def has_run(item: np.ndarray, part: np.ndarray, at: int) -> bool:
    """Whether ``part``, laid on the item from word ``at`` on, has RUN equal words in a row."""
    apart = np.flatnonzero(np.r_[True, item[at: at + len(part)] != part, True])
    return int(np.diff(apart).max()) > RUN


def align_hits(block: Block, w: BareWords) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, score, identical words, first, end) of every contaminated text; word positions in the text."""
    text, owner, start, n_seeds = block.hits(w)
    out = []
    first = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(owner) != 0)][:len(text)])
    for x, y in zip(first.tolist(), [*first[1:].tolist(), len(text)]):
        t, item = int(text[x]), int(owner[x])
        words = block.words[item]
        m, slack = len(words), len(words) // 2 + 4
        a0, b0 = int(w.of[t]), int(w.of[t + 1])
        best, windows = None, []
        for s, n in zip(start[x:y].tolist(), n_seeds[x:y].tolist()):  # seeds that point to about the same place make one window
            run = n > RUN - GRAM and has_run(words, w.hash[max(a0, s): min(b0, s + m)], max(a0 - s, 0))
            if windows and s - slack <= windows[-1][1]:
                windows[-1][1] = s + m + slack
                windows[-1][2] |= run
            else:
                windows.append([s - slack, s + m + slack, run])
        for a, b, run in windows:
            a, b = max(a0, a), min(b0, b)
            # word counts bound the identical words, so hopeless windows need no alignment
            part = w.hash[a:b]
            if not run and not is_contaminated(min(int(np.isin(words, part).sum()), int(np.isin(part, words).sum())), m):
                continue
            score, same, begin, end = align(words, part)
            if (run or is_contaminated(same, m)) and (best is None or score > best[0]):
                best = score, same, a - a0 + begin, a - a0 + end
        if best:
            out.append((t, item, *best))
    return out


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """One row per (document, item) above the threshold: key, item_key, ``score`` (alignment score over the
    best possible), ``n_same`` identical words, ``n_item_words``, ``first_word`` and ``end_word`` in the document."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    kind, item_kind = src.schema["key"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"key {kind}, item {item_kind}, score double, n_same long, n_item_words long, first_word long, end_word long"
    found = None
    for block, several in blocks(items, item_key, item_text):

        def run(batches, block=block):
            for b in batches:
                hits = [(h[0], k, *h[1:]) for h in align_hits(block, BareWords(b.column(1))) for k in block.ids[h[1]]]
                m = [len(block.words[h[2]]) for h in hits]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], item_type(block.ids)),
                    pa.array([h[3] / (MATCH * n) for h, n in zip(hits, m)], pa.float64()), pa.array([h[4] for h in hits], pa.int64()),
                    pa.array(m, pa.int64()), pa.array([h[5] for h in hits], pa.int64()), pa.array([h[6] for h in hits], pa.int64())],
                    names=["key", "item", "score", "n_same", "n_item_words", "first_word", "end_word"])

        part = src.mapInArrow(run, schema)
        part = written(part, "hits") if several else part
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("key", key).withColumnRenamed("item", item_key)


def item_type(ids: list[list]) -> pa.DataType:
    return pa.array([k for same in ids for k in same]).type


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                      item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no test item contaminates (each row is judged by its own text).

    Decided row by row within the tasks, so rows that share a key, or have none, are told apart.
    """
    bounded_batches(docs.sparkSession)
    out = docs
    for block, several in blocks(items, item_key, item_text):
        at = docs.columns.index(text)

        def run(batches, block=block):
            for b in batches:
                bad = {h[0] for h in align_hits(block, BareWords(b.column(at)))}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
        out = written(out, "clean") if several else out
    return out
