"""Words, lines and shingles of a batch of texts as numpy arrays over the texts' UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Hashes are 64-bit and fixed: the same
on every executor and in every run.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_Q = np.uint64(0xD6E8FEB86659FD93)
#: Keeps the first i bytes of a little-endian 64-bit integer.
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Spans up to this length are hashed 8 bytes at a time, all together; longer ones one by one.
_LONG = 256


def _factor(j: int) -> np.uint64:
    return np.uint64(pow(int(_Q), j, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross a text's border."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    if not len(start):
        return np.empty(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each position on
    length = end - start
    h = mix((eight[start] & _HEAD[np.minimum(length, 8)]) + length.astype(np.uint64) * _Q)
    live, done = np.flatnonzero((length > 8) & (length <= _LONG)), 8
    while len(live):
        part = eight[start[live] + done] & _HEAD[np.minimum(length[live] - done, 8)]
        h[live] = mix(h[live] * _Q + part)
        done += 8
        live = live[length[live] > done]
    for i in np.flatnonzero(length > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Words:
    """Words of a batch: ``start``, ``end`` (byte positions), ``hash``, and ``of``: word range of each text."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        data, self.offsets = utf8(texts)
        self.data = LOWER[data] if lower else data
        self.start, self.end = spans(~SPACE[data], self.offsets)
        self.of = np.searchsorted(self.start, self.offsets)
        self._grams: dict[int, np.ndarray] = {}

    @cached_property
    def hash(self) -> np.ndarray:
        return span_hash(self.data, self.start, self.end)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on (positions near a text's end are meaningless)."""
        if k not in self._grams:
            h, n = self.hash, len(self.hash)
            out = np.zeros(n, np.uint64)
            for j in range(min(k, n)):
                out[: n - j] += h[j:] * _factor(j)
            self._grams[k] = mix(out + np.uint64(k))
        return self._grams[k]

    def shingles(self, k: int) -> list[np.ndarray]:
        """Sorted distinct k-word shingle hashes of each text; a text with fewer words has its whole
        word sequence as its one shingle; a text without words has none."""
        gram = self.grams(k)
        out = []
        for a, b in zip(self.of[:-1].tolist(), self.of[1:].tolist()):
            n = b - a
            if n >= k:
                out.append(_distinct(gram[a: b - k + 1]))
            elif n:
                value = sum(int(x) * int(_factor(j)) for j, x in enumerate(self.hash[a:b])) + n
                out.append(mix(np.array([value % 2**64], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    return h[keep]
