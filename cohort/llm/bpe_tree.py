"""Byte-level BPE encoding and decoding; merges are found by a segment tree over byte positions.

Each leaf belongs to a byte position and holds the merge rank of the live part that starts there with its
right neighbour; inner nodes hold the leftmost minimum of their 32 children, so the next merge is read at the
root.  A merge kills one leaf and re-ranks the live neighbours: three point updates of logarithmic cost, so
a pre-token of a megabyte takes n log n steps.  A usual word is one node.

``encode(df, ...)`` adds ``ids``; ``decode(df, ...)`` adds the bytes that the ids stand for.  Null text is
empty text (no ids); repeated rows each give a row; extra columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cohort.llm.common import bounded_batches, map_text

#: Distinct pre-tokens that a Python worker remembers; beyond it the memory starts anew.
REMEMBER = 600_000
#: Children of a tree node.
FAN = 32


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 of the token's bytes, then its rank, on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    shift = n.bit_length()
    low, none = (1 << shift) - 1, 1 << 62
    right = list(range(1, n + 1))  # start of the next live part
    left = list(range(-1, n - 1))
    get = ranks.get
    leaves = [none] * n  # rank, then position: the smallest is the leftmost of the lowest rank
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            leaves[i] = r << shift | i
    levels = [leaves]  # each node holds the minimum of FAN nodes of the level below
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i:i + FAN]) for i in range(0, len(below), FAN)])
    top = levels[-1]

    def put(i: int, value: int) -> None:
        leaves[i] = value
        for k in range(1, len(levels)):
            i //= FAN
            value = min(levels[k - 1][i * FAN:i * FAN + FAN])
            if levels[k][i] == value:
                return
            levels[k][i] = value

    if top is leaves:
        put = leaves.__setitem__
    while (best := min(top)) != none:
        at = best & low
        gone = right[at]
        after = right[gone]
        right[at] = after
        put(gone, none)
        value = none
        if after < n:
            left[after] = at
            r = get(piece[at:right[after]])
            if r is not None:
                value = r << shift | at
        put(at, value)
        before = left[at]
        if before >= 0:
            r = get(piece[before:after])
            put(before, none if r is None else r << shift | before)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at:right[at]]])
        at = right[at]
    return out


class _Ids(dict):
    """Pre-token -> its ids as little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of the first 256 characters only, with its Unicode classes spelled out;
    None where it has others than these."""
    chars = [chr(i) for i in range(256)]
    kinds = {k: "".join(re.escape(c) for c in chars if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, i = "", False, 0
    while i < len(pattern):
        part = next((k for k in (*kinds, r"\S") if pattern.startswith(k, i)), pattern[i])
        if part == r"\S":
            if inside:
                return None
            out += f"[^{kinds[r'\s']}]"
        elif part in kinds:
            out += kinds[part] if inside else f"[{kinds[part]}]"
        elif part == "\\":
            return None
        else:
            inside = (inside or part == "[") and part != "]"
            out += part
        i += len(part)
    return re.compile(out)


@cache
def _worker(path: str, pattern: str) -> tuple[_Ids, Callable[[str], list[str]]]:
    general, latin = regex.compile(pattern), latin_pattern(pattern)

    def split(text: str) -> list[str]:
        if latin is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return latin.findall(text)
        return general.findall(text)

    return _Ids(load_ranks(path)), split


def list_array(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Arrow list<int32> of ragged rows."""
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32, copy=False)))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``ids array<int>``: each match of ``pattern`` encoded separately, no special tokens."""
    def make():
        ids, split = _worker(path, pattern)

        def work(texts: pa.Array) -> list[pa.Array]:
            if len(ids) > REMEMBER:
                ids.clear()
            rows = [b"".join(map(ids.__getitem__, split(t))) if t else b"" for t in texts.to_pylist()]
            flat = np.frombuffer(b"".join(rows), "<u4")
            return [list_array(flat, np.array([len(r) // 4 for r in rows], np.int64))]

        return work

    return map_text(df, text, list(keep or []), make, "ids array<int>")


def decode(df: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` columns, ``ids`` and ``decoded binary``: the bytes of each row's ids (null ids: no bytes)."""
    bounded_batches(df.sparkSession)
    src = df.select(*keep, ids)
    at = len(keep)

    def run(batches):
        token: dict[int, bytes] = {}
        for b in batches:
            token = token or {v: k for k, v in load_ranks(path).items()}
            rows = b.column(at)
            out = [b"".join(map(token.__getitem__, r.values.to_numpy(zero_copy_only=False).tolist())) if r.is_valid else b""
                   for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(run, f"{kept}, decoded binary")
