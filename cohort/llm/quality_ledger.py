"""Quality rules as a bitmask ledger.

``measure`` takes every measurement of a text in one pass.  ``ledger`` evaluates each rule once and stores
the failures as bits of one long next to the measurements.  A policy is a named, versioned set of rules:
applying one is a bitwise AND, and ``ablation`` gets, in one aggregate, what each rule alone decides.

A word is a maximal run of characters other than space and 0x09-0x0D.  A null or empty text has no words
and fails ``few_words``.  Repeated rows each give a row; columns other than ``keep`` are dropped, so extra
columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import map_text
from cohort.llm.text import SPACE, Words, spans, span_hash

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words",
            "n_upper", "n_lower", "n_bullet_lines", "n_ellipsis_lines"]

#: Rules in bit order: a rule's bit is its position and never changes; new rules go to the end.  True: failed.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_words", "n_words > 100000"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("few_alphabetic", "10 * n_alpha_words < 8 * n_words"),
    ("capitals", "2 * n_upper > n_upper + n_lower"),
    ("bullets", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
]
BASE = ["few_words", "repeated_windows"]
POLICIES: dict[str, list[str]] = {
    "base": BASE,
    "v1": [name for name, _ in RULES],
}

_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def mask(rules: list[str]) -> int:
    """The bits of a policy."""
    at = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << at[r] for r in set(rules))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _later_equal(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in order, by owner and hash: is an equal one earlier, and is there any equal one."""
    order = np.lexsort((h, owner))  # stable: the first of equal items comes first
    o, x = owner[order], h[order]
    same = np.zeros(len(h), bool)
    same[1:] = (o[1:] == o[:-1]) & (x[1:] == x[:-1])
    earlier, any_equal = np.zeros(len(h), bool), np.zeros(len(h), bool)
    earlier[order] = same
    either = same.copy()
    either[:-1] |= same[1:]
    any_equal[order] = either
    return earlier, any_equal


def measure_batch(texts: pa.Array) -> list[np.ndarray]:
    w = Words(texts, lower=False)
    data, off = w.data, w.offsets
    n = len(off) - 1
    n_words = np.diff(w.of)
    letters = data & 0xC0 != 0x80
    word_chars = _per_text(letters & ~SPACE[data], off)
    alpha = np.concatenate(([0], np.cumsum(_ALPHA[data], dtype=np.int64)))
    word_of = np.repeat(np.arange(n), n_words)
    n_alpha = np.bincount(word_of[alpha[w.end] > alpha[w.start]], minlength=n)
    # lines that hold a word
    start, end = spans(data != 10, off)
    blank = np.concatenate(([0], np.cumsum(~SPACE[data], dtype=np.int64)))
    full = blank[end] > blank[start]
    start, end = start[full], end[full]
    line_of = np.searchsorted(off, start, "right") - 1
    earlier, _ = _later_equal(line_of, span_hash(data, start, end))
    lines = np.bincount(line_of, minlength=n)
    dup = np.bincount(line_of[earlier], minlength=n)
    first, last = data[start] if len(start) else data[:0], data[end - 1] if len(end) else data[:0]
    bullet = np.bincount(line_of[(first == 45) | (first == 42)], minlength=n)
    dots = np.zeros(len(start), bool)
    if len(start):
        dots = (end - start >= 3) & (last == 46) & (data[np.maximum(end - 2, 0)] == 46) & (data[np.maximum(end - 3, 0)] == 46)
    ellipsis = np.bincount(line_of[dots], minlength=n)
    # words within 3-word windows that occur more than once in their text
    covered = np.zeros(len(w.hash) + 3, bool)
    at = np.arange(len(w.hash))
    window = at[at + 3 <= w.of[1:][word_of]] if len(at) else at
    _, repeated = _later_equal(word_of[window], w.grams(3)[window])
    for j in range(3):
        covered[window[repeated] + j] = True
    n_repeat = np.bincount(word_of[covered[: len(at)]], minlength=n)
    return [n_words, word_chars, _per_text(_SYMBOL[data], off), lines, dup, n_repeat, n_alpha,
            _per_text((data >= 65) & (data <= 90), off), _per_text((data >= 97) & (data <= 122), off), bullet, ellipsis]


def measure(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and one long for each of MEASURES."""
    def make():
        return lambda texts: [pa.array(m, pa.int64()) for m in measure_batch(texts)]

    return map_text(df, text, list(keep or []), make, ", ".join(f"{m} long" for m in MEASURES))


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``failed long``: bit i is set where rule i fails."""
    bits: Column = F.lit(0).cast("long")
    for i, (_, rule) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed", bits)


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: texts that fail it, and texts that only it rejects; one aggregate over the ledger."""
    rules = [(i, name) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    held = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long"))
    sums = [F.count("*").alias("n_docs"), F.sum((held == 0).cast("long")).alias("n_kept")]
    for i, name in rules:
        bit = F.lit(1 << i).cast("long")
        sums += [F.sum((held.bitwiseAND(bit) != 0).cast("long")).alias(f"f{i}"), F.sum((held == bit).cast("long")).alias(f"o{i}")]
    row = entries.agg(*sums)
    each = F.array(*[F.struct(F.lit(policy).alias("policy"), F.lit(i).alias("bit"), F.lit(name).alias("rule"), F.col(f"f{i}").alias("n_failed"),
                              F.col(f"o{i}").alias("n_only"), (F.col("n_kept") + F.col(f"o{i}")).alias("n_kept_without")) for i, name in rules])
    return row.select(F.inline(each))
