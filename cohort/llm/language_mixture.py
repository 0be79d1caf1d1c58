"""Language identification by multilingual mixture inference.

``train`` counts hashed byte trigrams of every labelled training text, per language.  ``predict`` treats a
text as a mixture of the learned languages: expectation-maximisation finds the proportions that make the
text's trigrams most likely, first over all languages, then over the sets of its 1, 2, 3, ... strongest
ones.  The set with the best likelihood less a penalty per language (half the logarithm of the number of
trigrams, times ``PENALTY``) is selected; its strongest language is the prediction and that language's
proportion the score.

Letters are A-Z, a-z and all bytes above 127; whatever stands between is one space.  Defined cases: a text
that is null or has no letter (Unicode category L) is ``und`` with score 0, and so is every text when no
language was learned; equal proportions go to the language that sorts first; training rows with a null text
or language are left out; repeated rows each count and each give a row; other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import bounded_batches, map_text
from cohort.llm.text import mix, utf8

BUCKETS = 1 << 14
#: Added to each trigram count of a language.
SMOOTH = 0.5
ROUNDS = 30
CLOSE = 1e-4
PENALTY = 3.0
#: Proportion below which a document has no main language (the rejecting filter).
LEAST_SHARE = 0.5
UNKNOWN = "und"

_CODE = np.zeros(256, np.uint8)
_CODE[65:91] = np.arange(97, 123)
_CODE[97:123] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)
#: Bucket of each trigram of codes, by a fixed hash.
_FIRST, _SECOND = np.uint64(1 << 16), np.uint64(1 << 8)


def trigrams(texts: pa.Array) -> list[np.ndarray]:
    """Trigram buckets of each text, in order."""
    data, off = utf8(texts)
    code = _CODE[data]
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        c = code[a:b]
        space = c == 0
        keep = np.ones(len(c), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        c = np.concatenate(([0], c[keep], [0])).astype(np.uint64)
        gram = c[:-2] * _FIRST + c[1:-1] * _SECOND + c[2:]
        out.append((mix(gram[c[1:-1] > 0]) % np.uint64(BUCKETS)).astype(np.int64))
    return out


@dataclass
class Model:
    """Learned languages in sorted order, and P(trigram | language) by bucket."""

    langs: list[str]
    prob: np.ndarray

    def em(self, p: np.ndarray, w: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """(proportions, log likelihood) of trigrams with probabilities p (rows) and counts w."""
        share, total = start / start.sum(), w.sum()
        for _ in range(ROUNDS):
            new = share * (p.T @ (w / (p @ share))) / total
            done = np.abs(new - share).max() < CLOSE
            share = new
            if done:
                break
        return share, float(w @ np.log(p @ share))

    def mixture(self, grams: np.ndarray) -> list[tuple[str, float]]:
        """The selected languages with their proportions, strongest first."""
        counts = np.bincount(grams, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        w, p = counts[at].astype(np.float64), self.prob[at]
        share, _ = self.em(p, w, np.ones(len(self.langs)))
        strongest = np.argsort(-share, kind="stable")
        cost = PENALTY * 0.5 * np.log(max(2.0, w.sum()))
        best = None
        for size in range(1, len(self.langs) + 1):
            chosen = strongest[:size]
            if size > 1 and share[chosen[-1]] < 1 / max(2.0, w.sum()):
                break  # less than one trigram
            part, value = (np.ones(1), float(w @ np.log(p[:, chosen[0]]))) if size == 1 else self.em(p[:, chosen], w, share[chosen] + 1e-9)
            value -= cost * size
            if best is not None and value <= best[0]:
                break
            best = value, chosen, part
        _, chosen, part = best
        order = sorted(range(len(chosen)), key=lambda i: (-part[i], self.langs[chosen[i]]))
        return [(self.langs[chosen[i]], float(min(1.0, part[i]))) for i in order]


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from every row with a text and a language.  Only languages x BUCKETS sums reach the driver."""
    bounded_batches(df.sparkSession)
    src = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            grams = trigrams(b.column(1))
            for name in set(langs):
                own = np.concatenate([g for g, x in zip(grams, langs) if x == name])
                counts[name] = counts.get(name, 0) + np.bincount(own, minlength=BUCKETS)
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))],
                                             names=["lang", "bucket", "n"])

    rows = src.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((BUCKETS, max(1, len(langs))))
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        counts[rows["bucket"].to_numpy(), [place[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    counts += SMOOTH
    return Model(langs, counts / counts.sum(0))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def find(model: Model, texts: pa.Array) -> list[list[tuple[str, float]]]:
    """The selected languages of each text with their proportions; none for ``und``."""
    return [model.mixture(g) if model.langs and len(g) and has_letter(t) else [] for t, g in zip(texts.to_pylist(), trigrams(texts))]


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and ``langs array<struct<lang, share>>`` (the selected set)."""
    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            found = find(model, texts)
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            return [pa.array([m[0][0] if m else UNKNOWN for m in found], pa.string()), pa.array([m[0][1] if m else 0.0 for m in found], pa.float64()),
                    pa.array([[{"lang": a, "share": s} for a, s in m] for m in found], kind)]

        return work

    return map_text(df, text, list(keep or []), make, "lang_pred string, score double, langs array<struct<lang:string,share:double>>")


def filter_languages(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` with a recognised main language: not ``und``, and at least half of the text in it.

    Where no language was learned, nothing can be told and every row stays."""
    if not model.langs:
        return df
    bounded_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            found = find(model, b.column(at))
            yield b.filter(pa.array([bool(m) and m[0][1] >= LEAST_SHARE for m in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)
