"""Target-distribution importance resampling over hashed word n-grams.

A text becomes features in four steps.  A table of 256 bytes lower-cases A-Z and blanks the separators in the
text's UTF-8 bytes (digits, letters and all bytes above 127 stay), ``bytes.split`` yields the words, the CRC-32
of each word is the seed that the next word extends to the CRC-32 of the joined n-gram, and a Counter reduces
the features to counts of buckets.

Counts of all features of the corpus and of the target give each bucket a gain, the log ratio of its add-one
smoothed shares in whole thousandths.  A document's weight is the mean gain of its features; with a Gumbel number
drawn from a hash of its key it becomes a score, and the highest scores are a draw without replacement in
proportion to the weights.  Nothing of a document depends on others but through the table of gains, whose size
is the number of buckets.

How it runs: one pass counts the corpus (a task returns its Counter, at most one row a bucket), one pass scores
it, and the scored rows, a few numbers each, are range-partitioned by score for their ranks.  The rank is a row's
place in its part plus the rows of the parts before it, so no task sorts all rows; rows that are alike in key and
score are told apart by their place in the written table, so copies of one row spread over parts too.

Defined cases: null, empty and blank texts have no features, weight 0 and too few words to be drawn; a null key
hashes as an empty one and comes last among equal scores; repeated rows each have a score, a rank and a row in
the result; other columns are dropped, so extra columns can't clash.  An empty target or an empty table is
smoothed like any other (an empty table gives an empty result).  A very long text is held by its task as a list of
words, nothing else grows with it.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohort.llm.common import bounded_batches, map_text, written

BUCKETS = 10_000
#: Longest n-gram, in words.
GRAMS = 2
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
#: Share of the documents with enough words that is drawn, in percent.
PERCENT = 25
SEED = 7

#: Letters in lower case, separators (ASCII that is neither letter nor digit) as blanks.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


def buckets_of(words: list[bytes], grams: int = GRAMS, buckets: int = BUCKETS) -> Counter:
    """How often the n-grams of up to ``grams`` words fall into each bucket."""
    found = Counter()
    seeds = [crc32(w) for w in words]
    for n in range(1, grams + 1):
        if n > 1:  # the n-gram that ends at a word extends the shorter one that ends before it
            seeds = [crc32(w, crc32(b" ", s)) for s, w in zip(seeds, words[n - 1:])]
        found.update([s % buckets for s in seeds])
    return found


def bucket_counts(df: DataFrame, text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; the driver holds one number a bucket."""
    bounded_batches(df.sparkSession)

    def run(batches):
        total = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                total.update(buckets_of(words_of(t), grams, buckets))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    rows = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the corpus."""
    s, t, size = corpus.astype(float), target.astype(float), len(corpus)
    ratio = (t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def score(df: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score) of every row."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            rows = []
            for t in texts.to_pylist():
                words = words_of(t)
                found = buckets_of(words, grams, len(gain))
                n = found.total()
                rows.append((len(words), n, sum(gain[b] * c for b, c in found.items()) // n if n else 0))
            return [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))]

        return work

    rows = map_text(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", ["key"], make,
                    "n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    drawn = (F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    gumbel = F.floor(-1000 * F.log(-F.log(drawn)))
    return rows.select("key", "n_words", "n_features", "weight", (F.col("weight") + gumbel).alias("score"))


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` (a written table) with ``place``: 1, 2, 3 ... in the given order, by range parts."""
    order = [*order, "__tie"]
    rows = rows.withColumn("__tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
    rows = written(rows.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start")))  # one row a part
    place = F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return rows.withColumn("__part", part).join(starts, "__part").withColumn("place", place).drop("__part", "__start", "__at")


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT,
             least_words: int = LEAST_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of ``df``.

    ``rank`` counts the drawn rows by descending score, then ascending key; it is null where a row is not drawn.
    ``percent`` of the rows with ``least_words`` words or more are drawn, rounded down.
    """
    gain = gains(bucket_counts(df, text, grams, buckets), bucket_counts(target, target_text, grams, buckets))
    rows = written(score(df, gain, key, text, grams, seed), "scores")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = ranked(able, [F.desc("score"), F.asc_nulls_last("key")], "ranks")
    placed = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).withColumnRenamed("key", key)
