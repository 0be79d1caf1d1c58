"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows belong to source blocks by a hash.  The numbers of rows that each block sends to each shard are drawn
as the uniform shuffle would have them: block after block from the multivariate hypergeometric distribution
over what the shards still take.  Rows are permuted within their block, the first go to shard 0, the next to
shard 1, and so on as the matrix says; within the shard they are permuted again, which gives the slots.

Blocks come from a hash of the row, not from physical partitions, so a task that runs again after a lost
executor deals the same rows to the same shards.  The matrix has at most ``MOST_BLOCKS`` x shards numbers at
any data size; nothing else reaches the driver.  Slots come from the order of a 64-bit hash, cut into ranges
of it, so no task has to sort a whole shard.

Defined cases: nulls in any column hash like any value; repeated rows are rows (equal rows are interchangeable);
columns named ``shard`` or ``slot`` are refused; empty tables give empty results; with fewer rows than
shards some shards are empty.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohort.llm.common import written

#: Rows that a block or a slot range has on average, and most blocks.
BLOCK_ROWS = 4_096
MOST_BLOCKS = 8_192


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Exact draw for populations of any size: inverse distribution, summed outwards from the mode."""
    if good == 0 or drawn == 0:
        return 0
    if bad == 0:
        return drawn
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    sd = math.sqrt(drawn * (good / (good + bad)) * (bad / (good + bad)) * max(0.0, (good + bad - drawn) / max(1, good + bad - 1))) + 1
    a, b = max(low, int(mode - 12 * sd) - 8), min(high, int(mode + 12 * sd) + 8)
    up = np.arange(mode, b, dtype=np.float64)
    rise = np.cumprod((good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1)))
    down = np.arange(mode, a, -1, dtype=np.float64)
    fall = np.cumprod(down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1)))
    weight = np.concatenate((fall[::-1], [1.0], rise))
    total = np.cumsum(weight)
    return a + int(np.searchsorted(total, rng.random() * total[-1], "right"))


def matrix(block_rows: list[int], n_shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts by block and shard, shard sizes): sizes differ by at most one; who gets one more is drawn."""
    rng = np.random.default_rng(seed)
    total = sum(block_rows)
    sizes = np.full(n_shards, total // n_shards, np.int64)
    sizes[rng.permutation(n_shards)[: total % n_shards]] += 1
    left, out = sizes.tolist(), np.zeros((len(block_rows), n_shards), np.int64)
    for b, rows in enumerate(block_rows):
        rest = sum(left)
        for s in range(n_shards):
            rest -= left[s]
            k = hypergeometric(rng, left[s], rest, rows)
            out[b, s] = k
            left[s] -= k
            rows -= k
    return out, sizes


def _hash(df: DataFrame, seed: int, turn: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(turn), *[F.col(f"`{c}`") for c in df.columns])


def assign_shards(df: DataFrame, n_shards: int, seed: int = 1) -> DataFrame:
    """``df`` with ``shard int`` and ``slot long`` (gapless from 0 in each shard), uniformly shuffled."""
    if {"shard", "slot"} & set(df.columns):
        raise ValueError("the input already has a column shard or slot")
    spark = df.sparkSession
    n_rows = df.count()
    n_blocks = max(1, min(MOST_BLOCKS, -(-n_rows // BLOCK_ROWS)))
    order = [_hash(df, seed, 2), _hash(df, seed, 3)]
    rows = df.withColumn("__block", F.pmod(_hash(df, seed, 1), F.lit(n_blocks)).cast("int")).withColumn("__o", F.struct(*order))
    held = {r["__block"]: r["n"] for r in rows.groupBy("__block").agg(F.count("*").alias("n")).collect()}
    counts, _ = matrix([held.get(b, 0) for b in range(n_blocks)], n_shards, seed)
    # proven bound: n_blocks <= MOST_BLOCKS rows of n_shards numbers
    ends = F.broadcast(spark.createDataFrame([(b, c) for b, c in enumerate(np.cumsum(counts, axis=1).tolist())], "__block int, __ends array<bigint>"))
    local = Window.partitionBy("__block").orderBy("__o")
    rank = F.row_number().over(local) - 1
    dealt = rows.withColumn("__rank", rank).join(ends, "__block").withColumn("shard", F.expr("size(filter(__ends, e -> e <= __rank))").cast("int"))
    # the exchange: rows go to their shard's slot ranges
    n_ranges = max(1, min(MOST_BLOCKS // n_shards, -(-n_rows // (n_shards * BLOCK_ROWS))))
    again = F.xxhash64(F.lit(seed), F.lit(4), F.col("__block"), F.col("__rank"))
    span = 2**62 // n_ranges + 1
    sent = dealt.withColumn("__again", again).withColumn("__range", F.floor(F.shiftrightunsigned("__again", 2) / F.lit(span)).cast("int"))
    sent = written(sent.select(*[f"`{c}`" for c in df.columns], "shard", "__range", F.shiftrightunsigned("__again", 2).alias("__again"), "__block", "__rank"), "shards")
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    start = sent.groupBy("shard", "__range").agg(F.count("*").alias("__n"))
    start = F.broadcast(start.select("shard", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))  # at most MOST_BLOCKS rows
    final = Window.partitionBy("shard", "__range").orderBy("__again", "__block", "__rank")
    return (sent.withColumn("__at", F.row_number().over(final) - 1).join(start, ["shard", "__range"])
            .select(*[f"`{c}`" for c in df.columns], "shard", (F.col("__start") + F.col("__at")).cast("long").alias("slot")))


def write_shards(assigned: DataFrame, path: str, ranges: int = 8) -> None:
    """Write one folder per shard, its rows in slot order within each of a few files."""
    (assigned.repartition(F.col("shard"), F.pmod(F.col("slot"), F.lit(ranges))).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
