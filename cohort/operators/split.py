"""Deterministic, distributed splits: stratified train/test and stratified folds.

Each key gets a hash of (seed, key).  Distinct (class, hash, key) groups are ordered as integers, the key
breaking ties, by distributed running counts, so no class is ever sorted in one task and the order is the
same whenever it is computed.  A group goes to the test side as a whole when fewer than
round(n_class * test_size) rows come before it, so equal keys never part.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.operators.ordered import running_sums


# ---- fixed values (reasons of the target check, part of its output) ------------
NEEDS_BOTH = "The target must contain both Pass and Fail records."
NEEDS_TWO = "Each class needs at least two records for a train/test split."
NEEDS_MORE = "Increase the dataset size or reduce the test split so both classes appear in train and test data."
# ---------------------------------------------------------------------------


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class


def check_target(df: DataFrame, label: str, test_size: float = 0.3) -> DataFrame:
    """(ok, reason) after the class-count guards of a train/test split."""
    counts = class_counts(df.where(F.col(label).isNotNull()), label)
    n = sum(counts.values())
    test_rows = ceil(n * test_size)
    if len(counts) < 2:
        reason = NEEDS_BOTH
    elif min(counts.values()) < 2:
        reason = NEEDS_TWO
    elif test_rows < len(counts) or n - test_rows < len(counts):
        reason = NEEDS_MORE
    else:
        reason = None
    spark = df.sparkSession
    return spark.createDataFrame([(reason is None, reason, n, test_rows, len(counts))],
                                 "ok boolean, reason string, n bigint, test_rows bigint, n_classes int")


def row_hash(key: Column, seed: int = 42, salt: str = "") -> Column:
    """60-bit hash of (seed, salt, key) from md5: the same value in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def class_ranks(df: DataFrame, label: str, key: Column, seed: int = 42, salt: str = "") -> DataFrame:
    """Add ``_before``: the rows of the class that come before the row's key in hash order."""
    work = df.withColumn("_key", key.cast("string")).withColumn("_h", F.coalesce(row_hash(key, seed, salt), F.lit(0).cast("long")))
    groups = work.groupBy(F.col(label).alias("_l"), F.col("_h").alias("_gh"), F.col("_key").alias("_gk")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(groups, "_gh", ["_n"], group=["_l"], ties=["_gk"]).withColumn("_before", F.col("cum__n") - F.col("_n"))
    same = F.col(label).eqNullSafe(F.col("_l")) & (F.col("_h") == F.col("_gh")) & F.col("_key").eqNullSafe(F.col("_gk"))
    return work.join(ranked.select("_l", "_gh", "_gk", "_before"), same).select(*[F.col(f"`{c}`") for c in df.columns], "_before")


def stratified_split(df: DataFrame, label: str, key: Column, test_size: float = 0.3, seed: int = 42):
    counts = class_counts(df, label)
    quota = F.lit(None).cast("long")
    chain = None
    for cls, n in counts.items():
        q = int(n * test_size + 0.5)
        q = min(max(q, 1), n - 1) if n >= 2 else q
        chain = F.when(F.col(label) == F.lit(cls), F.lit(q)) if chain is None else chain.when(F.col(label) == F.lit(cls), F.lit(q))
    ranked = class_ranks(df, label, key, seed, "split")
    flagged = ranked.withColumn("is_test", F.col("_before") < (chain if chain is not None else quota)).drop("_before")
    return flagged


def choose_cv_folds(counts: dict, requested: int = 5) -> int | None:
    minority = min(counts.values()) if counts else 0
    if minority < 2:
        return None
    return min(requested, minority)


def fold_assignment(df: DataFrame, label: str, key: Column, k: int, seed: int = 42) -> DataFrame:
    """Stratified folds: place of the key within its class in hash order, modulo k."""
    ranked = class_ranks(df, label, key, seed, "fold")
    return ranked.withColumn("fold", (F.col("_before") % k).cast("int")).drop("_before")
