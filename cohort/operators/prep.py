"""Preparation of model inputs as an estimator of the pipeline library.

``TablePrep`` fills numeric columns with their median, centres and scales them by the population deviation, fills
text columns with 'Missing' and turns their levels into 0/1 places of one vector.  The fitted ``TablePrepModel``
is a projection; it is saved and loaded with the pipeline it is part of.

``fit_leave_out`` fits one model for the rows outside each fold, and one for all rows, together: one aggregate by fold
for counts, means and deviations, one range shuffle of distinct values whose running counts hold every fold's exact
medians, and one distinct for the levels.  Nothing is read once a fold.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.functions.exprs import col, num
from cohort.operators.ordered import running_sums

MISSING = "Missing"
#: Levels of a text column at most: a vector has a place for each, and the driver and every model hold their names.
MOST_LEVELS = 10_000


class _Columns(Params):
    numeric = Param(Params._dummy(), "numeric", "numeric input columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "text input columns", TypeConverters.toListString)


class TablePrep(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, numeric=None, categorical=None):
        super().__init__()
        self._set(numeric=list(numeric or []), categorical=list(categorical or []))

    def _fit(self, df: DataFrame) -> "TablePrepModel":
        return fit_leave_out(df, self.getOrDefault("numeric"), self.getOrDefault("categorical"))[0]


class TablePrepModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``<c>__z`` for each numeric column c and the vector ``features``; a level unknown to the fit is all zeros."""

    medians = Param(Params._dummy(), "medians", "value of a missing cell", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean of the filled column", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population deviation of the filled column", TypeConverters.toListFloat)
    levels = Param(Params._dummy(), "levels", "levels of each text column, in order", TypeConverters.identity)
    rows = Param(Params._dummy(), "rows", "rows that were fitted", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numeric=None, categorical=None, medians=None, means=None, stds=None, levels=None, rows=0):
        super().__init__()
        self._set(numeric=list(numeric or []), categorical=list(categorical or []), medians=list(medians or []), means=list(means or []),
                  stds=list(stds or []), levels=[list(x) for x in levels or []], rows=rows)

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        scaled = [((F.coalesce(num(df, c), F.lit(m)) - F.lit(a)) / F.lit(s or 1.0)).alias(f"{c}__z")
                  for c, m, a, s in zip(get("numeric"), get("medians"), get("means"), get("stds"))]
        out = df.select("*", *scaled)
        places = [F.col(f"`{c}__z`") for c in get("numeric")]
        for c, levels in zip(get("categorical"), get("levels")):
            filled = F.coalesce(col(c).cast("string"), F.lit(MISSING))
            places += [F.when(filled == F.lit(x), 1.0).otherwise(0.0) for x in levels]
        return out.withColumn("features", array_to_vector(F.array(*places)))


def _joined(parts: list[tuple[int, float, float]]) -> tuple[int, float, float]:
    """(count, mean, sum of squared differences) of the union of parts with these."""
    n, mean, m2 = 0, 0.0, 0.0
    for k, a, q in parts:
        if k:
            d, all_ = a - mean, n + k
            mean, m2, n = mean + d * k / all_, m2 + q + d * d * n * k / all_, all_
    return n, mean, m2


def _medians(df: DataFrame, numeric: list[str], fold, parts: list[int | None]) -> dict[tuple[str, int], float]:
    """{(column, part): exact median} of the rows outside each fold in ``parts`` (None: of all rows)."""
    pairs = [F.struct(F.lit(c).alias("_c"), num(df, c).alias("_v")) for c in numeric]
    long = df.select(fold.alias("_fold"), F.inline(F.array(*pairs))).where("_v IS NOT NULL")
    n = [F.count_if(F.col("_fold") != F.lit(p)) if p is not None else F.count(F.lit(1)) for p in parts]
    names = [f"_n{i}" for i in range(len(parts))]
    ranked = running_sums(long.groupBy("_c", "_v").agg(*[x.alias(c) for x, c in zip(n, names)]), "_v", names, ["_c"])
    sizes = ranked.groupBy("_c").agg(*[F.max(f"cum_{c}").alias(f"_m{c}") for c in names])
    both = ranked.join(sizes, "_c")
    middle = []
    for c in names:  # the first value whose running count passes a rank holds that rank
        low, high = F.floor((F.col(f"_m{c}") - 1) / 2), F.floor(F.col(f"_m{c}") / 2)
        middle.append(((F.min(F.when(F.col(f"cum_{c}") > low, F.col("_v"))) + F.min(F.when(F.col(f"cum_{c}") > high, F.col("_v")))) / 2).alias(c))
    return {(r["_c"], i): r[c] for r in both.groupBy("_c").agg(*middle).collect() for i, c in enumerate(names)}  # one row a column


def fit_leave_out(df: DataFrame, numeric: list[str], categorical: list[str], fold: str | None = None, folds: int = 0) -> list[TablePrepModel]:
    """One model for the rows outside each of the ``folds`` (values 0, 1, ... of column ``fold``), then one for all rows.

    A column without values in a part is filled with 0.  A text column with more than ``MOST_LEVELS`` levels is refused.
    """
    part = F.col(f"`{fold}`") if fold else F.lit(0)
    parts: list[int | None] = [*range(folds), None]
    stats = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(numeric):
        x = num(df, c)
        stats += [F.count(x).alias(f"k{i}"), F.avg(x).alias(f"a{i}"), (F.var_pop(x) * F.count(x)).alias(f"q{i}")]
    rows = df.groupBy(part.alias("_fold")).agg(*stats).collect()  # one row a fold
    medians = _medians(df, numeric, part, parts) if numeric else {}
    found: dict[str, list[tuple[str, int, int]]] = {c: [] for c in categorical}
    if categorical:
        cells = [F.struct(F.lit(c).alias("c"), F.coalesce(col(c).cast("string"), F.lit(MISSING)).alias("v")) for c in categorical]
        seen = df.select(part.alias("_fold"), F.inline(F.array(*cells))).groupBy("c", "v").agg(F.min("_fold").alias("low"), F.max("_fold").alias("high"))
        for r in seen.limit(len(categorical) * MOST_LEVELS + 1).collect():
            found[r["c"]].append((r["v"], r["low"], r["high"]))
        for c, levels in found.items():
            if len(levels) > MOST_LEVELS:
                raise ValueError(f"{c} has more than {MOST_LEVELS} levels.")
    out = []
    for i, p in enumerate(parts):
        used = [r for r in rows if p is None or r["_fold"] != p]
        n, filled = sum(r["n"] for r in used), []
        for j, c in enumerate(numeric):
            k, mean, m2 = _joined([(r[f"k{j}"], r[f"a{j}"], r[f"q{j}"]) for r in used])
            m = medians.get((c, i))
            m = 0.0 if m is None else m
            _, mean, m2 = _joined([(k, mean, m2), (n - k, m, 0.0)])
            filled.append((m, mean, math.sqrt(max(m2, 0.0) / n) if n else 0.0))
        levels = [sorted(v for v, low, high in found[c] if p is None or low != p or high != p) for c in categorical]
        out.append(TablePrepModel(numeric=numeric, categorical=categorical, medians=[f[0] for f in filled], means=[f[1] for f in filled],
                                  stds=[f[2] for f in filled], levels=levels, rows=n))
    return out
