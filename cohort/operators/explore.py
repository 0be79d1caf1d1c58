"""Exploration figures: frequency tables, correlations, histograms, bands,
quantiles, box statistics and chart point sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort.functions.exprs import col, num
from cohort.operators.ordered import average_ranks, exact_percentiles

# ---- fixed values ------------------------------------------------------------
SCORE_BAND_EDGES = [0, 40, 50, 60, 70, 85, 100]
# ---------------------------------------------------------------------------


def frequency_table(df: DataFrame, column: str, top_n: int | None = 15) -> DataFrame:
    """Counts per value (missing shown as 'Missing'), percent of all rows, most frequent first."""
    total = df.count()
    values = F.coalesce(col(column).cast("string"), F.lit("Missing"))
    counts = df.groupBy(values.alias("value")).agg(F.count(F.lit(1)).alias("frequency"))
    counts = counts.withColumn("percentage", F.col("frequency") * 100.0 / F.lit(max(total, 1)))
    ordered = counts.orderBy(F.desc("frequency"), F.asc("value"))
    return ordered.limit(top_n) if top_n else ordered


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r for every pair a < b, pairwise-complete rows, in one aggregate."""
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = df.agg(*[F.corr(num(df, a), num(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])))


def correlation_spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman rho for every pair a < b: Pearson r of average ranks on the pair's complete rows.

    Rows are unpivoted and collapse to distinct (pair, x, y) points with weights, so a frequent pair of values
    is one row; ranks come from distributed running counts over distinct values, joined back by value; the
    correlation is weighted, around the mean rank (n + 1) / 2.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pair"), num(df, a).alias("x"), num(df, b).alias("y"))
        for i, (a, b) in enumerate(pairs)]))).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    # the points feed three branches (two rankings and the join back): persist once
    points = long.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")).persist()
    try:
        rx = average_ranks(points, "x", ["pair"], "w").withColumnRenamed("avg_rank", "rx")
        ry = average_ranks(points, "y", ["pair"], "w").withColumnRenamed("avg_rank", "ry")
        mid = {r["pair"]: (r["n"] + 1) / 2 for r in points.groupBy("pair").agg(F.sum("w").alias("n")).collect()}  # one row per pair
        centre = F.element_at(F.create_map(*[F.lit(x) for kv in (mid or {-1: 0.0}).items() for x in kv]), F.col("pair"))
        ranked = points.join(rx, ["pair", "x"]).join(ry, ["pair", "y"])
        dx, dy, w = F.col("rx") - centre, F.col("ry") - centre, F.col("w")
        sums = ranked.groupBy("pair").agg(F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
        spread = F.sqrt("xx") * F.sqrt("yy")
        rho = sums.select("pair", F.when(spread > 0, F.col("xy") / spread).alias("r"))
        names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                                                "pair int, column_a string, column_b string")
        out = names.join(rho, "pair", "left").select("column_a", "column_b", "r")
        return df.sparkSession.createDataFrame(out.collect(), out.schema)  # k*k rows
    finally:
        points.unpersist()


def histogram(df: DataFrame, column: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """Equal-width bins between min and max; the last bin is closed on the right."""
    x = num(df, column)
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm.lo, mm.hi
    if lo is None:
        return df.sparkSession.createDataFrame([], f"bin int, bin_start double, bin_end double, n bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = [b.alias("bin")] + ([col(by).alias(by)] if by else [])
    out = df.where(x.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*([by] if by else []), "bin",
                      (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"), "n")


def score_bands(scores: DataFrame, value: str) -> DataFrame:
    """Six right-closed bands over clipped percent scores; empty bands shown as 0.

    Heights follow the display rule: count / max count * 92, at least 10.
    """
    v = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(100.0))
    e = SCORE_BAND_EDGES
    band = F.when(v <= e[1], 0)
    for i in range(2, len(e)):
        band = band.when(v <= e[i], i - 1)
    counts = scores.where(F.col(value).isNotNull()).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    spark = scores.sparkSession
    labels = spark.createDataFrame([(i, float(e[i]), float(e[i + 1])) for i in range(len(e) - 1)],
                                   "band int, band_low double, band_high double")
    full = labels.join(F.broadcast(counts), "band", "left").select(
        "band", "band_low", "band_high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    mx = F.max("n").over(Window.partitionBy())  # six rows only
    return full.select("*", F.greatest(F.lit(10.0), F.round(F.col("n") / F.greatest(mx, F.lit(1)) * 92, 0))
                       .alias("height"))


def score_quantiles(scores: DataFrame, value: str, points: int = 5) -> DataFrame:
    """Evenly spaced quantiles of clipped percent scores (linear interpolation)."""
    v = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(100.0))
    probs = [i / max(points - 1, 1) for i in range(points)]
    q = exact_percentiles(scores.where(F.col(value).isNotNull()), {"v": v}, probs)["v"]
    return scores.sparkSession.createDataFrame([(i, x) for i, x in enumerate(q) if x is not None], "i long, score double")


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Five-number summary per column after unpivoting (subject, score)."""
    q = exact_percentiles(df, {c: num(df, c) for c in columns}, [0.0, 0.25, 0.5, 0.75, 1.0])
    n = df.agg(*[F.count(num(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    rows = [(c, n[f"n{i}"], *q[c]) for i, c in enumerate(columns) if n[f"n{i}"]]
    return df.sparkSession.createDataFrame(rows, "subject string, n long, min double, q1 double, median double, q3 double, max double")


def pair_not_null(df: DataFrame, x: str, y: str, extra: list[str] | None = None) -> DataFrame:
    return df.select(*[col(c) for c in [x, y] + (extra or [])]).dropna(subset=[x, y])


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    cols = [x, y] + ([color] if color else [])
    return pair_not_null(df, x, y, [color] if color else []).select(*[col(c) for c in cols])


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """2-D binned counts: the scale-out form of a scatter (bounded output)."""
    xs, ys = num(df, x), num(df, y)
    mm = df.agg(F.min(xs).alias("x0"), F.max(xs).alias("x1"), F.min(ys).alias("y0"), F.max(ys).alias("y1")).first()
    wx = (mm.x1 - mm.x0) / bins if mm.x1 and mm.x1 > mm.x0 else 1.0
    wy = (mm.y1 - mm.y0) / bins if mm.y1 and mm.y1 > mm.y0 else 1.0
    bx = F.least(F.floor((xs - F.lit(mm.x0)) / wx), F.lit(bins - 1)).cast("int")
    by = F.least(F.floor((ys - F.lit(mm.y0)) / wy), F.lit(bins - 1)).cast("int")
    return (df.where(xs.isNotNull() & ys.isNotNull()).groupBy(bx.alias("bx"), by.alias("by"))
            .agg(F.count(F.lit(1)).alias("n")))


def sorted_series(df: DataFrame, x: str, y: str, aggregate: bool = False) -> DataFrame:
    """Line-chart data: (x, y) without nulls sorted by x (range-partitioned sort);
    ``aggregate`` gives mean y per x instead of every point."""
    pts = pair_not_null(df, x, y)
    if aggregate:
        pts = pts.groupBy(col(x).alias(x)).agg(F.avg(num(df, y)).alias(y))
    return pts.orderBy(col(x), col(y))


#: Points that a strip of the Kendall grid has at most, about, and strips per axis.
STRIP_POINTS, STRIPS = 1 << 16, 512


def weighted_inversions(key: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i * w_j over all pairs with key_i < key_j and y_i > y_j.

    Points are walked from large to small y; for each bit of the dense key, from the highest, a point with the bit set meets
    the earlier points of its block without it, whose keys are all smaller.
    """
    if len(key) < 2:
        return 0.0
    place = np.unique(key, return_inverse=True)[1]
    by = np.lexsort((-place, -y))  # of equal y the larger key first, so that they don't meet
    place, w = place[by], w[by].astype(float)
    total = 0.0
    for bit in range(int(place.max()).bit_length() - 1, -1, -1):
        block, right = place >> (bit + 1), (place >> bit) & 1 == 1
        left = np.cumsum(np.where(right, 0.0, w))
        opens = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        before = np.concatenate(([0.0], left))[opens]
        left -= np.repeat(before, np.diff(np.append(opens, len(block))))
        total += float((w * left)[right].sum())
        by = np.argsort(place >> bit, kind="stable")
        place, w = place[by], w[by]
    return total


def _grid(points: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{pair: (edges in x, edges in y)}: quantiles of the points, as many as strips are needed; bounded by ``STRIPS``."""
    probs = [i / STRIPS for i in range(1, STRIPS)]
    rows = points.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", probs, 10_000).alias("x"),
                                      F.percentile_approx("y", probs, 10_000).alias("y")).collect()  # one row a pair
    out = {}
    for r in rows:
        strips = min(STRIPS, -(-r["n"] // STRIP_POINTS))
        keep = [STRIPS * i // strips - 1 for i in range(1, strips)]
        out[r["pair"]] = tuple(np.unique(np.array([r[c][i] for i in keep], float)) for c in "xy")
    return out


def discordant_pairs(points: DataFrame) -> DataFrame:
    """(pair, nd double): the weight of pairs of points (pair, x, y, w) with a larger x and a smaller y.

    Edges cut each axis into strips: open intervals between quantiles, and the edge values themselves, so that a frequent
    value is a strip of its own.  Two points in different strips of both axes are counted from the cells of the grid by
    two-dimensional prefix sums; those in one strip of x inside that strip; those in one strip of y, but in
    different strips of x, inside that strip of y.  A strip of one value has no discordant pairs and isn't gathered.
    """
    grid = _grid(points)

    def place(batches):
        for b in batches:
            pair, x, y = (b.column(i).to_numpy() for i in range(3))
            at = np.zeros((2, len(pair)), np.int64)
            for p in np.unique(pair).tolist():
                rows = pair == p
                for axis, v in enumerate((x, y)):  # even: between edges, odd: on an edge
                    e = grid[p][axis]
                    at[axis, rows] = np.searchsorted(e, v[rows], "left") + np.searchsorted(e, v[rows], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at[0]), pa.array(at[1])], names=["pair", "x", "y", "w", "i", "j"])

    def cells(table: pa.Table) -> pa.Table:
        i, j, w = (table[c].to_numpy() for c in ("i", "j", "w"))
        m = np.zeros((i.max() + 1, j.max() + 1))
        m[i, j] = w
        above = np.zeros_like(m)  # what has a smaller i and a larger j
        above[1:, :-1] = np.cumsum(np.cumsum(m[:, ::-1], 1)[:, ::-1], 0)[:-1, 1:]
        return pa.table({"pair": table["pair"][:1], "nd": [float((m * above).sum())]})

    def strip(table: pa.Table) -> pa.Table:
        nd = weighted_inversions(*(table[c].to_numpy() for c in ("key", "y", "w")))
        return pa.table({"pair": table["pair"][:1], "nd": [nd]})

    placed = points.select("pair", "x", "y", F.col("w").cast("long").alias("w")).mapInArrow(place, "pair int, x double, y double, w long, i long, j long")
    between = placed.groupBy("pair", "i", "j").agg(F.sum("w").alias("w")).groupBy("pair").applyInArrow(cells, "pair int, nd double")
    ways = F.array(F.struct(F.lit(0).alias("axis"), F.col("i").alias("of"), F.col("x").alias("key")),
                   F.struct(F.lit(1).alias("axis"), F.col("j").alias("of"), F.col("i").cast("double").alias("key")))
    strips = placed.select("pair", "y", "w", F.inline(ways)).where(F.col("of") % 2 == 0)
    inside = strips.groupBy("pair", "axis", "of").applyInArrow(strip, "pair int, nd double")
    return between.unionByName(inside).groupBy("pair").agg(F.sum("nd").alias("nd"))


def correlation_kendall(df: DataFrame, columns: list[str]) -> DataFrame:
    """Kendall tau-b for every pair a < b on the pair's complete rows; exact and distributed.

    Rows collapse to distinct (x, y) points with weights; ``discordant_pairs`` counts them on a grid.
    """
    spark = df.sparkSession
    if len(columns) < 2:
        return spark.createDataFrame([], "column_a string, column_b string, tau double")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pair"), num(df, a).alias("x"), num(df, b).alias("y"))
        for i, (a, b) in enumerate(pairs)]))).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    points = long.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")).persist()  # read by the edges, strips, cells and ties
    try:
        values = F.array(F.struct(F.lit("n1").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("n2").alias("axis"), F.col("y").alias("v")))
        ties = points.select("pair", "w", F.inline(values)).groupBy("pair", "axis", "v").agg(F.sum("w").alias("t"))
        two = F.col("t").cast("double") * (F.col("t") - 1) / 2
        ties = ties.groupBy("pair").agg(*[F.sum(F.when(F.col("axis") == a, two)).alias(a) for a in ("n1", "n2")])
        same = points.groupBy("pair").agg(F.sum("w").cast("double").alias("n"), F.sum(F.col("w").cast("double") * (F.col("w") - 1) / 2).alias("n3"))
        t = same.join(ties, "pair").join(discordant_pairs(points), "pair")
        n0 = F.col("n") * (F.col("n") - 1) / 2
        s = n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.col("nd")
        den = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
        tau = t.select("pair", F.when(den > 0, s / den).alias("tau"))
        names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                                      "pair int, column_a string, column_b string")
        out = names.join(tau, "pair", "left").select("column_a", "column_b", "tau")
        return spark.createDataFrame(out.collect(), out.schema)  # k*k rows; lets the points cache go
    finally:
        points.unpersist()
