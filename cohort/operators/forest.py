"""Random forests grown on grouped rows, one tree a task.

The library's forests read every row once a tree and level, and each task of a pass sends the sums of all open nodes.
Here equal rows are one row with a count: a row that is drawn Poisson(1) times, as the library draws it, makes
Poisson(n) draws of n equal rows.  The distinct rows, one byte a feature, go to the tasks, and a task grows whole trees
level by level over arrays.  The trees are the library's: at most 32 bins a feature with its thresholds, its number of
features a node, the same impurity, leaf and pruning rules.  Draws depend on the seed and the tree only, not on
partitions.  ``max_cells`` bounds what the tasks hold; a caller whose rows are more uses the library's forest.

The fitted stage scores each distinct row of a task once, keeps no trees in the JVM, and is saved with its pipeline.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature at most, as in the library.
MOST_BINS = 32
#: Rows scored together, few enough for the processor's cache; scored rows that a task remembers at most.
CHUNK, REMEMBERED = 8_192, 500_000
EPSILON = 2.220446049250313e-16
#: Two counts below it are one exact number.
TWO = 2.0 ** 26


# ---- arrays: thresholds, growth, scoring ----------------------------------------
def thresholds(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The library's split points of a column: midpoints of few distinct values, of many those nearest to equal shares."""
    values, at = np.unique(values, return_inverse=True)
    counts = np.bincount(at, weights=counts)
    most = min(MOST_BINS, int(counts.sum())) - 1
    if len(values) - 1 <= most:
        return (values[:-1] + values[1:]) / 2
    out, stride = [], counts.sum() / (most + 1)
    target, sums = stride, np.cumsum(counts)
    for i in range(1, len(values)):
        if abs(sums[i - 1] - target) < abs(sums[i] - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(out)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Rows of one byte a feature: how many thresholds lie below the value."""
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, x[:, f]) if len(c) != 1 else ~(x[:, f] <= c[0])
    return out


def packed(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray | None:
    """Each row of bins as one number, or None where the bins are too many for that."""
    if np.prod([len(c) + 1.0 for c in cuts]) >= 2.0 ** 62:
        return None
    key = np.zeros(len(x), np.int64)
    for f, c in enumerate(cuts):
        if len(c):
            key *= len(c) + 1
            key += x[:, f]
    return key


def _impurity(stats: list[np.ndarray], classes: int) -> np.ndarray:
    """Gini of counts a class, or variance of (count, sum, sum of squares)."""
    if not classes:
        n, s, q = stats
        return (q - s * s / n) / n
    n = sum(stats[1:], stats[0])
    out = np.ones(len(n))
    for c in stats:
        p = c / n
        out -= p * p
    return out


def _count(stats: list[np.ndarray], classes: int) -> np.ndarray:
    return sum(stats[1:classes], stats[0]) if classes else stats[0]


def _apart(sums: list[np.ndarray], classes: int) -> list[np.ndarray]:
    """Counts of two classes out of one number, where they were added up as one."""
    if classes != 2 or len(sums) == 2:
        return sums
    high = np.floor(sums[0] / TWO)
    return [sums[0] - high * TWO, high]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers begins."""
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _candidates(key: np.ndarray, nodes: int, bins: int, weights: list[np.ndarray], classes: int) -> tuple:
    """(node, bin, sums up to and with the bin) of the occupied bins of each node, in order."""
    sums = [np.bincount(key, w, nodes * bins) for w in weights]
    if not classes:  # sums of any numbers: added up within each node, so that no other node's rounding comes in
        sums = [np.cumsum(s.reshape(nodes, bins), axis=1).ravel() for s in sums]
        at = np.flatnonzero(np.bincount(key, minlength=nodes * bins))
        return at // bins, at % bins, [s[at] for s in sums]
    at = np.flatnonzero(sum(sums[1:], sums[0]))
    node, sums = at // bins, _apart([s[at] for s in sums], classes)
    start = _starts(node)
    size = np.diff(start, append=len(at))
    left = []
    for s in sums:  # whole numbers: differences of running sums are exact
        run = np.cumsum(s)
        left.append(run - np.repeat(run[start] - s[start], size))
    return node, at % bins, left


def grow(cols: np.ndarray, bins: list[int], rows: np.ndarray, y: np.ndarray, n: np.ndarray, classes: int, per_node: int, depth: int,
         least: int, seed: list[int], bootstrap: bool = True) -> tuple[np.ndarray, ...]:
    """One tree: (feature or -1, bin, left child or place of the leaf's values) a node, and the leaves' values.

    ``cols``: bins by feature and distinct row; ``rows``, ``y``, ``n``: row, label and count of each group of equal
    examples; ``classes``: 0 for a regression.  A node's right child follows its left one; bins up to the node's go left."""
    rng, d = np.random.default_rng(seed), len(bins)
    k = rng.poisson(n).astype(float) if bootstrap else n.astype(float)
    m = cols.shape[1]
    weights = [np.bincount(rows, k * (y == c), m) for c in range(classes)] if classes else [np.bincount(rows, k * z, m) for z in (np.ones(len(y)), y, y * y)]
    used = np.flatnonzero(_count(weights, classes))
    cols, weights = cols.take(used, axis=1), [w[used] for w in weights]
    total = [np.array([w.sum()]) for w in weights]
    if classes == 2 and k.sum() < TWO:
        weights = [weights[0] + TWO * weights[1]]
    made = [(total, np.array([-1]), np.array([0], np.uint8), np.array([-1]))]  # by level: sums, feature, bin, first child
    node, ids = np.zeros(len(used), np.intp), np.arange(len(used))  # place of the row's node among the open ones, and of its bins
    open_, total = np.array([0]), [t.copy() for t in total]  # places of the open nodes within the level
    if not len(used) or _impurity(total, classes)[0] < EPSILON:
        open_ = open_[:0]
    nodes = 1
    for level in range(depth):
        size = len(open_)
        if not size:
            break
        allowed = np.ones((size, d), bool)
        if per_node < d:
            allowed[:] = False
            np.put_along_axis(allowed, np.argpartition(rng.random((size, d), np.float32), per_node - 1, axis=1)[:, :per_node], True, axis=1)
        allowed = np.ascontiguousarray(allowed.T)
        count, impurity = _count(total, classes), _impurity(total, classes)
        gain, feature, cut, left = np.zeros(size), np.full(size, -1), np.zeros(size, np.uint8), [np.zeros(size) for _ in total]
        for f in range(d):
            if bins[f] < 2:
                continue
            at = np.flatnonzero(allowed[f].take(node))
            if not len(at):
                continue
            x, w = cols[f].take(ids.take(at)), node.take(at)
            if bins[f] == 2:
                who, side = np.flatnonzero(allowed[f]), at[x == 1] if classes else at[x == 0]
                sums = _apart([np.bincount(node.take(side), v.take(side), size)[who] for v in weights], classes)
                which = np.zeros(len(who), np.uint8)
                if classes:  # whole numbers, and mostly fewer rows on this side
                    sums = [t[who] - s for t, s in zip(total, sums)]
            else:
                who, which, sums = _candidates(w * bins[f] + x, size, bins[f], [v.take(at) for v in weights], classes)
            k_left = _count(sums, classes)
            k_right = count[who] - k_left
            fit = np.flatnonzero((k_left >= max(least, 1)) & (k_right >= max(least, 1)))
            if not len(fit):
                continue
            who, which, sums, k_left, k_right = who[fit], which[fit], [s[fit] for s in sums], k_left[fit], k_right[fit]
            rest = [t[who] - s for t, s in zip(total, sums)]
            won = impurity[who] - k_left / count[who] * _impurity(sums, classes) - k_right / count[who] * _impurity(rest, classes)
            start = _starts(who)
            best = np.maximum.reduceat(won, start)
            first = np.flatnonzero(won == np.repeat(best, np.diff(start, append=len(who))))
            first = first[_starts(who[first])]  # the first of equals in each node
            first = first[won[first] > gain[who[first]]]
            to = who[first]
            gain[to], feature[to], cut[to] = won[first], f, which[first]
            for s, b in zip(left, sums):
                s[to] = b[first]
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        child = np.full(size, -1)
        child[split] = 2 * np.arange(len(split))
        _, fs, cs, firsts = made[-1]
        fs[open_], cs[open_], firsts[open_] = feature, cut, child
        both = [np.column_stack([s[split], t[split] - s[split]]).ravel() for s, t in zip(left, total)]
        made.append((both, np.full(2 * len(split), -1), np.zeros(2 * len(split), np.uint8), np.full(2 * len(split), -1)))
        nodes += 2 * len(split)
        stays = np.flatnonzero(np.abs(_impurity(both, classes)) >= EPSILON)
        place = np.full(2 * len(split), -1)
        place[stays] = np.arange(len(stays))
        kept = np.flatnonzero(feature.take(node) >= 0)
        was, ids = node.take(kept), ids.take(kept)
        to = place.take(child.take(was) + (cols.ravel().take(feature.take(was) * cols.shape[1] + ids) > cut.take(was)))
        on = np.flatnonzero(to >= 0)
        kept, ids, node = kept.take(on), ids.take(on), to.take(on)
        weights = [v.take(kept) for v in weights]
        if 2 * len(ids) < cols.shape[1]:
            cols, ids = cols.take(ids, axis=1), np.arange(len(ids))
        open_, total = stays, [s[stays] for s in both]
    return _pruned(made, classes)


def _pruned(made: list[tuple], classes: int) -> tuple[np.ndarray, ...]:
    """The tree as arrays; two leaves with the same prediction become their parent's, from below, as the library does it."""
    said = [np.argmax(np.column_stack(s), axis=1) if classes else s[1] / np.maximum(s[0], 1) for s, *_ in made]
    for (_, feature, _, first), mine, (_, below, _, _), theirs in zip(made[-2::-1], said[-2::-1], made[:0:-1], said[:0:-1]):
        at = np.flatnonzero(feature >= 0)
        a, b = first[at], first[at] + 1
        feature[at[(below[a] < 0) & (below[b] < 0) & (theirs[a] == theirs[b])]] = -1
    features, cuts, left, values, place, leaves = [], [], [], [], np.array([0]), 0
    done = 0  # nodes of the levels above
    for stats, feature, cut, first in made:
        inner, here = feature[place] >= 0, np.empty(len(place), np.int32)
        done += len(place)
        here[inner] = done + 2 * np.arange(inner.sum())
        here[~inner] = leaves + np.arange((~inner).sum())
        leaves += (~inner).sum()
        features.append(feature[place].astype(np.int16)), cuts.append(cut[place]), left.append(here)
        ends = [s[place[~inner]] for s in stats]
        size = np.maximum(_count(ends, classes), 1)
        values.append(np.column_stack([c / size for c in ends[1:]]) if classes else (ends[1] / size)[:, None])
        place = (first[place[inner]][:, None] + [0, 1]).ravel()
        if not len(place):
            break
    return np.concatenate(features), np.concatenate(cuts), np.concatenate(left), np.concatenate(values)


def paths(trees: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """One number a node: its next place, bin and feature; a leaf leads to itself."""
    out = []
    for feature, cut, left, values in trees:
        inner = feature >= 0
        to, bins = np.where(inner, left, np.arange(len(left))).astype(np.int64), np.where(inner, cut, 255).astype(np.int64)
        out.append((to << 32 | bins << 16 | np.where(inner, feature, 0), inner, left, values))
    return out


def walk(steps: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Sums of the trees' values for rows of bins."""
    out = np.zeros((len(x), steps[0][3].shape[1]))
    for low in range(0, len(x), CHUNK):
        part, d = x[low:low + CHUNK].ravel(), x.shape[1]
        start = np.arange(len(part) // d) * d
        for step, inner, left, values in steps:
            at, row = np.zeros(len(start), np.int64), start
            ends, rows = np.empty(len(start), np.int64), np.arange(len(start))
            while len(at):
                for _ in range(4):
                    s = step.take(at)
                    at = (s >> 32) + (part.take(row + (s & 65535)) > (s >> 16 & 255))
                more = inner.take(at)
                ends[rows] = at
                at, row, rows = at[more], row[more], rows[more]
            out[low:low + len(start)] += values[left[ends]]
    return out


# ---- stages ---------------------------------------------------------------------
class GroupedForest(Estimator):
    """Estimator over ``features``, a label and how many rows each row stands for; ``classes``: 0 for a regression."""

    @keyword_only
    def __init__(self, *, label="label", count="count", classes=0, trees=100, depth=5, least=1, seed=0, bootstrap=True, all_features=False):
        super().__init__()
        self.label, self.count, self.classes, self.trees, self.depth, self.least = label, count, classes, trees, depth, least
        self.seed, self.bootstrap, self.all_features = seed, bootstrap, all_features

    def _fit(self, df: DataFrame) -> "GroupedForestModel":
        spark, classes, trees, depth, least, seed, bootstrap = df.sparkSession, self.classes, self.trees, self.depth, self.least, self.seed, self.bootstrap
        got = df.select(vector_to_array("features").alias("x"), F.col(self.label).cast("double").alias("y"), F.col(self.count).cast("long").alias("n")).toArrow()
        x, y, n = _matrix(got["x"].combine_chunks()), got["y"].to_numpy(), got["n"].to_numpy()
        cuts = [thresholds(x[:, f], n) for f in range(x.shape[1])]
        x = binned(x, cuts)
        if (key := packed(x, cuts)) is None:
            key = np.ascontiguousarray(x).view(f"V{x.shape[1]}").ravel()
        _, first, rows = np.unique(key, return_index=True, return_inverse=True)
        order = np.lexsort((y, rows))  # whatever the order in which the rows came
        rows, y, n = rows[order], y[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (y[1:] != y[:-1])]))
        data = spark.sparkContext.broadcast((np.ascontiguousarray(x[first].T), rows[new].astype(np.int32), y[new], np.add.reduceat(n, new)))
        bins, d = [len(c) + 1 for c in cuts], len(cuts)
        per_node = d if trees == 1 or self.all_features else int(np.ceil(np.sqrt(d) if classes else d / 3))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cols, rows, y, n = data.value
            for b in batches:
                for i in b.column(0).to_pylist():
                    tree = grow(cols, bins, rows, y, n, classes, per_node, depth, least, [seed, i], bootstrap)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in tree]], names=["tree", *TREE])

        parts = min(trees, 4 * spark.sparkContext.defaultParallelism)
        made = spark.range(0, trees, 1, parts).mapInArrow(run, TREE_SCHEMA).toArrow()
        data.destroy()
        model = GroupedForestModel(classes=classes, cuts=[c.tolist() for c in cuts])
        model.trees = _trees(made, classes)
        return model


TREE = ["feature", "cut", "left", "leaves"]
TREE_SCHEMA = "tree long, " + ", ".join(f"{c} binary" for c in TREE)


def _matrix(a: pa.ListArray) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def _trees(table: pa.Table, classes: int) -> list[tuple[np.ndarray, ...]]:
    kinds = [np.int16, np.uint8, np.int32, np.float64]
    rows = sorted(table.to_pylist(), key=lambda r: r["tree"])
    trees = [[np.frombuffer(r[c], k) for c, k in zip(TREE, kinds)] for r in rows]
    return [(*t, values.reshape(-1, max(classes - 1, 1))) for *t, values in trees]


class GroupedForestModel(Model, MLWritable, MLReadable):
    """Adds ``rawPrediction`` (sums of the leaves' shares), ``probability`` and ``prediction``; a regression the last only."""

    classes = Param(Params._dummy(), "classes", "number of classes, 0 for a regression", TypeConverters.toInt)
    cuts = Param(Params._dummy(), "cuts", "thresholds of each feature", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, classes=0, cuts=None):
        super().__init__()
        self._set(classes=classes, cuts=[list(c) for c in cuts or []])
        self.trees: list[tuple[np.ndarray, ...]] = []
        self._held = None

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._held is None:
            self._held = df.sparkSession.sparkContext.broadcast(self.trees)
        held, cuts, classes = self._held, [np.array(c) for c in self.getOrDefault("cuts")], self.getOrDefault("classes")

        @F.arrow_udf("array<double>")
        def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known, said = np.empty(0, np.int64), np.empty((0, max(classes - 1, 1)))
            steps = paths(held.value)
            for a in batches:
                x = binned(_matrix(a), cuts)
                if (key := packed(x, cuts)) is None:
                    out = walk(steps, x)
                else:
                    key, first, back = np.unique(key, return_index=True, return_inverse=True)
                    at = np.searchsorted(known, key)
                    new = np.flatnonzero(known[np.minimum(at, len(known) - 1)] != key) if len(known) else np.arange(len(key))
                    if len(new):
                        if len(known) + len(new) > REMEMBERED:
                            known, said, at, new = known[:0], said[:0], np.zeros(len(key), np.intp), np.arange(len(key))
                        said = np.insert(said, at[new], walk(steps, x[first[new]]), axis=0)
                        known = np.insert(known, at[new], key[new])
                    out = said[np.searchsorted(known, key)][back]
                out = np.column_stack([len(steps) - out.sum(axis=1), out]) if classes else out / len(steps)
                yield pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), out.ravel())

        out = df.withColumn("_sums", sums(vector_to_array("features")))
        if not classes:
            return out.withColumn("prediction", F.col("_sums")[0]).drop("_sums")
        return out.withColumn("rawPrediction", array_to_vector("_sums")) \
            .withColumn("probability", array_to_vector(F.transform("_sums", lambda v: v / len(self.trees)))) \
            .withColumn("prediction", (F.array_position("_sums", F.array_max("_sums")) - 1).cast("double")).drop("_sums")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: GroupedForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        rows = [(i, *[a.tobytes() for a in t]) for i, t in enumerate(self.model.trees)]
        self.sparkSession.createDataFrame(rows, TREE_SCHEMA).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> GroupedForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = GroupedForestModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.trees = _trees(self.sparkSession.read.parquet(f"{path}/trees").toArrow(), model.getOrDefault("classes"))
        return model
