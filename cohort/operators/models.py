"""Pass/Fail classifiers as Spark ML pipelines.

Preparation (``prep``: exact median imputation, population-std scaling, one-hot with unseen levels as zeros) is a
stage of each pipeline, and every fold has its own statistics, all fitted in one grouped pass.  Cross-validation
and permutation importance stack their fold / repeat frames so scoring runs as one job per stage; a calibrated
model adds its members' probabilities side by side, without a join.
"""

from __future__ import annotations

import time
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.functions.exprs import col, num, is_numeric_type, is_categorical_type
from cohort.functions.labels import PASS, FAIL
from cohort.operators import metrics
from cohort.operators.forest import GroupedForest
from cohort.operators.prep import TablePrep, TablePrepModel, fit_leave_out
from cohort.operators.split import fold_assignment, class_counts, choose_cv_folds, stratified_split
from cohort.operators.ordered import previous_rows
from cohort.session import scratch_path

LABEL = "label"        # 1.0 = Pass, 0.0 = Fail
COUNT = "_rows"        # equal rows of a forest's fit
#: Rows that one task of an iterative fit reads per pass, at least where there are as many.
ROWS_PER_PART = 20_000
#: Rows of a forest's fit that one task reads per pass: at least, where there are as many, and at most.
FOREST_ROWS, FOREST_MOST_ROWS = 2_000, 200_000
#: Distinct rows times features of a forest that is grown a tree a task: the driver holds them as numbers, a task as bytes.
FOREST_CELLS = 16_000_000
# ---- fixed values (model settings) ------------------------------------------
MODEL_NAMES = {"tree": "Decision Tree Classifier", "logistic": "Logistic Regression",
               "forest": "Random Forest Classifier"}
TREE_DEPTH, TREE_MIN_LEAF = 5, 4
LOGISTIC_MAX_ITER, LOGISTIC_C = 2000, 1.0
FOREST_TREES, FOREST_MIN_LEAF, FOREST_DEPTH = 250, 2, 30  # trees grow without a limit; 30 is the library's largest depth
REGRESSOR_TREES = 200
CALIBRATION_FOLDS, CV_FOLDS, PERMUTATION_REPEATS = 3, 5, 8
# ---------------------------------------------------------------------------


def split_features(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in features if is_numeric_type(types[c])]
    categorical = [c for c in features if is_categorical_type(types[c])]
    return numeric, categorical


def classifier(kind: str, n_train: int, seed: int = 42, forest_depth: int = FOREST_DEPTH,
               trees: int = FOREST_TREES):
    if kind == "tree":
        return DecisionTreeClassifier(labelCol=LABEL, maxDepth=TREE_DEPTH, minInstancesPerNode=TREE_MIN_LEAF,
                                      seed=seed)
    if kind == "logistic":
        # C=1 on the summed loss equals regParam = 1 / (C * n) on Spark's mean loss.
        return LogisticRegression(labelCol=LABEL, maxIter=LOGISTIC_MAX_ITER, regParam=1.0 / (LOGISTIC_C * max(n_train, 1)),
                                  elasticNetParam=0.0, standardization=False)
    if kind == "forest":
        # more nodes per pass over the data (fewer passes) and cached node ids for deep trees
        return RandomForestClassifier(labelCol=LABEL, numTrees=trees, minInstancesPerNode=FOREST_MIN_LEAF,
                                      maxDepth=forest_depth, featureSubsetStrategy="sqrt", seed=seed,
                                      maxMemoryInMB=1024, cacheNodeIds=True)
    raise ValueError(kind)


def build_pipeline(kind: str, numeric, categorical, n_train: int, seed: int = 42, **kw) -> Pipeline:
    return Pipeline(stages=[TablePrep(numeric=numeric, categorical=categorical), classifier(kind, n_train, seed, **kw)])


def pass_probability(pred: DataFrame, out: str = "p") -> DataFrame:
    """Probability of the Pass class (index 1 of the probability vector)."""
    return pred.withColumn(out, vector_to_array("probability")[1])


def labelled(df: DataFrame, target, features: list[str], key: str) -> DataFrame:
    """Rows with a Pass/Fail target: key, features, label (1.0 = Pass)."""
    return (df.select(col(key).alias(key), *[col(c) for c in features], target.alias("_t"))
            .where(F.col("_t").isNotNull())
            .withColumn(LABEL, F.when(F.col("_t") == PASS, 1.0).otherwise(0.0)).drop("_t"))


def few_parts(df: DataFrame, rows: int) -> DataFrame:
    """As many partitions as the rows need at most: an iterative fit starts tasks for each of them in every pass."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_PART)))


def forest_parts(df: DataFrame, rows: int) -> DataFrame:
    """The rows of a forest's fit, dealt to all cores: in every pass a row meets each tree, so one task is too few, and a task
    sends the sums of all open nodes, so more tasks than cores only add to the shuffle, up to the rows a task can hold."""
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FOREST_ROWS)), -(-rows // FOREST_MOST_ROWS))
    return df.repartition(parts) if parts > 1 else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores before a model of many trees scores them: few bytes, so few partitions, are much work."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def scored_once(model, df: DataFrame, features: list[str]) -> DataFrame:
    """The rows with the model's ``prediction``: distinct feature rows are scored and written, and joined to all their rows."""
    path = scratch_path(df.sparkSession, f"scored-{uuid.uuid4().hex}")
    names = [f"_f{i}" for i in range(len(features))]
    distinct = df.select(*[col(c).alias(c) for c in features]).distinct()
    model.transform(spread(distinct)).select(*[col(c).alias(n) for c, n in zip(features, names)], "prediction").write.parquet(path)
    same = [col(c).eqNullSafe(F.col(n)) for c, n in zip(features, names)]
    return df.join(df.sparkSession.read.parquet(path), same, "left").drop(*names)  # its size says whether it's sent to all tasks


def fit_forest(data: DataFrame, features: list[str], prepared: TablePrepModel, library, classes: int = 0) -> PipelineModel:
    """A forest with the settings of ``library``, the library's estimator, grown on the distinct rows with their counts.

    Rows with too many distinct values for a task are left to the library's estimator itself."""
    rows, places = prepared.getOrDefault("rows"), len(prepared.getOrDefault("numeric")) + sum(map(len, prepared.getOrDefault("levels")))
    groups = data.groupBy(*[col(c).alias(c) for c in features], LABEL).agg(F.count(F.lit(1)).alias(COUNT)).persist()
    try:
        if groups.count() * places <= FOREST_CELLS:
            grown = GroupedForest(label=LABEL, count=COUNT, classes=classes, trees=library.getNumTrees(), depth=library.getMaxDepth(),
                                  least=library.getMinInstancesPerNode(), seed=library.getSeed())
            return Pipeline(stages=[prepared, grown]).fit(forest_parts(groups, rows))
    finally:
        groups.unpersist()
    return Pipeline(stages=[prepared, library]).fit(forest_parts(data, rows))


def fit(df: DataFrame, kind: str, features: list[str], seed: int = 42, prepared: TablePrepModel | None = None, **kw) -> PipelineModel:
    """Fit one pipeline; the (narrow) training frame is persisted for the duration of the fit.

    ``prepared``: a preparation fitted on these rows before, with those of other folds."""
    data = df.persist()
    try:
        prepared = prepared or TablePrep(**dict(zip(("numeric", "categorical"), split_features(df, features)))).fit(data)
        rows = prepared.getOrDefault("rows")
        model = classifier(kind, rows, seed, **kw)
        if kind == "forest" and rows > FOREST_ROWS:
            return fit_forest(data, features, prepared, model, classes=2)
        return Pipeline(stages=[prepared, model]).fit(few_parts(data, rows))
    finally:
        data.unpersist()


def platt(scores: DataFrame, score: str = "s") -> tuple[float, float]:
    """Sigmoid fit with Platt's smoothed targets as weighted duplicate rows: returns (a, b) of 1/(1+exp(-(a*s+b)))."""
    scores = scores.select(score, LABEL).persist()  # the model scores each row once
    counts = scores.agg(F.sum(LABEL).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = float(counts.pos or 0), float(counts.n - (counts.pos or 0))
    hi, lo = (pos + 1) / (pos + 2), 1 / (neg + 2)
    t = F.when(F.col(LABEL) == 1.0, hi).otherwise(lo)
    rows = scores.select(F.col(score).alias("s"), t.alias("t")).select(
        "s", F.explode(F.array(F.struct(F.lit(1.0).alias(LABEL), F.col("t").alias("w")),
                               F.struct(F.lit(0.0).alias(LABEL), (1 - F.col("t")).alias("w")))).alias("r"))
    rows = rows.select("s", "r.*")
    va = VectorAssembler(inputCols=["s"], outputCol="features")
    lr = LogisticRegression(labelCol=LABEL, weightCol="w", regParam=0.0, maxIter=200, standardization=False)
    m = lr.fit(va.transform(rows))
    scores.unpersist()
    return float(m.coefficients[0]), float(m.intercept)


def _raw_score(pred: DataFrame, kind: str) -> DataFrame:
    # sigmoid calibration uses the decision function when there is one (logistic), else the probability
    if kind == "logistic":
        return pred.withColumn("s", vector_to_array("rawPrediction")[1] - vector_to_array("rawPrediction")[0])
    return pred.withColumn("s", vector_to_array("probability")[1])


class CalibratedModel:
    """k fold models, each with its own sigmoid; probability = mean over folds."""

    def __init__(self, kind: str, members: list[tuple[PipelineModel, float, float]]):
        self.kind, self.members = kind, members

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds p (mean calibrated Pass probability).  The members run one after the other over the same rows,
        each adding its own column: no shuffle, no key."""
        out, names = df, [f"`{c}`" for c in df.columns]
        for i, (m, a, b) in enumerate(self.members):
            s = _raw_score(m.transform(out), self.kind)
            p = 1 / (1 + F.exp(-(F.lit(a) * F.col("s") + F.lit(b))))
            out = s.select(*names, *[f"__p{j}" for j in range(i)], p.alias(f"__p{i}"))
        mean = sum((F.col(f"__p{i}") for i in range(len(self.members))), F.lit(0.0)) / len(self.members)
        return out.select(*names, mean.alias("p"))


def parallel(fn, items, workers: int = 4):
    """Independent fits submitted as concurrent Spark jobs (as CrossValidator's parallelism does)."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(items)))) as pool:
        return list(pool.map(fn, items))


def deal(train: DataFrame, features: list[str], key: str, folds: int, seed: int = 42) -> tuple[DataFrame, list[TablePrepModel]]:
    """The rows with their folds, cached, and the preparations fitted without each fold: no model changes them."""
    assigned = fold_assignment(train, LABEL, col(key), folds, seed).cache()
    return assigned, fit_leave_out(assigned, *split_features(train, features), "fold", folds)


def calibrate_sigmoid(train: DataFrame, kind: str, features: list[str], key: str, folds: int = CALIBRATION_FOLDS,
                      seed: int = 42, dealt: tuple | None = None, **kw) -> CalibratedModel:
    """``dealt``: what ``deal`` returned for these rows and folds, which the caller releases."""
    assigned, prepared = dealt or deal(train, features, key, folds, seed)

    def member(k):
        m = fit(assigned.where(F.col("fold") != k).drop("fold"), kind, features, seed, prepared[k], **kw)
        a, b = platt(_raw_score(m.transform(assigned.where(F.col("fold") == k).drop("fold")), kind))
        return m, a, b

    members = parallel(member, range(folds))
    if not dealt:
        assigned.unpersist()
    return CalibratedModel(kind, members)


def fold_metrics(pred: DataFrame, group: list[str]) -> DataFrame:
    """Threshold metrics per group (fold / feature-repeat) in one aggregate; pred has label, yhat, p."""
    y, yh = F.col(LABEL), F.col("yhat")
    tp = F.count_if((y == 1) & (yh == 1))
    fp = F.count_if((y == 0) & (yh == 1))
    fn = F.count_if((y == 1) & (yh == 0))
    tn = F.count_if((y == 0) & (yh == 0))
    q = F.least(F.greatest(F.col("p"), F.lit(metrics.EPS)), F.lit(1 - metrics.EPS))
    out = pred.groupBy(*group).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
                                   F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
                                   F.avg(F.pow(y - F.col("p"), 2)).alias("brier"))
    r = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return out.select(*group, r(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"),
                      r(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                      r(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                      r(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
                      "log_loss", "brier")


def cross_validate(train: DataFrame, kind: str, features: list[str], key: str, folds: int = CV_FOLDS,
                   seed: int = 42, dealt: tuple | None = None, **kw) -> DataFrame:
    """(metric, mean, std) over stratified folds; std is the population std.

    ``dealt``: what ``deal`` returned for these rows and as many folds as the classes allow, which the caller releases."""
    counts = class_counts(train, LABEL)
    k = choose_cv_folds(counts, folds)
    spark = train.sparkSession
    if k is None:
        return spark.createDataFrame([], "metric string, mean double, std double")
    assigned, prepared = dealt or deal(train, features, key, k, seed)

    def one_fold(i):
        t0 = time.time()
        m = fit(assigned.where(F.col("fold") != i).drop("fold"), kind, features, seed, prepared[i], **kw)
        elapsed = time.time() - t0
        # materialise the held-out scores so the fold model can be released right away
        t1 = time.time()
        held = pass_probability(m.transform(assigned.where(F.col("fold") == i))).select(
            "fold", LABEL, "p", F.col("prediction").alias("yhat")).persist()
        held.count()
        return held, elapsed, time.time() - t1

    fitted = parallel(one_fold, range(k))
    times = [t for _, t, _ in fitted]
    score_times = [t for _, _, t in fitted]
    preds = [h for h, _, _ in fitted]
    stacked = preds[0]
    for p in preds[1:]:
        stacked = stacked.unionByName(p)
    stacked = stacked.cache()
    per_fold = fold_metrics(stacked, ["fold"])
    aucs = [r.roc_auc for r in metrics.roc_auc(stacked, LABEL, "p", ["fold"]).collect()]  # k rows
    aps = [r.average_precision for r in metrics.average_precision(stacked, LABEL, "p", ["fold"]).collect()]
    names = [("accuracy", "Accuracy"), ("precision", "Precision"), ("recall", "Recall"), ("f1", "F1-score")]
    rows = per_fold.agg(*[F.avg(c).alias(f"{c}_m") for c, _ in names + [("log_loss", ""), ("brier", "")]],
                        *[F.stddev_pop(c).alias(f"{c}_s") for c, _ in names + [("log_loss", ""), ("brier", "")]]).first()
    import statistics as st
    out = [(label, rows[f"{c}_m"], rows[f"{c}_s"]) for c, label in names]
    out += [("ROC-AUC", st.fmean(aucs), st.pstdev(aucs)), ("PR-AUC", st.fmean(aps), st.pstdev(aps)),
            ("Log Loss", rows["log_loss_m"], rows["log_loss_s"]), ("Brier Score", rows["brier_m"], rows["brier_s"]),
            ("Fit Time (s)", st.fmean(times), st.pstdev(times)),
            ("Score Time (s)", st.fmean(score_times), st.pstdev(score_times))]
    stacked.unpersist()
    for h in preds:
        h.unpersist()
    if not dealt:
        assigned.unpersist()
    return spark.createDataFrame([(a, float(b), float(c)) for a, b, c in out], "metric string, mean double, std double")


def donors(test: DataFrame, features: list[str], key: str, repeats: int = PERMUTATION_REPEATS, seed: int = 42) -> DataFrame:
    """The rows of each repeat with the values of the row before: no model changes them.  A row's repeats are in one partition,
    where a forest scores what they have in common once."""
    base = test.select(col(key).alias(key), *[col(c) for c in features], LABEL)
    reps = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("r")).withColumn("_h", F.xxhash64(F.lit(seed), F.col("r"), col(key)))
    donated = previous_rows(reps, "_h", features, ["r"], ties=[key, LABEL, *features])
    return donated.repartition(2 * test.sparkSession.sparkContext.defaultParallelism, col(key), *[col(c) for c in features])


def permutation_importance(model, test: DataFrame, features: list[str], key: str, repeats: int = PERMUTATION_REPEATS,
                           seed: int = 42, donated: DataFrame | None = None) -> DataFrame:
    """Mean / std drop in holdout F1 when one feature's values are shuffled, largest first (ties: name).

    Each repeat r orders the holdout rows by a seeded hash (rows with equal keys by their values), and the row before
    a row, or the last one for the first, gives it its values: one range shuffle for all repeats and features, no
    join of rows.  A copy for feature j takes only j's value from the donor; all copies are scored in one job.
    ``donated``: what ``donors`` returned for these rows.
    """
    base = test.select(col(key).alias(key), *[col(c) for c in features], LABEL)
    spark = test.sparkSession
    donated = donated or donors(test, features, key, repeats, seed)
    copies = donated.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("j"))
    mixed = [F.when(F.col("j") == j, F.col(f"_previous.`{c}`")).otherwise(col(c)).alias(c) for j, c in enumerate(features)]
    scored = _predict(model, copies.select(col(key), *mixed, LABEL, "r", "j"))
    f1s = fold_metrics(scored, ["j", "r"]).select("j", "r", "f1")
    base_f1 = fold_metrics(_predict(model, base.withColumn("j", F.lit(-1))), ["j"]).first()["f1"]
    names = spark.createDataFrame([(j, f) for j, f in enumerate(features)], "j int, feature string")
    imp = f1s.groupBy("j").agg(F.avg(F.lit(base_f1) - F.col("f1")).alias("importance"),
                               F.stddev_pop(F.lit(base_f1) - F.col("f1")).alias("importance_std"))
    out = names.join(imp, "j").select("feature", "importance", "importance_std").orderBy(F.desc("importance"), "feature")
    return spark.createDataFrame(out.collect(), out.schema)  # one row per feature


def _predict(model, df: DataFrame) -> DataFrame:
    """label, yhat, p for a fitted pipeline or calibrated model."""
    if isinstance(model, CalibratedModel):
        out = model.transform(df)
        return out.withColumn("yhat", (F.col("p") >= 0.5).cast("double"))
    out = pass_probability(model.transform(df))
    return out.withColumn("yhat", F.col("prediction"))


def sanitize_features(features: list[str], target: str | None, target_scores: list[str]) -> tuple[list, list]:
    """Drop the target and the score columns that define it; de-duplicate."""
    leak = set(target_scores) | ({target} if target else set())
    kept, removed = [], []
    for c in features:
        if c in leak:
            removed.append(c)
        elif c not in kept:
            kept.append(c)
    return kept, removed


def holdout_predictions(model, test: DataFrame, key: str) -> DataFrame:
    return _predict(model, test).select(key, LABEL, "yhat", "p")


def evaluate(pred: DataFrame, name: str) -> dict:
    """Holdout metrics for one model (threshold metrics in one aggregate + AUC + AP)."""
    row = fold_metrics(pred.withColumn("g", F.lit(0)), ["g"]).first()
    auc = metrics.roc_auc(pred, LABEL, "p").first()[0]
    ap = metrics.average_precision(pred, LABEL, "p").first()[0]
    return {"model": name, "accuracy": row.accuracy, "precision": row.precision, "recall": row.recall,
            "f1": row.f1, "roc_auc": auc, "pr_auc": ap, "log_loss": row.log_loss, "brier": row.brier}


METRIC_SCHEMA = ("model string, accuracy double, precision double, recall double, f1 double, roc_auc double, "
                 "pr_auc double, log_loss double, brier double, cv_accuracy double, cv_accuracy_std double, "
                 "cv_f1 double, cv_f1_std double, cv_roc_auc double, cv_roc_auc_std double")


def train_all(df: DataFrame, target, features: list[str], key: str, kinds=("tree", "logistic", "forest"),
              test_size: float = 0.3, seed: int = 42, cv_folds: int = CV_FOLDS, calibration: bool = True,
              importance: bool = True, target_column: str | None = None, target_scores: list[str] | None = None, **kw) -> dict:
    """Split, cross-validate, calibrate, evaluate and explain each model, all models at the same time.

    Features that define the target (its column, or the scores it is derived from) are removed first.
    Returns frames: metrics (one row per model), cv, importance, predictions; and the kept and removed features.
    """
    spark = df.sparkSession
    features, removed = sanitize_features(features, target_column, target_scores or [])
    if not features:
        raise ValueError("No feature is left once those that define the target are removed.")
    data = labelled(df, target, features, key)
    numeric, categorical = split_features(data, features)
    feats = numeric + categorical
    split = stratified_split(data, LABEL, col(key), test_size, seed).cache()
    train = split.where(~F.col("is_test")).drop("is_test").cache()
    test = split.where(F.col("is_test")).drop("is_test").cache()
    counts = class_counts(train, LABEL)
    minority = min(counts.values()) if counts else 0
    cal_folds = min(CALIBRATION_FOLDS, minority) if minority >= 2 else None
    # what the models share is made once
    k = choose_cv_folds(counts, cv_folds) if cv_folds else None
    calibrated = calibration and cal_folds and cal_folds >= 2
    made = parallel(lambda f: f(), [lambda: deal(train, feats, key, k, seed) if k else None,
                                    lambda: deal(train, feats, key, cal_folds, seed) if calibrated and cal_folds != k else None,
                                    lambda: donors(test, feats, key, seed=seed) if importance else None])
    for_cv, for_calibration, donated = made[0], made[1] or made[0], made[2]

    def one_kind(kind):
        name = MODEL_NAMES[kind]
        cv = cross_validate(train, kind, feats, key, cv_folds, seed, for_cv, **kw) if cv_folds else \
            spark.createDataFrame([], "metric string, mean double, std double")
        cv_rows = {r.metric: (r.mean, r.std) for r in cv.collect()}
        if calibrated:
            model = calibrate_sigmoid(train, kind, feats, key, cal_folds, seed, for_calibration, **kw)
        else:
            model = fit(train, kind, feats, seed, **kw)
        pred = holdout_predictions(model, test, key).cache()
        m = evaluate(pred, name)
        for metric, short in [("Accuracy", "cv_accuracy"), ("F1-score", "cv_f1"), ("ROC-AUC", "cv_roc_auc")]:
            mean, std = cv_rows.get(metric, (None, None))
            m[short], m[short + "_std"] = mean, std
        imp = permutation_importance(model, test, feats, key, seed=seed, donated=donated) if importance else None
        return name, m, cv, imp, pred

    trained = parallel(one_kind, kinds)  # the short jobs of the small models fill the gaps between the forests' passes
    out = {"metrics": spark.createDataFrame([tuple(m.get(c) for c in [f.split()[0] for f in METRIC_SCHEMA.split(", ")])
                                             for _, m, _, _, _ in trained], METRIC_SCHEMA)}
    out["kept_features"], out["removed_features"] = feats, removed
    out["cv"] = _union([cv.withColumn("model", F.lit(name)) for name, _, cv, _, _ in trained])
    out["importance"] = _union([imp.withColumn("model", F.lit(name)) for name, _, _, imp, _ in trained]) if importance else None
    out["predictions"] = _union([pred.withColumn("model", F.lit(name)) for name, _, _, _, pred in trained])
    out["train_rows"], out["test_rows"] = train.count(), test.count()
    for frame in [split, train, test, *[d[0] for d in made[:2] if d], *[pred for *_, pred in trained]]:
        frame.unpersist()
    return out


def _union(frames):
    acc = frames[0]
    for f in frames[1:]:
        acc = acc.unionByName(f)
    return acc


def model_ranking(metrics_table: DataFrame) -> DataFrame:
    """Best holdout model by (F1, accuracy), lowest Brier, best CV F1."""
    return metrics_table.agg(
        F.max_by("model", F.struct("f1", "accuracy")).alias("best_holdout"),
        F.min_by("model", F.coalesce(F.col("brier"), F.lit(float("inf")))).alias("best_calibrated"),
        F.max_by("model", F.col("cv_f1")).alias("best_cv"))


def top_features(importance: DataFrame, n: int = 5) -> DataFrame:
    """Top n features per model by importance (ties: feature name)."""
    from pyspark.sql import Window
    w = Window.partitionBy("model").orderBy(F.desc("importance"), F.asc("feature"))
    return importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# ---- regression on the average score ------------------------------------------
def train_forest_regressor(df: DataFrame, features: list[str], target: str, key: str, test_size: float = 0.25,
                           trees: int = REGRESSOR_TREES, seed: int = 42):
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.evaluation import RegressionEvaluator
    numeric, categorical = split_features(df, features)
    data = df.select(col(key).alias(key), *[col(c) for c in features], num(df, target).alias(LABEL)) \
        .where(F.col(LABEL).isNotNull())
    h = (F.abs(F.xxhash64(F.lit(seed), col(key))) % 1000000) / 1000000.0
    data = data.withColumn("is_test", h < test_size)
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    train = train.persist()
    prepared = TablePrep(numeric=numeric, categorical=categorical).fit(train)
    library = RandomForestRegressor(labelCol=LABEL, numTrees=trees, seed=seed, maxDepth=FOREST_DEPTH, maxMemoryInMB=1024, cacheNodeIds=True)
    many = prepared.getOrDefault("rows") > FOREST_ROWS
    model = fit_forest(train, features, prepared, library) if many else Pipeline(stages=[prepared, library]).fit(train)
    train.unpersist()
    path = scratch_path(df.sparkSession, f"forest-{uuid.uuid4().hex}")  # scored once, for both metrics and the caller
    scored_once(model, test, features).select(key, LABEL, "prediction").write.parquet(path)
    pred = df.sparkSession.read.parquet(path)
    mae = RegressionEvaluator(labelCol=LABEL, metricName="mae").evaluate(pred)
    r2 = RegressionEvaluator(labelCol=LABEL, metricName="r2").evaluate(pred)
    return model, pred, {"mae": mae, "r2": r2}


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except Exception as e:  # missing or unreadable path
        raise FileNotFoundError(f"Model file not found: {path}") from e
