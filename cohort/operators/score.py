"""Scoring a table of requests with a fitted model: label, both probabilities,
confidence, risk level and recommendation; invalid requests go to a second frame."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.functions.labels import PASS, FAIL, risk_level, recommendation, confidence_band, derive_target
from cohort.operators import clean
from cohort.operators.models import LABEL, LOGISTIC_C
from cohort.operators.prep import TablePrep

FORM = clean.FORM_FEATURES


def train_scoring_model(features: DataFrame, target) -> tuple:
    """Logistic model on the five form features (median imputation + scaling inside the pipeline)."""
    data = features.select(*FORM, target.alias("_t")).where(F.col("_t").isNotNull()) \
        .withColumn(LABEL, F.when(F.col("_t") == PASS, 1.0).otherwise(0.0)).drop("_t")
    # iterative fitting reads the narrow training projection several times: persist it once
    data = data.persist()
    try:
        n = data.count()
        lr = LogisticRegression(labelCol=LABEL, maxIter=1000, regParam=1.0 / (LOGISTIC_C * max(n, 1)),
                                elasticNetParam=0.0, standardization=False)
        return Pipeline(stages=[TablePrep(numeric=FORM, categorical=[]), lr]).fit(data), n
    finally:
        data.unpersist()


def add_outputs(pred: DataFrame, p_col: str = "pass_probability") -> DataFrame:
    label = F.when(F.col(p_col) >= 0.5, F.lit(PASS)).otherwise(F.lit(FAIL))
    out = pred.withColumn("predicted_label", label) \
        .withColumn("fail_probability", 1 - F.col(p_col)) \
        .withColumn("confidence", F.greatest(F.col(p_col), F.col("fail_probability"))) \
        .withColumn("risk_level", risk_level(F.col(p_col)))
    return out.withColumn("recommendation", recommendation(
        F.col("predicted_label"), F.col("risk_level"), F.col("study_time"), F.col("absences"), F.col("failures"),
        (F.col("previous_grade_1") + F.col("previous_grade_2")) / 2)) \
        .withColumn("confidence_note", confidence_band(F.col(p_col), F.col("fail_probability")))


OUTPUTS = ["pass_probability", "predicted_label", "fail_probability", "confidence", "risk_level", "recommendation",
           "confidence_note"]


def with_rejects(scored: DataFrame, rejected: DataFrame) -> DataFrame:
    """Every request once: scored ones with null ``errors``, rejected ones with null outputs and their errors."""
    kinds = {f.name: f.dataType for f in scored.schema.fields}
    rest = rejected.select(*[F.lit(None).cast(kinds[c]).alias(c) if c in OUTPUTS else F.col(c).cast(kinds[c]).alias(c) for c in scored.columns],
                           F.array_join("errors", "; ").alias("errors"))
    return scored.withColumn("errors", F.lit(None).cast("string")).unionByName(rest)


def score_table(model, requests: DataFrame, keep: list[str], limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected): requests failing the input check never reach the model; ``with_rejects`` joins them."""
    checked = clean.scoring_input_check(requests, limits)
    valid = checked.where(F.size("errors") == 0).drop("errors")
    rejected = checked.where(F.size("errors") > 0)
    pred = model.transform(valid.select(*keep, *[F.col(c).cast("double").alias(c) for c in FORM]))
    pred = pred.withColumn("pass_probability", vector_to_array("probability")[1])
    cols = keep + FORM + ["pass_probability"]
    return add_outputs(pred.select(*cols)), rejected


def score_linear(requests: DataFrame, weights: dict, intercept: float, centre: dict, scale: dict) -> DataFrame:
    """The logistic scoring expression with literal coefficients (checkable without a model)."""
    z = F.lit(float(intercept))
    for f, w in weights.items():
        x = (F.col(f) - F.lit(float(centre.get(f, 0.0)))) / F.lit(float(scale.get(f, 1.0) or 1.0))
        z = z + F.lit(float(w)) * x
    return add_outputs(requests.withColumn("pass_probability", 1 / (1 + F.exp(-z))))
