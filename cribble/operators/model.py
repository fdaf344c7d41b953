"""The classifier: training, scoring into tiers, evaluation, persistence."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cribble import settings as S
from cribble.operators.evaluate import class_weights, classification_report, roc_auc
from cribble.operators.labels import tier

# Functions that run in tasks travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# About 60 MB of 389 doubles; a larger input keeps its own, finer partitioning.
ROWS_PER_PARTITION = 20_000
# Sums of this many partitions are added in one task, level by level.
FAN_IN = 32


@dataclass(frozen=True)
class Classifier:
    """A linear model of the positive class."""

    coefficients: tuple[float, ...]
    intercept: float

    def margin(self, features: Column) -> Column:
        """Weights times a vector column, plus the intercept; null where the vector is."""
        products = F.zip_with(vector_to_array(features), F.lit(list(self.coefficients)), lambda x, w: x * w)
        return F.aggregate(products, F.lit(float(self.intercept)), lambda total, x: total + x)


def _sums(weights: np.ndarray):
    """Per partition: the weighted loss, its gradient and its Hessian at ``weights`` (intercept last)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(weights)
        loss, gradient, hessian = 0.0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if not len(batch):
                continue
            y, w = batch.column("label").to_numpy(), batch.column("weight").to_numpy()
            x = np.ones((len(batch), d))
            x[:, :-1] = batch.column("features").flatten().to_numpy().reshape(len(batch), d - 1)
            z = x @ weights
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700.0, 700.0)))
            loss += float(w @ np.logaddexp(0.0, np.where(y > 0, -z, z)))
            gradient += x.T @ (w * (p - y))
            hessian += (x * (w * p * (1.0 - p))[:, None]).T @ x
        flat = np.concatenate([[loss], gradient, hessian.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], names=["sums"])

    return add


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0.0
    for batch in batches:
        for row in batch.column("sums"):
            total = total + row.values.to_numpy()
    if not np.isscalar(total):
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])


def _moments(rows: DataFrame, weights: np.ndarray, c: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Objective, gradient and Hessian over all rows, with the penalty.

    One row of ``(d + 1) ** 2`` numbers per partition, added up by a tree of tasks; the driver
    gets one row. Its size follows the number of features, not of rows.
    """
    parts = rows.rdd.getNumPartitions()
    found = rows.mapInArrow(_sums(weights), "sums array<double>")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        found = found.repartition(parts).mapInArrow(_add, "sums array<double>")
    sums = np.array(found.first()["sums"])
    d, free = len(weights), np.append(weights[:-1], 0.0)
    hessian = sums[1 + d:].reshape(d, d) + np.diag(np.append(np.full(d - 1, 1.0 / c), 0.0))
    return sums[0] + float(free @ free) / (2 * c), sums[1:1 + d] + free / c, hessian


def train_classifier(
    rows: DataFrame, label: str = "label", features: str = "features",
    c: float = 1.0, max_iter: int = 100, tol: float = 1e-6,
) -> Classifier:
    """L2 logistic regression with balanced class weights, by reweighted least squares.

    Minimizes the summed weighted loss plus ``|w|^2 / (2c)`` with a free intercept. Each step is
    Newton's: one pass sums the Hessian (features squared, whatever the number of rows), the driver
    solves it, and a step that would not lower the objective is halved. It ends once a step
    moves no weight by ``tol``; the error is then about its square.

    ``label`` is 0 or 1, both must occur; rows without label or features are left out.
    """
    slim = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(
        F.col(label).cast("double").alias("label"), vector_to_array(features).alias("features"))
    cached = slim.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # One row per class.
        balance = {r["label"]: r for r in class_weights(cached).collect()}
        if set(balance) != {0.0, 1.0}:
            raise ValueError(f"training needs labels 0 and 1, got {sorted(balance)}")
        n = sum(r["n"] for r in balance.values())
        weight = F.when(F.col("label") > 0, balance[1.0]["weight"]).otherwise(balance[0.0]["weight"])
        # Every step is a job over these partitions: none should be tiny.
        weighted = cached.withColumn("weight", weight).coalesce(-(-n // ROWS_PER_PARTITION))
        at = np.zeros(len(cached.first()["features"]) + 1)
        objective, gradient, hessian = _moments(weighted, at, c)
        for _ in range(max_iter):
            step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            while True:
                tried = _moments(weighted, at - step, c)
                if tried[0] <= objective * (1 + 1e-12) or np.abs(step).max() < tol:
                    break
                step = step / 2
            at = at - step
            objective, gradient, hessian = tried
            if np.abs(step).max() < tol:
                break
        return Classifier(tuple(float(w) for w in at[:-1]), float(at[-1]))
    finally:
        cached.unpersist()


def predict(rows: DataFrame, model: Classifier) -> DataFrame:
    """Add ``model_probability`` of the positive class and the 0/1 ``prediction``.

    Rows without features score as if all were 0; ``score_and_tier`` sets them apart.
    """
    zeros = array_to_vector(F.array_repeat(F.lit(0.0), len(model.coefficients)))
    p = 1.0 / (1.0 + F.exp(-model.margin(F.col("features"))))
    return rows.withColumn("features", F.coalesce("features", zeros)).withColumn(
        "model_probability", p
    ).withColumn("prediction", (F.col("model_probability") > 0.5).cast("int"))


def score_and_tier(
    rows: DataFrame, model: Classifier,
    thresholds: S.Thresholds = S.Thresholds(),
) -> DataFrame:
    """Add ``tier, tier_error, model_probability, reason, reject_stage`` to feature rows.

    A row without text or features becomes ERROR_SCORING instead of failing the
    job. A ``has_text`` column stands in for the text, which then need not be
    carried through joins. The probability is kept for every tier; only rejects carry the reason.
    """
    no_text = ~F.col("has_text") if "has_text" in rows.columns else F.col("text").isNull()
    bad = F.col("_bad")
    p = F.when(~bad, F.col("model_probability"))
    status = F.when(bad, S.ERROR_SCORING).otherwise(
        tier(p, thresholds.potential, thresholds.borderline)
    )
    rejected = status == S.REJECTED
    marked = rows.withColumn("_bad", no_text | F.col("features").isNull())
    return predict(marked, model).withColumns({
        "tier": status,
        "tier_error": F.when(no_text, S.MISSING_TRANSCRIPT_MESSAGE).when(
            bad, S.MISSING_FEATURES_MESSAGE
        ),
        "reason": F.when(rejected, F.struct("model_probability", "diagnostics")),
        "reject_stage": F.when(rejected, "model"),
    }).withColumn("model_probability", p).drop("_bad")


def apply_scores(
    rows: DataFrame, model: Classifier, now,
    thresholds: S.Thresholds = S.Thresholds(),
) -> DataFrame:
    """Queue rows with features, moved to their tier; a reject keeps its ``error_msg``."""
    stamp = now if isinstance(now, Column) else F.lit(now)
    rejected = F.col("tier") == S.REJECTED
    return score_and_tier(rows, model, thresholds).withColumns({
        "status": F.col("tier"),
        "error_msg": F.when(rejected, F.col("error_msg")).otherwise(F.col("tier_error")),
        "rejection_reason": F.when(rejected, F.col("reason")).otherwise(
            F.col("rejection_reason")
        ),
        "last_update_at": stamp,
    })


def evaluate(rows: DataFrame, model: Classifier, label: str = "label"):
    """Classification report and ROC-AUC of the model on held-out rows."""
    scored = predict(rows, model).select(label, "prediction", "model_probability")
    return classification_report(scored, label), roc_auc(scored, label, "model_probability")


def save_model(model: Classifier, path: str) -> None:
    """One row of Parquet, replacing a model that is there."""
    spark = SparkSession.active()
    row = [(list(model.coefficients), model.intercept)]
    spark.createDataFrame(row, "coefficients array<double>, intercept double").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(path: str) -> Classifier:
    """Raises when there is no model at ``path``."""
    try:
        row = SparkSession.active().read.parquet(path).select("coefficients", "intercept").first()
    except AnalysisException as e:
        raise FileNotFoundError(f"no trained model at {path}; train one first") from e
    if row is None:
        raise FileNotFoundError(f"no trained model at {path}; train one first")
    return Classifier(tuple(row["coefficients"]), row["intercept"])
