"""Fitting, scoring and the rows written for predictions."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.columns import decode_prediction, margin
from driftline.operators.scan import prefix_scan
from driftline.schemas import FEATURES, PREDICTION_COLUMNS


def feature_vector(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """`df` with its features as one vector column; rows with a missing feature are skipped."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def fit(df: DataFrame, label: str = "label", features: Sequence[str] = FEATURES) -> LogisticRegressionModel:
    """Logistic regression with default parameters."""
    return LogisticRegression(featuresCol="features", labelCol=label).fit(
        feature_vector(df, features).select("features", label)
    )


CELL_LENGTH = 8192


class LinearModel(NamedTuple):
    """What scoring needs to know of a binary model."""

    weights: tuple[float, ...]
    intercept: float
    threshold: float = 0.5

    @classmethod
    def of(cls, model: LogisticRegressionModel) -> LinearModel:
        return cls(tuple(model.coefficients.toArray().tolist()), model.intercept, model.getThreshold())


def save_model(spark: SparkSession, model: LinearModel, path: str) -> None:
    """A model with given weights, in the format that fitted ones are saved in."""
    jvm = spark.sparkContext._jvm.org.apache.spark.ml
    weights = jvm.linalg.Vectors.dense(_doubles(spark, model.weights))
    fitted = jvm.classification.LogisticRegressionModel(f"given_{uuid.uuid4().hex}", weights, float(model.intercept))
    LogisticRegressionModel(fitted).setThreshold(model.threshold).write().save(path)


def _doubles(spark: SparkSession, values: Sequence[float]):
    gateway = spark.sparkContext._gateway
    array = gateway.new_array(gateway.jvm.double, len(values))
    for i, v in enumerate(values):
        array[i] = float(v)
    return array


def score(df: DataFrame, model: LinearModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """`df` with `prediction` 0.0 or 1.0, by plain arithmetic on the feature columns.

    All columns stay, so nothing has to be joined back.
    """
    # Chance above a threshold of 0 is certain, above 1 impossible.
    t = model.threshold
    cut = -math.inf if t <= 0 else math.inf if t >= 1 else math.log(t / (1 - t))
    return df.withColumn("prediction", (margin(model.weights, model.intercept, features) > cut).cast("double"))


def prediction_rows(scored: DataFrame, version: str | Column, clock: Column | None = None) -> DataFrame:
    """Rows of the prediction table: labels still missing, stamped with time and model version."""
    version = F.lit(version) if isinstance(version, str) else version
    return scored.withColumns(
        {
            "predicted_label": decode_prediction(F.col("prediction")),
            "true_label": F.lit(None).cast("string"),
            "prediction_time": F.current_timestamp() if clock is None else clock,
            "label_arrival_time": F.lit(None).cast("timestamp"),
            "model_version": version,
        }
    ).select(*PREDICTION_COLUMNS)


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Rows, and the share of them predicted right."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"),
    )


def prequential_accuracy(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ok: str, last: int | None = None
) -> DataFrame:
    """Running share of correct predictions, over all rows so far or over the `last` ones."""
    keys = list(keys)
    ones = F.when(F.col(ok), 1).otherwise(0)
    run = prefix_scan(df, keys, order, {"correct": ones})
    if last is None:
        return run.withColumn("accuracy", F.col("correct") / F.col("pos"))
    # Cells of positions, each with the `last` rows before it, so that looking back never leaves a cell.
    length = max(CELL_LENGTH, 4 * last)
    own = F.expr(f"(pos - 1) div {length}")
    cells = run.withColumn("_cell", F.explode(F.sequence(own, F.expr(f"(pos - 1 + {last}) div {length}"))))
    back = Window.partitionBy(*keys, "_cell").orderBy("pos")
    recent = F.col("correct") - F.coalesce(F.lag("correct", last).over(back), F.lit(0))
    looked = cells.withColumn("_recent", recent).filter(F.col("_cell") == own)
    return looked.select(*run.columns, (F.col("_recent") / F.least("pos", F.lit(last))).alias("accuracy"))
