"""Joining predictions with labels that arrive later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import is_correct
from driftline.schemas import KEY, PREDICTION_COLUMNS
from driftline.session import materialise


def _extreme_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    """Row with the largest or smallest `order` per key.

    An aggregate, not a window: each task first reduces its own rows, so a key sent many times over
    reaches the shuffle once per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key; null keys are dropped. Equal `order` values fall back on the other columns."""
    return _extreme_per_key(df.dropna(subset=list(keys)), keys, order, F.max)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key; null keys are dropped."""
    return _extreme_per_key(df.dropna(subset=list(keys)), keys, order, F.min)


def latest_label(labels: DataFrame, key: str = KEY, arrival: str = "label_arrival_time") -> DataFrame:
    """The label that counts for each key: the one that came last."""
    return latest_per_key(labels, [key], [arrival])


def join_labels(predictions: DataFrame, labels: DataFrame, key: str = KEY) -> DataFrame:
    """Labelled predictions with `is_correct`; labels have one row per key."""
    joined = predictions.drop("true_label", "label_arrival_time").join(_stored(labels, key), key)
    return joined.withColumnRenamed("label", "true_label").withColumn(
        "is_correct", is_correct(F.col("predicted_label"), F.col("true_label"))
    )


def _stored(df: DataFrame, key: str) -> DataFrame:
    """One row per key, stored. Both sides of a join are then plain shuffles, so that the rows of a hot key on the
    other side can be split over several tasks, which an aggregate between shuffle and join would rule out."""
    return materialise(df.filter(F.col(key).isNotNull()), "keys")


def _keys(df: DataFrame, key: str) -> DataFrame:
    """Keys once each: repeats are dropped before the shuffle."""
    return _stored(df.select(key).distinct(), key)


def _unmatched(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among `keys`. Null keys match nothing and take no part in the shuffle."""
    known = df.filter(F.col(key).isNotNull()).join(keys, key, "left_anti")
    return known.unionByName(df.filter(F.col(key).isNull()))


def orphan_labels(predictions: DataFrame, labels: DataFrame, key: str = KEY) -> DataFrame:
    """Labels no prediction has (yet)."""
    return _unmatched(labels, _keys(predictions, key), key)


def pending_predictions(predictions: DataFrame, labels: DataFrame, key: str = KEY) -> DataFrame:
    """Predictions whose label has not come."""
    return _unmatched(predictions, _keys(labels, key), key)


def prediction_view(predictions: DataFrame, label_log: DataFrame, key: str = KEY) -> DataFrame:
    """Prediction table with the labels written back.

    Labels are only ever appended to their log; this join takes the place of row updates.
    """
    labels = _stored(latest_label(label_log, key).withColumnRenamed("label", "true_label"), key)
    bare = predictions.drop("true_label", "label_arrival_time")
    joined = bare.filter(F.col(key).isNotNull()).join(labels, key, "left")
    joined = joined.unionByName(bare.filter(F.col(key).isNull()), allowMissingColumns=True)
    return joined.select(*[c for c in PREDICTION_COLUMNS if c in {*bare.columns, *labels.columns}])


def attach_by_key(left: DataFrame, right: DataFrame, key: str = KEY, order: Sequence[str] | None = None) -> DataFrame:
    """Each row of `left` with the columns of the first row of `right` with its key.

    Repeated keys on the right do not multiply rows, and null keys match nothing.
    """
    first = first_per_key(right, [key], order or [c for c in right.columns if c != key])
    return left.join(_stored(first, key), key)
