"""Joining a prediction stream with a label stream that trails it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import is_correct
from driftline.operators.labels import orphan_labels
from driftline.schemas import KEY
from driftline.session import materialise


def _first_of_chunk(chunks: Iterator[pa.RecordBatch], key: str, time: str) -> Iterator[pa.RecordBatch]:
    for chunk in chunks:
        names = [time, *(c for c in chunk.schema.names if c not in (key, time) and not pa.types.is_nested(chunk.schema.field(c).type))]
        order = pa.compute.sort_indices(pa.Table.from_batches([chunk]), [(c, "ascending") for c in names])
        chunk = chunk.take(order)
        places = pa.table({"key": chunk.column(key), "place": np.arange(chunk.num_rows)})
        first = places.group_by("key").aggregate([("place", "min")]).column("place_min")
        yield chunk.take(first.combine_chunks())


def once_per_key(stream: DataFrame, time: str, delay: str, key: str = KEY) -> DataFrame:
    """First row of each key; repeats within `delay` are dropped, later state is forgotten.

    The state is partitioned by key, so repeats are first dropped inside each chunk of a task: a key sent
    over and over reaches its state task a few times only; the earliest one stays, whatever their order there.
    """
    few = stream.mapInArrow(lambda chunks: _first_of_chunk(chunks, key, time), stream.schema)
    return few.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def join_late_labels(
    predictions: DataFrame,
    labels: DataFrame,
    wait: str,
    delay: str = "10 minutes",
    key: str = KEY,
    predicted_at: str = "prediction_time",
    arrived_at: str = "label_arrival_time",
    how: str = "inner",
    once: bool = False,
) -> DataFrame:
    """Predictions with the label that comes at most `wait` after them.

    Both sides are held in state until the wait is over, so a label may also come before its
    prediction is read. `left_outer` adds predictions whose wait ended without a label, `full_outer`
    also labels whose prediction never came. With `once` only the first row of a key
    counts on either side, which also keeps a key sent over and over from filling one task. Both time
    columns must be timestamps.
    """
    left = predictions.drop("true_label", arrived_at)
    right = labels.select(F.col(key).alias("_label_key"), F.col("label").alias("true_label"), arrived_at)
    if once:
        left = once_per_key(left, predicted_at, delay, key)
        right = once_per_key(right, arrived_at, delay, "_label_key")
    else:
        left, right = left.withWatermark(predicted_at, delay), right.withWatermark(arrived_at, delay)
    due = F.expr(f"{arrived_at} >= {predicted_at} AND {arrived_at} <= {predicted_at} + INTERVAL {wait}")
    joined = left.join(right, (F.col(key) == F.col("_label_key")) & due, how)
    return joined.withColumn(key, F.coalesce(key, "_label_key")).drop("_label_key").withColumn(
        "is_correct", F.when(F.col("true_label").isNotNull(), is_correct(F.col("predicted_label"), F.col("true_label")))
    )


class Settled(NamedTuple):
    """`added` and `gone` are what becomes of the waiting rows: new ones, and keys whose earlier ones go."""

    labelled: DataFrame
    pending: DataFrame
    orphans: DataFrame
    added_pending: DataFrame
    gone_pending: DataFrame
    added_orphans: DataFrame
    gone_orphans: DataFrame


def _marked(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """Rows of a batch and rows that waited, told apart by `_new`; null keys are left to the caller."""
    rows = new.withColumn("_new", F.lit(True))
    return rows if old is None else old.withColumn("_new", F.lit(False)).unionByName(rows)


def _met(waiting: DataFrame, came: DataFrame, key: str, predicted_at: str, arrived_at: str) -> DataFrame:
    """What there is of every key, stored: its first prediction `p`, its first label `l`, how many labels (`n`), and whether
    rows of either kind waited (`old_p`, `old_l`).

    One aggregate over both sides, reduced in each task before the shuffle, so that a key sent over and over fills no task.
    """
    first = lambda rows, time: F.struct(time, *[c for c in rows.columns if c not in (key, time)])
    p, l = first(waiting, predicted_at), first(came, arrived_at)  # noqa: E741
    both = waiting.select(key, p.alias("p")).unionByName(came.select(key, l.alias("l")), allowMissingColumns=True)
    waited = lambda side: F.coalesce(F.max(~F.col(f"{side}._new")), F.lit(False))
    met = both.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min("p").alias("p"), F.min("l").alias("l"), F.count("l").alias("n"), waited("p").alias("old_p"), waited("l").alias("old_l")
    )
    return materialise(met, "met")


def settle(
    predictions: DataFrame,
    labels: DataFrame,
    pending: DataFrame | None = None,
    orphans: DataFrame | None = None,
    labelled_before: DataFrame | Callable[[DataFrame], DataFrame | None] | None = None,
    key: str = KEY,
    predicted_at: str = "prediction_time",
    arrived_at: str = "label_arrival_time",
) -> Settled:
    """Match the predictions and labels of a batch with each other and with what earlier batches left waiting.

    Nothing expires: a prediction waits in `pending` for any later label, a label in `orphans` for any later
    prediction. A prediction is labelled once, by the first label there is; further labels are corrections, which live on in
    the label log. `labelled_before` has the keys labelled earlier, or finds them among keys it is given.
    """
    waiting, came = _marked(predictions, pending), _marked(labels, orphans)
    met = _met(waiting, came, key, predicted_at, arrived_at)
    extra = met.filter("p is null").select(key, "l", "n")
    before = labelled_before(extra) if callable(labelled_before) else labelled_before
    if before is not None:
        extra = materialise(orphan_labels(before, extra, key), "extra")
    # Most keys without a prediction have one label, which is their first one.
    several = materialise(extra.filter("n > 1").select(key), "several")
    left = extra.filter("n = 1").select(key, "l.*").select(came.columns).unionByName(came.join(several, key, "left_semi"))
    open_ = met.filter("p is not null and l is null").select(key, "p.*").select(waiting.columns)

    labelled = met.filter("p is not null and l is not null")
    bare = [c for c in predictions.columns if c not in ("true_label", "label_arrival_time")]
    rest = [c for c in labels.columns if c != key]
    labelled = labelled.select(
        *[F.col(c) if c == key else F.col(f"p.{c}") for c in [key, *[c for c in bare if c != key]]],
        *[F.col(f"l.{c}").alias("true_label" if c == "label" else c) for c in rest],
    ).withColumn("is_correct", is_correct(F.col("predicted_label"), F.col("true_label")))
    still = "p is not null and l is null and not p._new"
    return Settled(
        labelled,
        open_.drop("_new"),
        left.drop("_new"),
        open_.filter("_new").drop("_new"),
        met.filter(f"old_p and not ({still})").select(key),
        left.filter("_new").drop("_new"),
        met.filter("old_l").select(key).join(extra.select(key), key, "left_anti"),
    )
