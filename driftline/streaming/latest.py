"""The labelled rows that came last, kept from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftline.operators.labels import latest_per_key
from driftline.operators.sampling import latest_labelled
from driftline.schemas import KEY, RETRAIN_ROWS
from driftline.sources.files import drop_before, read_before, write_batch


def keep_latest(
    labelled: DataFrame, batch_id: int, path: str, rows: int = RETRAIN_ROWS, arrival: str = "label_arrival_time", key: str = KEY
) -> None:
    """Merge a batch of labelled rows into the stored latest `rows`: one row per key, that of its last label.

    Retraining then reads `rows` rows, however long the label log is. A batch is first cut down to its own latest rows, task by task.
    Each row must be complete: the label of a key that has left the table brings it back.
    """
    spark = labelled.sparkSession
    prior = read_before(spark, path, batch_id, schema=labelled.schema)
    both = labelled if prior is None else prior.unionByName(labelled)
    write_batch(latest_labelled(latest_per_key(both, [key], [arrival]), rows, arrival, key), path, batch_id)
    drop_before(spark, path, batch_id)


def kept_latest(spark, path: str) -> DataFrame | None:
    """The rows as the last batch left them."""
    return read_before(spark, path, 1 << 62)
