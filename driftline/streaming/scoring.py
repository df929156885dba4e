"""Scoring of a feature stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.operators.decode import split_rejects
from driftline.operators.retrain import ModelCache
from driftline.operators.scoring import LinearModel, prediction_rows, score
from driftline.schemas import KEY
from driftline.sources.files import write_batch
from driftline.sources.keyed import append_idempotent
from driftline.streaming.batches import for_each_batch


def score_batch(
    batch: DataFrame,
    batch_id: int,
    model: tuple[str, LinearModel],
    table: str,
    rejects: str | None = None,
    clock: str | None = None,
) -> None:
    """Score one batch and store its predictions, once per key, and its rejected rows."""
    name, fitted = model
    good, bad = split_rejects(batch)
    rows = prediction_rows(score(good, fitted), name, F.col(clock) if clock else None)
    append_idempotent(rows, table, KEY, batch_id)
    if rejects:
        write_batch(bad, rejects, batch_id)


def score_stream(
    events: DataFrame,
    models: ModelCache | Callable[[], tuple[str, LinearModel]],
    table: str,
    checkpoint: str,
    rejects: str | None = None,
    clock: str | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Score events with the model that is current when their batch starts.

    Predictions are stamped with the column `clock`, or with the current time.
    """
    current = models.current if isinstance(models, ModelCache) else models

    def process(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, batch_id, current(), table, rejects, clock)

    return for_each_batch(events, process, checkpoint, "score", interval)
