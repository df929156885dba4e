"""Micro-batch plumbing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from driftline.session import scratch_scope


def for_each_batch(
    stream: DataFrame,
    process: Callable[[DataFrame, int], None],
    checkpoint: str,
    name: str | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Run `process` on every batch that has rows.

    Without an `interval` the query takes what is there and stops. The batch is kept while it is
    processed, since most callbacks read it more than once.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                with scratch_scope(batch.sparkSession):
                    process(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
