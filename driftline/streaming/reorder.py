"""A buffer that hands on the rows of a stream in the order of their time, however they arrive.

Rows wait until the watermark, the latest time seen less a delay, has passed them; a batch then releases all rows between the watermark
before it and its own, so what is released batch after batch is in order of time, and sorting within a batch makes the order total. Rows
older than the watermark at their arrival come too late: they are stored apart and never released.

A row is written to the buffer once, by its own batch and sorted by time, and read once, when it is released: the scan is cut to a
range of time, which Parquet's statistics turn into a few row groups. Nothing is rewritten while it waits. A batch's part of the
buffer is deleted when the watermark has passed all of it. What a batch leaves behind is one line: its watermark, and which parts
still hold rows.
"""

from __future__ import annotations

import json
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import delete
from driftline.sources.files import batches_of, drop_before, note_before, read_batch, write_batch, write_note


def _number(column: Column, kind: T.DataType) -> Column:
    """Times as whole numbers: microseconds, or the column itself."""
    return F.unix_micros(column.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else column.cast("bigint")


def _value(number: int, kind: T.DataType) -> Column:
    """A number as a constant of the column's type, which scans can use."""
    return (F.timestamp_micros(F.lit(number)) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.lit(number)).cast(kind)


class ReorderBuffer:
    """Rows of a stream by `time`, held back by `delay` (a time span, or a number where the time is one).

    `path` holds the buffer, `late` the rows that came too late or have no time. Without `late` they are dropped. With
    `keep_late` rows that came too late are released at once, for uses that need every row but not their order.
    """

    def __init__(self, path: str, time: str, delay: timedelta | int, late: str | None = None, keep_late: bool = False):
        self.path, self.time, self.late, self.keep_late = path, time, late, keep_late
        self.delay = delay // timedelta(microseconds=1) if isinstance(delay, timedelta) else int(delay)

    def _clock(self, spark: SparkSession, batch_id: int) -> dict | None:
        note = note_before(spark, f"{self.path}/clock", batch_id)
        return None if note is None else json.loads(note)

    def _waiting(self, spark: SparkSession, parts: list, schema: T.StructType | None) -> list[DataFrame]:
        return [read_batch(spark, f"{self.path}/rows", batch, schema) for batch, _ in parts]

    def latest(self, rows: DataFrame) -> int | None:
        """The latest time of some rows, as a number."""
        return rows.agg(F.max(_number(F.col(self.time), rows.schema[self.time].dataType))).first()[0]

    def release(self, batch: DataFrame, batch_id: int, seen: int | None = None) -> DataFrame:
        """Store a batch and return the rows whose turn it is; `commit` makes it final.

        The watermark follows the latest time in the batch, or `seen` where the caller knows a later one.
        """
        spark, kind, time = batch.sparkSession, batch.schema[self.time].dataType, F.col(self.time)
        clock = self._clock(spark, batch_id)
        times = [t for t in (self.latest(batch), seen) if t is not None]
        before = clock["mark"] if clock else None
        marks = [m for m in (before, max(times) - self.delay if times else None) if m is not None]
        mark = max(marks, default=None)
        fresh = batch.filter(time.isNotNull())
        if before is not None and not self.keep_late:
            fresh = fresh.filter(time >= _value(before, kind))
            if self.late:
                write_batch(batch.filter(time.isNull() | (time < _value(before, kind))), self.late, batch_id)
        elif self.late:
            write_batch(batch.filter(time.isNull()), self.late, batch_id)
        if mark is None:  # no time was ever seen
            self._next = {"mark": None, "parts": []}
            return fresh
        due = time < _value(mark, kind)
        write_batch(fresh.filter(~due).sortWithinPartitions(self.time), f"{self.path}/rows", batch_id)
        parts = clock["parts"] if clock else []
        held = [rows.filter(due & (time >= _value(before, kind))) for rows in self._waiting(spark, parts, batch.schema)]
        high = self.latest(read_batch(spark, f"{self.path}/rows", batch_id, batch.schema))
        still = [(batch, latest) for batch, latest in parts if latest >= mark]
        self._next = {"mark": mark, "parts": still + ([(batch_id, high)] if high is not None else [])}
        return reduce(DataFrame.unionByName, held, fresh.filter(due))

    def commit(self, spark: SparkSession, batch_id: int) -> None:
        """Make the last `release` final, once its rows were processed, and free what no replay can ask for."""
        clock = self._clock(spark, batch_id)
        write_note(spark, f"{self.path}/clock/batch_id={batch_id}", json.dumps(self._next))
        drop_before(spark, f"{self.path}/clock", batch_id)
        if clock:
            live = {batch for batch, _ in clock["parts"]}  # what a replay of this batch reads
            for batch in batches_of(spark, f"{self.path}/rows"):
                if batch not in live and batch < batch_id:
                    delete(spark, f"{self.path}/rows/batch_id={batch}")

    def rest(self, spark: SparkSession) -> tuple[DataFrame | None, int]:
        """All rows that still wait, for a stream that is over, and the number of the batch they make."""
        batch_id = (batches_of(spark, f"{self.path}/clock") or [-1])[-1] + 1
        clock = self._clock(spark, batch_id)
        if clock is None or not clock["parts"]:
            return None, batch_id
        waiting = reduce(DataFrame.unionByName, self._waiting(spark, clock["parts"], None))
        return waiting.filter(F.col(self.time) >= _value(clock["mark"], waiting.schema[self.time].dataType)), batch_id
