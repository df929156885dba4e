"""Drift monitors on streams.

Every micro-batch goes through the parallel batch operator, started from the state that earlier batches stored for the keys
it holds. A key that fills a batch is thereby spread over all tasks, which a state store partitioned by key cannot do, and keys that a
batch does not hold cost nothing: state is kept in buckets of keys (see `sources.keyed`), and only those of the batch's keys are opened.
A batch that is replayed starts from the same state and finds its own results in place, so a restart neither loses nor repeats anything.

Rows count in the order of their batches, within a batch in `order`. With a reorder buffer they count in the order of their time across
batches as well, and rows that come later than it waits are stored apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.operators.eddm import eddm_run
from driftline.operators.kswin import kswin_run
from driftline.schemas import FEATURES, KEY
from driftline.session import materialise, scratch_scope
from driftline.sources.files import read_batch, write_batch
from driftline.sources.keyed import BUCKETS, KeyedTable
from driftline.streaming.batches import for_each_batch
from driftline.streaming.labels import settle
from driftline.streaming.reorder import ReorderBuffer

Then = Callable[[DataFrame, int], None]


class LabelTables(NamedTuple):
    """Where `follow_labels` keeps its tables. `pending` and `orphans` hold what waits, `known` the keys labelled so far, all by key;
    `expired` what waited too long, `aging` the times that decide on that."""

    labelled: str
    label_log: str
    pending: str
    orphans: str
    state: str
    known: str
    expired: str
    aging: str


def in_order(reorder: ReorderBuffer | None, batch: DataFrame, batch_id: int, step: Callable[[DataFrame], None]) -> None:
    """Process a batch as it is, or what the buffer releases on it."""
    if reorder is None:
        step(batch)
        return
    ready = materialise(reorder.release(batch, batch_id), "ready")
    if not ready.isEmpty():
        step(ready)
    reorder.commit(batch.sparkSession, batch_id)


def _finish(spark: SparkSession, reorder: ReorderBuffer, step: Callable[[DataFrame, int], None]) -> None:
    """Process what a buffer still holds as a last batch. The stream must be over: its next batch would have the same number."""
    waiting, batch_id = reorder.rest(spark)
    if waiting is not None:
        with scratch_scope(spark):
            step(waiting, batch_id)


def errors_step(
    labelled: DataFrame,
    batch_id: int,
    keys: Sequence[str],
    order: Sequence[str],
    ok: str,
    results: str,
    state: str,
    then: Then | None = None,
    buckets: int = BUCKETS,
    **options,
) -> None:
    """Detector rows of one batch and the state after it; `then` is called with the stored rows.

    What a batch adds to a key is its totals per block of rows (counts, last error, sum of squares, largest spread), merged with the
    stored totals of that key.
    """
    spark = labelled.sparkSession
    totals = KeyedTable(state, keys, replaces=True, buckets=buckets)
    run = eddm_run(labelled, keys, order, ok, state=totals.find(spark, batch_id, labelled, results), **options)
    write_batch(run.rows, results, batch_id)
    totals.put(batch_id, run.state)
    if then:
        then(read_batch(spark, results, batch_id, run.rows.schema), batch_id)


def monitor_errors(
    labelled: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ok: str,
    results: str,
    state: str,
    checkpoint: str,
    interval: str | None = None,
    then: Then | None = None,
    reorder: ReorderBuffer | None = None,
    **options,
) -> StreamingQuery:
    """Error-distance detector on labelled predictions; its rows go to the table `results`.

    `then` is called with the stored rows of each batch, to ask for a retraining, say.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        step = lambda rows: errors_step(rows, batch_id, keys, order, ok, results, state, then, **options)
        in_order(reorder, batch, batch_id, step)

    return for_each_batch(labelled, process, checkpoint, "monitor_errors", interval)


def finish_errors(
    spark: SparkSession, keys: Sequence[str], order: Sequence[str], ok: str, results: str, state: str, reorder: ReorderBuffer, **options
) -> None:
    """End of a stream: the rows that `monitor_errors` still holds back."""
    _finish(spark, reorder, lambda rows, batch_id: errors_step(rows, batch_id, keys, order, ok, results, state, **options))


def _expire(
    table: KeyedTable, added: DataFrame, gone: DataFrame, aging: ReorderBuffer, batch_id: int, seen: int | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a batch adds and removes once rows that waited too long are taken out, and those rows.

    A row's time goes to a buffer that hands it back when the watermark has passed it by the limit; if it is still there then, it expires.
    """
    spark, pair = added.sparkSession, [KEY, aging.time]
    due = materialise(aging.release(added.select(pair), batch_id, seen).distinct(), "due")
    expired, added = added.join(due, pair, "left_semi"), added.join(due, pair, "left_anti")
    stored = table.find(spark, batch_id, due)
    if stored is not None:
        stored = stored.join(gone, KEY, "left_anti").select(added.columns)
        late = materialise(stored.join(due, pair, "left_semi"), "late")
        keys = late.select(KEY).distinct()
        added = added.unionByName(stored.join(keys, KEY, "left_semi").join(due, pair, "left_anti"))  # other rows of these keys
        expired, gone = expired.unionByName(late), gone.unionByName(keys)
    return added, gone, expired


def follow_labels(
    predictions: DataFrame,
    labels: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    tables: LabelTables,
    checkpoint: str,
    interval: str | None = None,
    then: Then | None = None,
    max_wait: timedelta | None = None,
    reorder: ReorderBuffer | None = None,
    buckets: int = BUCKETS,
    predicted_at: str = "prediction_time",
    arrived_at: str = "label_arrival_time",
    **options,
) -> StreamingQuery:
    """Label log and prediction log in one query: every label is kept, predictions are matched at any delay, and the
    errors are watched. `order` must be total among the predictions labelled in a batch.

    Both logs are read as one stream of rows, so that a batch sees what came on either side. What waits is stored by key: a batch
    reads the buckets of its own keys and writes its own rows and removals, however much waits. With `max_wait`, predictions and
    labels whose time lies that far behind the latest one seen move to the table `expired` (`kind` says which they are).
    """
    blank = labels.drop(KEY).columns
    bare = predictions.drop(*blank, "true_label")
    left = bare.select("*", *[F.lit(None).cast(labels.schema[c].dataType).alias(c) for c in blank], F.lit(0).alias("_kind"))
    right = labels.select(
        KEY, *[F.lit(None).cast(bare.schema[c].dataType).alias(c) for c in bare.columns if c != KEY], *blank, F.lit(1).alias("_kind")
    )
    pending, orphans, known = (KeyedTable(path, [KEY], buckets=buckets) for path in (tables.pending, tables.orphans, tables.known))

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.filter("_kind = 0").select(bare.columns)
        came = batch.filter("_kind = 1").select(KEY, *blank)
        write_batch(came, tables.label_log, batch_id)
        active = materialise(batch.select(KEY).distinct(), "active")
        found = settle(
            fresh,
            came,
            pending.find(spark, batch_id, active, unique=True),
            orphans.find(spark, batch_id, active, unique=True),
            lambda some: known.find(spark, batch_id, some, tables.labelled, unique=True),
            predicted_at=predicted_at,
            arrived_at=arrived_at,
        )
        labelled = found.labelled
        changes = [(found.added_pending, found.gone_pending), (found.added_orphans, found.gone_orphans)]
        if max_wait is not None:
            aging = [
                ReorderBuffer(f"{tables.aging}/{side}", time, max_wait, keep_late=True) for side, time in (("predictions", predicted_at), ("labels", arrived_at))
            ]
            seen = max((t for t in (aging[0].latest(fresh), aging[1].latest(came)) if t is not None), default=None)
            (add_p, gone_p), (add_l, gone_l) = changes
            add_p, gone_p, late_p = _expire(pending, add_p, gone_p, aging[0], batch_id, seen)
            add_l, gone_l, late_l = _expire(orphans, add_l, gone_l, aging[1], batch_id, seen)
            changes = [(add_p, gone_p), (add_l, gone_l)]
            expired = late_p.withColumn("kind", F.lit("prediction")).unionByName(
                late_l.withColumn("kind", F.lit("label")), allowMissingColumns=True
            )
            write_batch(expired, tables.expired, batch_id)
        for table, (rows, gone) in zip((pending, orphans), changes):
            table.put(batch_id, rows, gone)
        known.put(batch_id, labelled.select(KEY))

        def watch(rows: DataFrame) -> None:
            if not rows.isEmpty():
                errors_step(rows, batch_id, keys, order, "is_correct", tables.labelled, tables.state, then, buckets, **options)

        in_order(reorder, labelled, batch_id, watch)
        if max_wait is not None:
            for buffer in aging:
                buffer.commit(spark, batch_id)

    return for_each_batch(left.unionByName(right), process, checkpoint, "follow_labels", interval)


def features_step(
    batch: DataFrame,
    batch_id: int,
    keys: Sequence[str],
    order: Sequence[str],
    results: str,
    state: str,
    features: Sequence[str] = FEATURES,
    buckets: int = BUCKETS,
    **options,
) -> None:
    """Drift rows of one batch, and the state of its keys after it."""
    spark = batch.sparkSession
    tables = {part: KeyedTable(f"{state}/{part}", keys, replaces=True, buckets=buckets) for part in ("totals", "tail", "last")}
    found = [t.find(spark, batch_id, batch, results if part == "totals" else None) for part, t in tables.items()]
    prior = None if found[0] is None else tuple(found)  # `last` stays None until the first drift
    run = kswin_run(batch, keys, order, features, state=prior, **options)
    write_batch(run.drifts, results, batch_id)
    for table, rows in zip(tables.values(), (run.totals, run.tail, run.last)):
        table.put(batch_id, rows)


def monitor_features(
    events: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    results: str,
    state: str,
    checkpoint: str,
    features: Sequence[str] = FEATURES,
    interval: str | None = None,
    reorder: ReorderBuffer | None = None,
    **options,
) -> StreamingQuery:
    """Window tests on a feature stream; drift rows go to the table `results`."""

    def process(batch: DataFrame, batch_id: int) -> None:
        step = lambda rows: features_step(rows, batch_id, keys, order, results, state, features, **options)
        in_order(reorder, batch, batch_id, step)

    return for_each_batch(events, process, checkpoint, "monitor_features", interval)


def finish_features(
    spark: SparkSession, keys: Sequence[str], order: Sequence[str], results: str, state: str, reorder: ReorderBuffer, **options
) -> None:
    """End of a stream: the rows that `monitor_features` still holds back."""
    _finish(spark, reorder, lambda rows, batch_id: features_step(rows, batch_id, keys, order, results, state, **options))
