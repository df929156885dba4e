"""The jobs a deployment runs: prepare data, train, predict, watch features and errors, retrain.

All share a root folder that every executor reaches. Run one with

    spark-submit --py-files driftline.zip driftline/plans/jobs.py predict --root s3://... --source kafka \
        --servers host:9092 --topic features
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.functions.columns import encode_label, event_key
from driftline.operators import retrain as rt
from driftline.operators import sampling, scoring
from driftline.operators.labels import prediction_view
from driftline.schemas import FEATURES, KEY, PAST_ROWS, RETRAIN_ROWS
from driftline.session import build_session, scratch_scope
from driftline.sources import files, logs
from driftline.streaming.monitors import LabelTables, follow_labels, monitor_features
from driftline.streaming.scoring import score_stream

log = logging.getLogger(__name__)

REQUEST = "model_version string, pos bigint"
REQUEST_TIMEOUT = 100_000  # labelled rows after which a request without an answer is given up
LABEL = f"{KEY} string, label string, label_arrival_time timestamp"
PREDICTION = (
    f"{KEY} string, "
    + ", ".join(f"{f} double" for f in FEATURES)
    + ", predicted_label string, true_label string, prediction_time timestamp,"
    + " label_arrival_time timestamp, model_version string"
)


@dataclass
class Layout:
    """Where the jobs keep their tables."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.root.rstrip('/')}/{name}"


def prepare(spark: SparkSession, raw_csv: str, root: str, past_rows: int = PAST_ROWS) -> None:
    """Split the raw file in time; write the past as training data, the rest as features and labels.

    Rows are ordered by date and period, as numbers where they are numbers.
    """
    at = Layout(root)
    raw = files.read_csv(spark, raw_csv)
    places = {f"_{c}": F.col(c).try_cast("double") for c in ("date", "period")}
    with scratch_scope(spark):
        order = ["_date", "date", "_period", "period", "day"]
        past, live = sampling.chrono_split(raw.withColumns(places), order, past_rows)
        files.write_csv(past.drop(*places), at.past_data)
        keyed = live.withColumn(KEY, event_key(F.col("date"), F.col("day"), F.col("period")))
        files.write_csv(keyed.select(KEY, *FEATURES), at.live_features)
        files.write_csv(keyed.select(KEY, F.col("class").alias("label")), at.live_labels)


def train(spark: SparkSession, root: str) -> float:
    """Fit the first model on most of the past data; returns its accuracy on the rest.

    Past rows have no key of their own, so the split hashes the whole key parts.
    """
    at = Layout(root)
    past = files.read_csv(spark, at.past_data)
    past = past.withColumn(KEY, F.concat_ws("|", "date", "day", "period"))
    past = past.withColumn("label", encode_label(F.col("class"), "up"))
    seen, held_out = sampling.hash_split(past)
    model = rt.train_version(seen, at.registry, at.models, 1)
    scored = scoring.score(held_out.dropna(subset=FEATURES), scoring.LinearModel.of(model))
    result = scoring.accuracy(scored).first()
    log.info("accuracy %s on %s rows", result.accuracy, result["rows"])
    return result.accuracy


def predict(spark: SparkSession, root: str, events: DataFrame, interval: str | None = None, **options) -> StreamingQuery:
    """Score a log of feature events (columns `timestamp`, `value`)."""
    at = Layout(root)
    decoded = logs.feature_events(events, keep=("timestamp",))
    return score_stream(
        decoded,
        rt.ModelCache(spark, at.registry),
        at.predictions,
        at.predict_checkpoint,
        rejects=at.rejects,
        clock="timestamp",
        interval=interval,
        **options,
    )


def _place(events: DataFrame) -> list[str]:
    """Columns of the envelope that order its records; a broker's partition and offset make the order total."""
    return [c for c in ("timestamp", "partition", "offset") if c in events.columns]


def watch_features(root: str, events: DataFrame, interval: str | None = None, **options) -> StreamingQuery:
    """Report drift of each feature in a log of feature events."""
    at = Layout(root)
    decoded = logs.feature_events(events, keep=tuple(_place(events)))
    return monitor_features(
        decoded,
        [],
        [*_place(events), KEY],
        at.feature_drifts,
        at.feature_state,
        at.feature_checkpoint,
        interval=interval,
        **options,
    )


def watch_errors(
    spark: SparkSession,
    root: str,
    labels: DataFrame,
    timeout: int | None = REQUEST_TIMEOUT,
    cooldown: int = 0,
    interval: str | None = None,
    **options,
) -> StreamingQuery:
    """Join a label log (columns `timestamp`, `value`) with the predictions, and watch the errors.

    Labels may come at any time and in any order; those without a prediction wait as orphans. Every label stays
    in the label log, so a correction counts when a model is retrained. Labelled rows are stored with the detector's
    verdict on their first label; drifts put a retraining request on the request log unless one is open for that model.
    """
    at = Layout(root)
    files.ensure_folder(spark, at.predictions)
    stored = logs.read_log(spark, "parquet", spark.createDataFrame([], PREDICTION).schema, at.predictions)
    decoded = logs.label_events(labels, keep=("timestamp",)).withColumnRenamed("timestamp", "label_arrival_time")

    def ask(rows: DataFrame, batch_id: int) -> None:
        requests = files.read_table(spark, at.requests, f"{REQUEST}, batch_id bigint")
        earlier = requests.filter(F.col("batch_id") < batch_id)
        finishes = files.read_table(spark, at.finishes, REQUEST)
        fresh = rt.new_requests(rows.filter("drift"), earlier, finishes, ["model_version"], timeout, cooldown)
        files.write_batch(fresh, at.requests, batch_id)

    return follow_labels(
        stored,
        decoded.dropna(subset=[KEY]),
        ["model_version"],
        ["label_arrival_time", KEY],
        LabelTables(at.labelled, at.label_log, at.pending, at.orphans, at.error_state, at.labelled_keys, at.expired, at.aging),
        at.error_checkpoint,
        interval=interval,
        then=ask,
        **options,
    )


def retrain(spark: SparkSession, root: str, rows: int = RETRAIN_ROWS) -> str | None:
    """Answer open requests with one new model version; returns its name if there is one.

    The model learns from the last label of each prediction.
    The requests are closed whatever happens, so a failed attempt does not block later ones.
    """
    at = Layout(root)
    requests = files.read_table(spark, at.requests, REQUEST).select("model_version", "pos")
    finishes = files.read_table(spark, at.finishes, REQUEST)
    waiting = requests.join(finishes, ["model_version", "pos"], "left_anti").persist()
    try:
        if waiting.isEmpty():
            return None
        try:
            predictions = files.read_table(spark, at.predictions, PREDICTION)
            table = prediction_view(predictions, files.read_table(spark, at.label_log, LABEL).drop("batch_id"))
            model = rt.retrain(table, at.registry, at.models, rows)
        finally:
            waiting.write.mode("append").parquet(at.finishes)
    finally:
        waiting.unpersist()
    if model is None:
        log.info("fewer than %s labelled rows, model kept", rows)
        return None
    return rt.current_model(rt.read_registry(spark, at.registry)).first()["name"]


DETECTOR_OPTIONS = {
    "warning": float, "drift": float, "min_errors": int, "reference": int, "current": int, "alpha": float, "stride": int
}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=["prepare", "train", "predict", "watch-features", "watch-errors", "retrain"])
    parser.add_argument("--root", required=True)
    parser.add_argument("--csv", help="raw file (prepare)")
    parser.add_argument("--past-rows", type=int, default=PAST_ROWS)
    parser.add_argument("--rows", type=int, default=RETRAIN_ROWS, help="labelled rows to retrain on")
    parser.add_argument("--source", default="kafka", help="kafka, or a file format (logs)")
    parser.add_argument("--servers", help="brokers (kafka)")
    parser.add_argument("--topic", help="topic (kafka)")
    parser.add_argument("--path", help="folder of the log (files)")
    parser.add_argument("--max-offsets", type=int)
    parser.add_argument("--interval", help="time between batches; without it the log is read to its end")
    parser.add_argument("--timeout", type=int, default=REQUEST_TIMEOUT, help="labelled rows until a request is given up")
    parser.add_argument("--cooldown", type=int, default=0, help="labelled rows after a retraining without a request")
    for name, kind in DETECTOR_OPTIONS.items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=kind, help="parameter of the detector")
    given = parser.parse_args(arguments)
    chosen = {name: getattr(given, name) for name in DETECTOR_OPTIONS if getattr(given, name) is not None}
    spark = build_session(name=f"driftline-{given.job}")

    def stream() -> DataFrame:
        if given.source == "kafka":
            options = logs.kafka_options(given.servers, given.topic, max_offsets=given.max_offsets)
            return logs.read_log(spark, "kafka", **options)
        schema = spark.createDataFrame([], "timestamp timestamp, value binary").schema
        return logs.read_log(spark, given.source, schema, given.path)

    if given.job == "prepare":
        prepare(spark, given.csv, given.root, given.past_rows)
    elif given.job == "train":
        print(f"Accuracy: {train(spark, given.root)}")
    elif given.job == "retrain":
        print(f"Current model: {retrain(spark, given.root, given.rows) or 'unchanged'}")
    elif given.job == "predict":
        predict(spark, given.root, stream(), given.interval).awaitTermination()
    elif given.job == "watch-features":
        watch_features(given.root, stream(), given.interval, **chosen).awaitTermination()
    else:
        watch_errors(
            spark, given.root, stream(), given.timeout, given.cooldown, interval=given.interval, **chosen
        ).awaitTermination()


if __name__ == "__main__":
    main()
