"""Queries over the test tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.columns import (
    clean_key,
    encode_label,
    event_key,
    feature_array,
    is_correct,
    legacy_key,
)
from driftline.operators import eddm as ed
from driftline.operators import kswin as kw
from driftline.operators import labels as lb
from driftline.operators import quality, retrain, sampling, scoring
from driftline.operators.decode import decode_json, reject_records, split_rejects
from driftline.operators.scan import ordered_index
from driftline.plans import views
from driftline.schemas import FEATURE_EVENT, FEATURES, KEY, KS_CURRENT
from driftline.session import materialise, scratch_path
from driftline.sources.files import read_csv, read_table, write_batch, write_csv
from driftline.sources.keyed import KeyedTable, append_idempotent
from driftline.sources.logs import feature_events, read_log
from driftline.streaming import labels as stream_labels
from driftline.streaming.batches import for_each_batch
from driftline.streaming.latest import keep_latest, kept_latest
from driftline.streaming.monitors import (
    LabelTables,
    finish_errors,
    finish_features,
    follow_labels,
    monitor_errors,
    monitor_features,
)
from driftline.streaming.reorder import ReorderBuffer
from driftline.streaming.scoring import score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ARRIVAL = ["label_arrival_time", KEY]
TIME = ["ts", "event_id"]


def query(function: Query) -> Query:
    QUERIES[function.__name__.removesuffix("_rows_query")] = function
    return function


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Records and keys


def _raw_rows(spark, sf_dir):
    """Raw key parts as text, with dots, from `lineitem`."""
    return views.table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy.MM.dd").alias("date"),
        F.col("l_linenumber").cast("string").alias("day"),
        F.concat(F.lit("0."), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("period"),
        F.col("l_orderkey"),
    )


@query
def event_key_rows_query(spark, sf_dir):
    rows = _raw_rows(spark, sf_dir)
    key = event_key(F.col("date"), F.col("day"), F.col("period"))
    return rows.select(
        "l_orderkey",
        clean_key(F.col("date")).alias("date"),
        key.alias(KEY),
        event_key(F.col("date"), F.col("day"), F.col("period"), "-").alias("separated"),
    )


@query
def event_key_legacy(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem")
    padded = F.lpad(F.col("l_orderkey").cast("string"), 8, "0")
    key = F.when(F.col("l_linenumber") == 1, F.concat(padded, F.lit("x"))).otherwise(padded)
    return rows.select("l_orderkey", "l_linenumber", key.alias("raw"), legacy_key(key).alias(KEY))


@query
def event_key_collisions(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.concat(F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias(KEY),
        "l_suppkey",
        "l_linenumber",
        "l_partkey",
    )
    return quality.key_collisions(rows.withColumn("part", F.col("l_partkey") % 3), KEY, ["l_suppkey", "part"])


@query
def feature_projection(spark, sf_dir):
    return views.features(spark, sf_dir).select(KEY, *FEATURES)


@query
def label_projection(spark, sf_dir):
    return views.truth(spark, sf_dir).select(KEY, F.col("label").alias("class")).select(KEY, F.col("class").alias("label"))


@query
def json_decode(spark, sf_dir):
    return decode_json(views.json_log(spark, sf_dir), FEATURE_EVENT, keep=["event_id"])


@query
def scorable_rows(spark, sf_dir):
    good, _ = split_rejects(json_decode(spark, sf_dir))
    return good


@query
def reject_rows(spark, sf_dir):
    _, bad = split_rejects(json_decode(spark, sf_dir))
    return bad.select("event_id", KEY, "reason")


@query
def reject_reasons(spark, sf_dir):
    """Why records cannot be scored, malformed ones told from incomplete ones."""
    return reject_records(views.json_log(spark, sf_dir)).select("event_id", "reason")


@query
def constraint_violations(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias(KEY),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("true_label"),
        F.col("l_partkey").cast("string").alias("model_version"),
    )
    return quality.constraint_violations(rows, KEY, [KEY, "true_label"], {KEY: 6, "true_label": 1, "model_version": 3})


# Labels, encodings, splits


def _encoded(spark, sf_dir, unknown):
    return views.raw_labels(spark, sf_dir).select(KEY, "label", encode_label(F.col("label"), unknown).alias("encoded"))


@query
def label_encode_train(spark, sf_dir):
    return _encoded(spark, sf_dir, "up")


@query
def label_encode_retrain(spark, sf_dir):
    return _encoded(spark, sf_dir, "down")


@query
def label_encode_strict(spark, sf_dir):
    return _encoded(spark, sf_dir, "null").withColumn("encoded", F.col("encoded").cast("double"))


@query
def feature_array_rows_query(spark, sf_dir):
    """Feature arrays, shown by their length, ends and sum."""
    rows = views.features(spark, sf_dir).select(KEY, feature_array().alias("features"))
    return rows.select(
        KEY,
        F.size("features").alias("width"),
        F.element_at("features", 1).alias("first"),
        F.element_at("features", -1).alias("last"),
        F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query
def chrono_split(spark, sf_dir):
    past, live = sampling.chrono_split(views.features(spark, sf_dir).select(KEY, *TIME), TIME, 3500)
    return past.withColumn("part", F.lit("past")).unionByName(live.withColumn("part", F.lit("live"))).drop("ts")


@query
def hash_split(spark, sf_dir):
    train, test = sampling.hash_split(views.features(spark, sf_dir).select(KEY))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def latest_label(spark, sf_dir):
    return lb.latest_label(views.label_log(spark, sf_dir))


@query
def latest_n_labelled(spark, sf_dir):
    return sampling.latest_labelled(views.labelled(spark, sf_dir), 2000).select(KEY, "true_label", *FEATURES)


@query
def retrain_guard(spark, sf_dir):
    """One model has enough labelled rows for a retraining set of 3,000, the others may not."""
    rows = views.labelled(spark, sf_dir)
    parts = [sampling.retrain_rows(rows.filter(F.col("model_version") == v), 3000) for v in ("lr_v1", "lr_v2", "lr_v3")]
    return reduce(DataFrame.unionByName, parts).select(KEY, "model_version", "true_label")


# Scores and predictions


@query
def linear_score(spark, sf_dir):
    return scoring.score(views.features(spark, sf_dir), views.MODEL_1).select(KEY, "prediction")


@query
def prediction_rows(spark, sf_dir):
    return views.predictions(spark, sf_dir).drop("label_arrival_time", "true_label")


@query
def accuracy(spark, sf_dir):
    rows = scoring.score(views.truth(spark, sf_dir), views.MODEL_1)
    return rounded(scoring.accuracy(rows.withColumn("label", encode_label(F.col("label")).cast("double"))), 9, "accuracy")


@query
def attach_by_key(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").withColumn(KEY, F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return lb.attach_by_key(rows.select(KEY, "l_extendedprice"), rows.select(KEY, "l_quantity"), KEY, ["l_quantity"])


@query
def label_join(spark, sf_dir):
    return views.labelled(spark, sf_dir).select(
        KEY, "predicted_label", "true_label", "model_version", "label_arrival_time", "is_correct"
    )


@query
def orphan_labels(spark, sf_dir):
    return lb.orphan_labels(views.predictions(spark, sf_dir), views.label_log(spark, sf_dir))


@query
def pending_predictions(spark, sf_dir):
    labels = lb.latest_label(views.label_log(spark, sf_dir))
    return lb.pending_predictions(views.predictions(spark, sf_dir), labels).select(KEY, "predicted_label", "model_version")


@query
def pending_documents(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return lb.pending_predictions(documents, views.table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query
def prediction_table(spark, sf_dir):
    """The prediction table with the labels written back."""
    return lb.prediction_view(views.predictions(spark, sf_dir), views.label_log(spark, sf_dir))


@query
def idempotent_append(spark, sf_dir):
    """Two overlapping batches, the second one replayed."""
    rows = views.predictions(spark, sf_dir).select(KEY, "predicted_label", "prediction_time")
    path = scratch_path(spark, "append")
    early = rows.filter("prediction_time < timestamp_ntz'2024-01-20 00:00:00'")
    late = rows.filter("prediction_time >= timestamp_ntz'2024-01-10 00:00:00'")
    for batch_id, batch in ((0, early.unionByName(early)), (1, late), (1, late)):
        append_idempotent(batch, path, KEY, batch_id)
    return read_table(spark, path).select(KEY, "predicted_label", F.col("batch_id").cast("int").alias("batch_id"))


# Error drift


def _eddm_columns(rows: DataFrame) -> DataFrame:
    shown = rows.select(
        KEY, "model_version", "pos", "status", "warning", "drift", "ratio", "num_errors", "mean_distance", "max_mean_std"
    )
    return rounded(shown, 6, "ratio", "mean_distance", "max_mean_std")


def _verdicts(spark, sf_dir):
    return views.labelled(spark, sf_dir).select(*ARRIVAL, "model_version", "is_correct")


@query
def error_distance(spark, sf_dir):
    return ed.error_distance(_verdicts(spark, sf_dir), [], ARRIVAL, "is_correct").select(KEY, "pos", "distance")


@query
def eddm_status(spark, sf_dir):
    return _eddm_columns(ed.eddm(_verdicts(spark, sf_dir), [], ARRIVAL, "is_correct"))


@query
def eddm_by_model(spark, sf_dir):
    return _eddm_columns(ed.eddm(_verdicts(spark, sf_dir), ["model_version"], ARRIVAL, "is_correct"))


@query
def eddm_errors(spark, sf_dir):
    return _eddm_columns(ed.eddm(_verdicts(spark, sf_dir), ["model_version"], ARRIVAL, "is_correct", errors_only=True))


@query
def prequential_accuracy(spark, sf_dir):
    rows = scoring.prequential_accuracy(_verdicts(spark, sf_dir), [], ARRIVAL, "is_correct")
    return rounded(rows.select(KEY, "pos", "correct", "accuracy"), 9, "accuracy")


@query
def recent_accuracy(spark, sf_dir):
    rows = scoring.prequential_accuracy(_verdicts(spark, sf_dir), ["model_version"], ARRIVAL, "is_correct", last=500)
    return rounded(rows.select(KEY, "model_version", "pos", "accuracy"), 9, "accuracy")


@query
def ordered_index_rows_query(spark, sf_dir):
    rows = ordered_index(views.features(spark, sf_dir).select("segment", *TIME), ["segment"], TIME)
    return rows.select("segment", "event_id", "pos")


# Feature drift


@query
def draw_sample(spark, sf_dir):
    """As many rows per segment as a test compares."""
    rows = ordered_index(views.features(spark, sf_dir).select("segment", *TIME), ["segment"], TIME)
    return sampling.draw_sample(rows, ["segment"], KS_CURRENT).drop("ts")


@query
def unpivot_features(spark, sf_dir):
    return kw.unpivot_features(views.features(spark, sf_dir), ["segment", "event_id"])


@query
def ks_two_sample(spark, sf_dir):
    """First against second half of the month, per segment and feature."""
    long = kw.unpivot_features(views.shifted(spark, sf_dir), ["segment", "ts"])
    early = F.col("ts") < F.lit(views.SWAP).cast("timestamp_ntz")
    return rounded(kw.ks_two_sample(long, ["segment", "feature"], "value", early), 9, "ks_statistic", "p_value")


@query
def kswin_anchors(spark, sf_dir):
    rows = kw.kswin_anchors(views.shifted(spark, sf_dir), ["segment"], TIME)
    shown = rows.select("segment", "feature", "event_id", "pos", "h", "ks_statistic", "p_value", "drift")
    return rounded(shown, 9, "ks_statistic", "p_value")


@query
def kswin_drift(spark, sf_dir):
    """One detector per feature over the whole stream, tested at every event."""
    rows = kw.kswin(views.shifted(spark, sf_dir), [], TIME)
    return rounded(rows.select("feature", "event_id", "pos", "h", "ks_statistic", "p_value"), 9, "ks_statistic", "p_value")


@query
def kswin_drift_by_segment(spark, sf_dir):
    rows = kw.kswin(views.shifted(spark, sf_dir), ["segment"], TIME)
    return rows.select("segment", "feature", "event_id", "pos", "h")


@query
def kswin_readiness(spark, sf_dir):
    rows = views.shifted(spark, sf_dir).select("segment", *TIME, *FEATURES)
    drifts = kw.kswin(rows, ["segment"], TIME)
    return kw.readiness(ordered_index(rows, ["segment"], TIME), drifts, ["segment"])


# Training and its requests


@query
def lr_first_order(spark, sf_dir):
    """At the fitted optimum the predicted and the true label have equal moments with every feature.

    Shown is the share of each feature's total that falls on UP, by predicted chance.
    """
    rows = views.truth(spark, sf_dir).withColumn("label", encode_label(F.col("label")))
    model = scoring.LinearModel.of(scoring.fit(rows))
    chance = 1 / (1 + F.exp(-scoring.margin(model.weights, model.intercept)))
    moments = [("intercept", F.lit(1.0)), *[(f, F.col(f)) for f in FEATURES]]
    sums = rows.agg(
        F.count(F.lit(1)).alias("rows"), *[(F.avg(chance * x) / F.avg(x)).alias(name) for name, x in moments]
    )
    long = sums.unpivot(["rows"], [name for name, _ in moments], "feature", "share")
    return rounded(long, 4, "share")


@query
def current_model(spark, sf_dir):
    """Registry as the prediction table knows it: one version per model name seen."""
    seen = views.predictions(spark, sf_dir).groupBy(F.col("model_version").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    registry = seen.withColumn("version", F.regexp_extract("name", "([0-9]+)$", 1).cast("int"))
    return retrain.current_model(registry)


@query
def retrain_requests(spark, sf_dir):
    """Drifts of each model; a retraining is taken to finish at every 2,000th labelled row."""
    rows = ed.eddm(_verdicts(spark, sf_dir), ["model_version"], ARRIVAL, "is_correct").select("model_version", "pos", "drift")
    rows = materialise(rows.filter("drift or pos % 2000 = 0"), "marks")  # used for drifts and for finishes
    finishes = rows.filter("pos % 2000 = 0").select("model_version", "pos")
    return retrain.retrain_requests(rows.filter("drift"), finishes, ["model_version"], cooldown=100, timeout=300)


@query
def retrain_requests_open(spark, sf_dir):
    """As above without cooldown and timeout: one request between two finishes."""
    rows = ed.eddm(_verdicts(spark, sf_dir), ["model_version"], ARRIVAL, "is_correct").select("model_version", "pos", "drift")
    rows = materialise(rows.filter("drift or pos % 2000 = 0"), "marks")  # used for drifts and for finishes
    finishes = rows.filter("pos % 2000 = 0").select("model_version", "pos")
    return retrain.retrain_requests(rows.filter("drift"), finishes, ["model_version"])


# Streams: the table is written as a log in three parts, with a run to the end of the log after each,
# so every query also restarts twice from its checkpoint.

PARTS = ["", "2024-01-09 00:00:00", "2024-01-20 00:00:00", ""]


def _in_parts(rows: DataFrame, time: str, path: str, run: Callable[[DataFrame], object]) -> None:
    spark = rows.sparkSession
    for low, high in zip(PARTS, PARTS[1:]):
        part = rows
        if low:
            part = part.filter(F.col(time) >= F.lit(low).cast(rows.schema[time].dataType))
        if high:
            part = part.filter(F.col(time) < F.lit(high).cast(rows.schema[time].dataType))
        part.write.mode("append").parquet(path)
        run(read_log(spark, "parquet", rows.schema, path)).awaitTermination()


@query
def stream_score(spark, sf_dir):
    root = scratch_path(spark, "score")

    def run(log):
        events = feature_events(log)
        model = lambda: ("lr_v1", views.MODEL_1)
        return score_stream(events, model, f"{root}/table", f"{root}/checkpoint", f"{root}/rejects")

    _in_parts(views.json_log(spark, sf_dir), "ts", f"{root}/log", run)
    return read_table(spark, f"{root}/table").select(KEY, *FEATURES, "predicted_label", "model_version")


@query
def stream_label_join(spark, sf_dir):
    """Prediction and label logs joined as streams; labels come within two hours or not at all."""
    root = scratch_path(spark, "join")
    views.predictions(spark, sf_dir).write.parquet(f"{root}/predictions")
    views.label_log(spark, sf_dir).write.parquet(f"{root}/labels")

    def stream(name, time):
        log = read_log(spark, "parquet", spark.read.parquet(f"{root}/{name}").schema, f"{root}/{name}")
        return log.withColumn(time, F.col(time).cast("timestamp"))

    labels = stream("labels", "label_arrival_time")
    joined = stream_labels.join_late_labels(stream("predictions", "prediction_time"), labels, "2 hours", "1 day")
    writer = joined.select(KEY, "predicted_label", "true_label", "is_correct").writeStream
    writer = writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").outputMode("append").start(f"{root}/joined").awaitTermination()
    return spark.read.parquet(f"{root}/joined")


def _dealt(rows: DataFrame, part, path: str) -> DataFrame:
    """Rows with their `_part`, made once and stored by it, so that a part is read without the others; those without one are left out."""
    rows.withColumn("_part", part).filter("_part is not null").write.partitionBy("_part").parquet(path)
    return rows.sparkSession.read.schema(f"{_ddl(rows)}, _part int").parquet(path)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _follow_labels(spark, sf_dir) -> LabelTables:
    """Predictions and labels fed in three parts that ignore their times: labels before their prediction, days after it,
    corrections before or after what they correct. The query stops and restarts between the parts."""
    root = scratch_path(spark, "follow")
    tables = LabelTables(*[f"{root}/{name}" for name in LabelTables._fields])
    stamped = lambda rows, time: rows.withColumn(time, F.col(time).cast("timestamp"))
    logs = {
        "p": stamped(views.predictions(spark, sf_dir).drop("true_label", "label_arrival_time"), "prediction_time"),
        "l": stamped(views.label_log(spark, sf_dir), "label_arrival_time"),
    }
    share = lambda name, rows: F.pmod(F.xxhash64(*(rows.columns if name == "l" else [KEY])), F.lit(3)).cast("int")
    dealt = {name: _dealt(rows, share(name, rows), f"{root}/dealt-{name}") for name, rows in logs.items()}
    for part in range(3):
        for name, rows in dealt.items():
            rows.filter(F.col("_part") == part).drop("_part").write.mode("append").parquet(f"{root}/{name}")
        streams = [read_log(spark, "parquet", rows.schema, f"{root}/{name}") for name, rows in logs.items()]
        follow_labels(*streams, ["model_version"], ARRIVAL, tables, f"{root}/checkpoint", buckets=4).awaitTermination()
    return tables


@query
def stream_labelled_table(spark, sf_dir):
    """What a retraining learns from after the stream: every prediction with its last label."""
    tables = _follow_labels(spark, sf_dir)
    log = read_table(spark, tables.label_log).drop("batch_id")
    rows = lb.prediction_view(views.predictions(spark, sf_dir), log).filter("true_label is not null")
    return rows.select(KEY, "predicted_label", "true_label", F.col("label_arrival_time").cast("timestamp_ntz").alias("label_arrival_time"))


@query
def stream_labelled_once(spark, sf_dir):
    """Predictions whose error was counted, once each."""
    return read_table(spark, _follow_labels(spark, sf_dir).labelled).select(KEY, "model_version")


@query
def stream_orphans(spark, sf_dir):
    """Labels that still wait for a prediction when the stream ends."""
    tables = _follow_labels(spark, sf_dir)
    return KeyedTable(tables.orphans, [KEY]).everything(spark).select(KEY, "label")


@query
def ks_equal_sizes(spark, sf_dir):
    """Two halves of equal size per line number, whatever the size: prices by the parity of their row."""
    rows = views.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    place = ordered_index(rows, ["l_linenumber"], ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])
    paired = place.withColumn("pair", F.expr("(pos - 1) div 2")).groupBy("l_linenumber", "pair").agg(
        F.min_by("l_extendedprice", "pos").alias("a"), F.max_by("l_extendedprice", "pos").alias("b"), F.count(F.lit(1)).alias("n")
    )
    both = paired.filter("n = 2").select(F.expr("stack(2, true, a, false, b) as (first, price)"))
    return rounded(kw.ks_two_sample(both, [], "price", F.col("first")), 9, "ks_statistic", "p_value")


@query
def ks_unequal_exact(spark, sf_dir):
    """Prices of returned against other lines, per supplier and line number: small samples of unequal sizes, exact p-values."""
    rows = views.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    found = kw.ks_two_sample(rows, ["l_suppkey", "l_linenumber"], "l_extendedprice", F.col("l_returnflag") == "R", exact_up_to=10_000)
    return rounded(found, 9, "ks_statistic", "p_value")


@query
def registry_race(spark, sf_dir):
    """Versions after writers registered a model each at the same time, one for each model seen."""
    root = scratch_path(spark, "race")
    seen = views.predictions(spark, sf_dir).groupBy("model_version").count().collect()  # a row per model

    def write(row):
        version = retrain.next_version(spark, root)
        retrain.register(spark, root, version, f"lr_v{version}", f"models/{row['model_version']}", row["count"])

    with ThreadPoolExecutor(len(seen)) as writers:
        list(writers.map(write, seen))
    registry = retrain.read_registry(spark, root)
    return registry.select("version", "name").join(registry.agg(F.sum("rows").alias("all_rows")))


@query
def retrain_moments(spark, sf_dir):
    """As `lr_first_order`, for a model retrained on the latest 2,000 labelled rows and read back through the registry."""
    root = scratch_path(spark, "retrain")
    table = materialise(views.labelled(spark, sf_dir), "labelled")
    early = table.filter("label_arrival_time < timestamp_ntz'2024-01-10 00:00:00'")
    retrain.train_version(early.withColumn("label", encode_label(F.col("true_label"))), f"{root}/registry", f"{root}/models")
    retrain.retrain(table, f"{root}/registry", f"{root}/models", 2000)
    name, model = retrain.ModelCache(spark, f"{root}/registry").current()
    rows = sampling.retrain_rows(table, 2000)
    chance = 1 / (1 + F.exp(-scoring.margin(model.weights, model.intercept)))
    moments = [("intercept", F.lit(1.0)), *[(f, F.col(f)) for f in FEATURES]]
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), *[(F.avg(chance * x) / F.avg(x)).alias(f) for f, x in moments])
    long = sums.unpivot(["rows"], [f for f, _ in moments], "feature", "share")
    return rounded(long.withColumn("name", F.lit(name)), 3, "share")


@query
def registry_advance(spark, sf_dir):
    """The current model after one version was registered for each model seen, in order."""
    root = scratch_path(spark, "registry")
    seen = views.predictions(spark, sf_dir).groupBy("model_version").count().orderBy("model_version").collect()  # a row per model
    for version, row in enumerate(seen, 1):
        retrain.register(spark, root, version, row["model_version"], f"models/{version}", row["count"])
    return retrain.current_model(retrain.read_registry(spark, root)).select("version", "name", "path", "rows")


@query
def csv_round_trip(spark, sf_dir):
    root = scratch_path(spark, "csv")
    write_csv(_raw_rows(spark, sf_dir).select("date", "day", "period"), root)
    return read_csv(spark, root, "date string, day string, period string")


@query
def stream_score_swap(spark, sf_dir):
    """Three batches of events, scored by the first model, then twice by the second."""
    root = scratch_path(spark, "swap")
    models = iter([("lr_v1", views.MODEL_1), ("lr_v2", views.MODEL_2), ("lr_v2", views.MODEL_2)])

    def run(log):
        return score_stream(feature_events(log), lambda: next(models), f"{root}/table", f"{root}/checkpoint")

    _in_parts(views.json_log(spark, sf_dir), "ts", f"{root}/log", run)
    return read_table(spark, f"{root}/table").select(KEY, "predicted_label", "model_version")


@query
def stream_eddm(spark, sf_dir):
    root = scratch_path(spark, "errors")

    def run(log):
        return monitor_errors(
            log, ["model_version"], ARRIVAL, "is_correct", f"{root}/rows", f"{root}/state", f"{root}/checkpoint"
        )

    _in_parts(_verdicts(spark, sf_dir), "label_arrival_time", f"{root}/log", run)
    return _eddm_columns(read_table(spark, f"{root}/rows"))


@query
def stream_kswin(spark, sf_dir):
    root = scratch_path(spark, "features")
    rows = views.shifted(spark, sf_dir).select("segment", *TIME, *FEATURES)

    def run(log):
        return monitor_features(log, ["segment"], TIME, f"{root}/rows", f"{root}/state", f"{root}/checkpoint")

    _in_parts(rows, "ts", f"{root}/log", run)
    columns = "segment string, feature string, event_id bigint, pos bigint, h int"
    return read_table(spark, f"{root}/rows", columns).drop("batch_id")


def _out_of_order(rows: DataFrame, time: str, path: str, run: Callable[[DataFrame], object]) -> None:
    """As `_in_parts`, but a quarter of each part arrives with the part after it."""
    spark = rows.sparkSession
    cuts = [F.lit(cut).cast(rows.schema[time].dataType) for cut in PARTS[1:-1]]
    part = reduce(lambda a, b: a + b, [(F.col(time) >= cut).cast("int") for cut in cuts])
    late = (F.pmod(F.xxhash64(*rows.columns), F.lit(4)) == 0).cast("int")
    dealt = rows.withColumn("_part", F.least(part + late, F.lit(len(cuts))))
    for n in range(len(cuts) + 1):
        dealt.filter(F.col("_part") == n).drop("_part").write.mode("append").parquet(path)
        run(read_log(spark, "parquet", rows.schema, path)).awaitTermination()


@query
def stream_eddm_late(spark, sf_dir):
    """Labelled rows that arrive up to twelve days out of order, counted in order."""
    root = scratch_path(spark, "late-errors")
    place = (["model_version"], ARRIVAL, "is_correct", f"{root}/rows", f"{root}/state")
    reorder = ReorderBuffer(f"{root}/buffer", "label_arrival_time", timedelta(days=12), f"{root}/late")
    _out_of_order(
        _verdicts(spark, sf_dir), "label_arrival_time", f"{root}/log",
        lambda log: monitor_errors(log, *place, f"{root}/checkpoint", reorder=reorder),
    )
    finish_errors(spark, *place, reorder)
    return _eddm_columns(read_table(spark, f"{root}/rows"))


@query
def stream_kswin_late(spark, sf_dir):
    root = scratch_path(spark, "late-features")
    rows = views.shifted(spark, sf_dir).select("segment", *TIME, *FEATURES)
    place = (["segment"], TIME, f"{root}/rows", f"{root}/state")
    reorder = ReorderBuffer(f"{root}/buffer", "ts", timedelta(days=12), f"{root}/late")
    _out_of_order(rows, "ts", f"{root}/log", lambda log: monitor_features(log, *place, f"{root}/checkpoint", reorder=reorder))
    finish_features(spark, *place, reorder)
    columns = "segment string, feature string, event_id bigint, pos bigint, h int"
    return read_table(spark, f"{root}/rows", columns).drop("batch_id")


@query
def stream_pending(spark, sf_dir):
    """Predictions that still wait for a label when the stream ends."""
    tables = _follow_labels(spark, sf_dir)
    return KeyedTable(tables.pending, [KEY]).everything(spark).select(KEY, "predicted_label", "model_version")


@query
def stream_expired(spark, sf_dir):
    """Predictions and labels that waited longer than three days for the other one, both logs read in three parts by time."""
    root = scratch_path(spark, "expire")
    tables = LabelTables(*[f"{root}/{name}" for name in LabelTables._fields])
    logs = {
        "prediction_time": views.predictions(spark, sf_dir).drop("true_label", "label_arrival_time"),
        "label_arrival_time": views.label_log(spark, sf_dir),
    }
    logs = {time: rows.withColumn(time, F.col(time).cast("timestamp")) for time, rows in logs.items()}
    cuts = [F.lit(cut).cast("timestamp") for cut in ["1970-01-01", *PARTS[1:-1], "2970-01-01"]]
    inside = lambda time: [(F.col(time) >= low) & (F.col(time) < high) for low, high in zip(cuts, cuts[1:])]
    which = lambda time: F.coalesce(*[F.when(here, n) for n, here in enumerate(inside(time))])
    dealt = {time: _dealt(rows, which(time), f"{root}/dealt-{time}") for time, rows in logs.items()}
    for part in range(len(cuts) - 1):
        for time, rows in dealt.items():
            rows.filter(F.col("_part") == part).drop("_part").write.mode("append").parquet(f"{root}/{time}")
        streams = [read_log(spark, "parquet", rows.schema, f"{root}/{time}") for time, rows in logs.items()]
        follow_labels(
            *streams, ["model_version"], ARRIVAL, tables, f"{root}/checkpoint", max_wait=timedelta(days=3), buckets=4
        ).awaitTermination()
    return read_table(spark, tables.expired).select(KEY, "kind")


@query
def stream_latest_n(spark, sf_dir):
    """The latest 2,000 labelled rows, merged batch by batch, corrections included."""
    root = scratch_path(spark, "latest")
    predictions = views.predictions(spark, sf_dir).drop("true_label", "label_arrival_time")
    log = views.label_log(spark, sf_dir).withColumnRenamed("label", "true_label")
    labelled = predictions.join(log, KEY).select(KEY, "true_label", "label_arrival_time", *FEATURES)
    keep = lambda batch, batch_id: keep_latest(batch, batch_id, f"{root}/latest", 2000)
    _in_parts(labelled, "label_arrival_time", f"{root}/log", lambda rows: for_each_batch(rows, keep, f"{root}/checkpoint"))
    return kept_latest(spark, f"{root}/latest").select(KEY, "true_label", *FEATURES)


@query
def stream_requests(spark, sf_dir):
    """Retraining requests that a stream of drifts puts on the request log: one open request per model."""
    root = scratch_path(spark, "requests")
    empty = spark.createDataFrame([], "model_version string, pos bigint")

    def ask(rows, batch_id):
        earlier = read_table(spark, f"{root}/requests", "model_version string, pos bigint, batch_id bigint").filter(F.col("batch_id") < batch_id)
        write_batch(retrain.new_requests(rows.filter("drift"), earlier, empty, ["model_version"]), f"{root}/requests", batch_id)

    def run(log):
        tables = (f"{root}/rows", f"{root}/state", f"{root}/checkpoint")
        return monitor_errors(log, ["model_version"], ARRIVAL, "is_correct", *tables, then=ask, errors_only=True)

    _in_parts(_verdicts(spark, sf_dir), "label_arrival_time", f"{root}/log", run)
    return read_table(spark, f"{root}/requests", "model_version string, pos bigint").select("model_version", "pos")


@query
def stream_rate_limited(spark, sf_dir):
    """Batches of a log of six files of which a batch may take two, with a restart after the first four files."""
    root = scratch_path(spark, "rate")
    rows = views.features(spark, sf_dir).select("event_id", "ts")
    count = lambda batch, batch_id: write_batch(batch.agg(F.count(F.lit(1)).alias("rows")), f"{root}/counts", batch_id)
    for part in range(6):
        rows.filter(F.col("event_id") % 6 == part).coalesce(1).write.mode("append").parquet(f"{root}/log")
        if part in (3, 5):
            log = read_log(spark, "parquet", rows.schema, f"{root}/log", maxFilesPerTrigger=2)
            for_each_batch(log, count, f"{root}/checkpoint").awaitTermination()
    return read_table(spark, f"{root}/counts").select(F.col("batch_id").cast("int").alias("batch_id"), "rows")


@query
def stream_score_registry(spark, sf_dir):
    """As `stream_score_swap`, with the second model put into the registry after the first batch."""
    root = scratch_path(spark, "score-registry")
    versions = iter([(1, views.MODEL_1), (2, views.MODEL_2)])

    def advance():
        version, model = next(versions, (None, None))
        if version:
            scoring.save_model(spark, model, f"{root}/models/{version}")
            retrain.register(spark, f"{root}/registry", version, f"lr_v{version}", f"{root}/models/{version}", 0)

    models = retrain.ModelCache(spark, f"{root}/registry")

    def run(log):
        advance()
        return score_stream(feature_events(log), models, f"{root}/table", f"{root}/checkpoint")

    _in_parts(views.json_log(spark, sf_dir), "ts", f"{root}/log", run)
    return read_table(spark, f"{root}/table").select(KEY, "predicted_label", "model_version")


@query
def stream_once_per_key(spark, sf_dir):
    """Keys of the label log after repeats were dropped within the watermark."""
    root = scratch_path(spark, "once")
    views.label_log(spark, sf_dir).write.parquet(f"{root}/labels")
    log = read_log(spark, "parquet", spark.read.parquet(f"{root}/labels").schema, f"{root}/labels")
    log = log.withColumn("label_arrival_time", F.col("label_arrival_time").cast("timestamp"))
    once = stream_labels.once_per_key(log, "label_arrival_time", "1 day").select(KEY)
    writer = once.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").outputMode("append").start(f"{root}/kept").awaitTermination()
    return spark.read.parquet(f"{root}/kept")


@query
def correctness_flag(spark, sf_dir):
    """Verdict on every prediction; one without a label counts as an error."""
    rows = lb.prediction_view(views.predictions(spark, sf_dir), views.label_log(spark, sf_dir))
    return rows.select(KEY, is_correct(F.col("predicted_label"), F.col("true_label")).alias("is_correct"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score events, join late labels, and follow the error distances."""
    return eddm_status(spark, sf_dir)
