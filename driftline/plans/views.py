"""Feature, label and prediction tables derived from the `events` test table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.columns import hash_share, margin
from driftline.operators.labels import join_labels, latest_label
from driftline.operators.scoring import LinearModel, prediction_rows, score
from driftline.schemas import DOWN, FEATURES, KEY, UP

# The two scoring models, and the time the second one takes over.
MODEL_1 = LinearModel((0.08, -0.03, 0.0, 0.0, 0.0), 0.0)
MODEL_2 = LinearModel((0.01, -0.03, 0.0, 0.0, 0.0), 1.0)
SWAP = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.get_json_object("props", "$.k").cast("double")
    values = [F.col("value"), number, F.hour("ts"), F.col("user_id"), F.minute("ts")]
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias(KEY),
        "event_id",
        "ts",
        F.col("event_type").alias("segment"),
        *[v.cast("double").alias(f) for v, f in zip(values, FEATURES)],
    )


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with a planted shift of the first one."""
    late = F.col("ts") >= F.lit(SWAP).cast("timestamp_ntz")
    first = FEATURES[0]
    return features(spark, sf_dir).withColumn(first, F.when(late, F.col(first) * 1.5).otherwise(F.col(first)))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with a label that depends on two of them and on noise."""
    noise = (hash_share(F.col("event_id")) - 0.5) * 2
    score_ = margin((0.08, -0.03), 0.0, FEATURES[:2]) + noise
    return features(spark, sf_dir).withColumn("label", F.when(score_ > 0, UP).otherwise(DOWN))


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth with some labels missing or unknown."""
    odd = F.when(F.col("event_id") % 101 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 103 == 0, "FLAT")
    known = (F.col("event_id") % 101 != 0) & (F.col("event_id") % 103 != 0)
    return truth(spark, sf_dir).withColumn("label", odd.when(known, F.col("label")))


def label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as they arrive: late, some never, some twice with another value, some for unknown keys."""
    at = F.expr("ts + make_dt_interval(0, 0, int(event_id % 7), 0)")
    other = F.when(F.col("label") == UP, DOWN).otherwise(UP)
    row = lambda key, label, time: F.struct(key.alias(KEY), label.alias("label"), time.alias("label_arrival_time"))
    sent = F.col("event_id") % 11 != 0
    rows = [
        F.when(sent, row(F.col(KEY), F.col("label"), at)),
        F.when(sent & (F.col("event_id") % 13 == 0), row(F.col(KEY), other, at + F.expr("INTERVAL 60 MINUTES"))),
        F.when(F.col("event_id") % 97 == 0, row((F.col("event_id") + 1_000_000_000).cast("string"), F.col("label"), at)),
    ]
    made = truth(spark, sf_dir).select(F.explode(F.array(*rows)).alias("row"))
    return made.filter("row is not null").select("row.*")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows of the first model, then of the second."""
    rows = features(spark, sf_dir)
    early = F.col("ts") < F.lit(SWAP).cast("timestamp_ntz")
    scored = score(rows, MODEL_1).withColumnRenamed("prediction", "_first")
    scored = score(scored, MODEL_2).withColumn(
        "prediction", F.when(early, F.col("_first")).otherwise(F.col("prediction"))
    )
    return prediction_rows(scored, F.when(early, "lr_v1").otherwise("lr_v2"), F.col("ts"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the label that counts."""
    return join_labels(predictions(spark, sf_dir), latest_label(label_log(spark, sf_dir)))


def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature events as log records; some are garbage, wrongly typed or lack a field."""
    fields = [F.col(KEY), *[F.col(f) for f in FEATURES]]
    wrong = [F.col(KEY), F.lit("n/a").alias(FEATURES[0]), *[F.col(f) for f in FEATURES[1:]]]
    kind = F.col("event_id") % 50
    value = (
        F.when(kind == 0, F.lit("{broken"))
        .when(kind == 1, F.to_json(F.struct(*wrong)))
        .when(kind == 2, F.to_json(F.struct(*fields[:-1])))
        .when(kind == 3, F.to_json(F.struct(*fields[1:])))
        .otherwise(F.to_json(F.struct(*fields)))
    )
    return features(spark, sf_dir).select("event_id", "ts", value.cast("binary").alias("value"))
