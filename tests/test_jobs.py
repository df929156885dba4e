"""The jobs in the order a deployment runs them, on data derived from the test tables."""

from pyspark.sql import functions as F

from driftline.operators import retrain as rt
from driftline.plans import jobs, views
from driftline.schemas import FEATURES, KEY
from driftline.sources import files, logs
from driftline.sources.keyed import KeyedTable
from tests.conftest import SF001, SF01


def raw_csv(spark):
    rows = views.truth(spark, SF01).filter("event_id < 4000")
    return rows.select(
        F.date_format("ts", "yyyy.MM.dd").alias("date"),
        F.date_format("ts", "HH").alias("day"),
        F.concat(F.lit("0."), F.lpad(KEY, 6, "0")).alias("period"),
        *FEATURES,
        F.col("label").alias("class"),
    )


def test_jobs_end_to_end(spark, tmp_path):
    root = str(tmp_path / "root")
    raw = str(tmp_path / "raw")
    files.write_csv(raw_csv(spark), raw)
    jobs.prepare(spark, raw, root, past_rows=1500)
    at = jobs.Layout(root)
    past, live = files.read_csv(spark, at.past_data), spark.read.option("header", True).csv(at.live_labels)
    assert past.count() == 1500 and live.count() == 2500 and live.columns == [KEY, "label"]
    assert past.agg(F.max("period")).first()[0] == "0.001499"
    assert jobs.train(spark, root) > 0.7

    # Events a minute apart; their labels ten minutes later, and turned over in the second half.
    place = F.substring(KEY, -6, 6).cast("int")
    start = F.timestamp_seconds(F.lit(1_700_000_000) + place * 60)
    features = spark.read.option("header", True).csv(at.live_features)
    numbers = [F.col(f).cast("double").alias(f) for f in FEATURES]
    record = lambda *c: F.to_json(F.struct(*c)).cast("binary").alias("value")
    feature_log = features.select(start.alias("timestamp"), record(F.col(KEY), *numbers))
    turned = F.when((place > 2750) & (F.col("label") == "UP"), "DOWN").when((place > 2750), "UP").otherwise(F.col("label"))
    label_log = live.select((start + F.expr("INTERVAL 10 MINUTES")).alias("timestamp"), record(F.col(KEY), turned.alias("label")))
    paths = {"features": str(tmp_path / "f"), "labels": str(tmp_path / "l")}
    feature_log.write.parquet(paths["features"])
    label_log.write.parquet(paths["labels"])
    stream = lambda n: logs.read_log(spark, "parquet", feature_log.schema, paths[n])

    jobs.predict(spark, root, stream("features")).awaitTermination()
    predictions = files.read_table(spark, at.predictions)
    assert predictions.count() == 2500 and predictions.filter("model_version <> 'lr_v1'").isEmpty()

    jobs.watch_features(root, stream("features"), reference=200, current=100).awaitTermination()
    assert KeyedTable(f"{at.feature_state}/totals", [], replaces=True).everything(spark).first().n == 2500

    jobs.watch_errors(spark, root, stream("labels")).awaitTermination()
    labelled = files.read_table(spark, at.labelled)
    assert labelled.count() == 2500
    drifts = labelled.filter("drift")
    requests = files.read_table(spark, at.requests)
    assert [tuple(r) for r in requests.select("model_version", "pos").collect()] == [
        ("lr_v1", drifts.agg(F.min("pos")).first()[0])
    ]

    assert jobs.retrain(spark, root, rows=600) == "lr_v2"
    assert jobs.retrain(spark, root, rows=600) is None  # nothing open
    again = feature_log.withColumn("value", F.regexp_replace(F.col("value").cast("string"), f'"{KEY}":"', f'"{KEY}":"n').cast("binary"))
    again.limit(50).write.mode("append").parquet(paths["features"])
    jobs.predict(spark, root, stream("features")).awaitTermination()
    versions = {r.model_version: r["count"] for r in files.read_table(spark, at.predictions).groupBy("model_version").count().collect()}
    assert versions == {"lr_v1": 2500, "lr_v2": 50}


def test_failed_retraining_closes_its_request(spark, tmp_path):
    at = jobs.Layout(str(tmp_path))
    views.predictions(spark, SF001).withColumn("prediction_time", F.col("prediction_time").cast("timestamp")).write.parquet(at.predictions)
    log = views.label_log(spark, SF001)
    log.withColumn("label_arrival_time", F.col("label_arrival_time").cast("timestamp")).write.parquet(at.label_log)
    files.write_batch(spark.createDataFrame([("lr_v1", 60)], jobs.REQUEST), at.requests, 0)
    try:
        jobs.retrain(spark, str(tmp_path), rows=100)  # there is no registry to read
        raise AssertionError("should fail")
    except Exception as error:
        assert "registry" in str(error)
    assert files.read_table(spark, at.finishes).count() == 1
    assert jobs.retrain(spark, str(tmp_path), rows=100) is None


def test_new_requests(spark):
    make = lambda rows: spark.createDataFrame(rows, jobs.REQUEST)
    drifts = make([("a", 50), ("a", 40), ("b", 30), ("c", 20), ("d", 90)])
    requests = make([("b", 5), ("c", 7), ("d", 10)])
    finishes = make([("c", 7)])
    got = rt.new_requests(drifts, requests, finishes, ["model_version"], timeout=60)
    assert sorted(map(tuple, got.collect())) == [("a", 40), ("c", 20), ("d", 90)]
