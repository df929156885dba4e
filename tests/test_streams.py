from pyspark.sql import functions as F

from driftline.operators import eddm as ed
from driftline.operators import kswin as kw
from driftline.operators.scoring import LinearModel
from driftline.plans import views
from driftline.plans.catalog import TIME
from driftline.schemas import FEATURES, KEY
from driftline.sources.files import read_table
from driftline.sources.logs import feature_events, label_events, read_log
from driftline.streaming import labels as sl
from driftline.streaming.batches import for_each_batch
from driftline.streaming.monitors import monitor_errors, monitor_features
from driftline.streaming.scoring import score_stream
from tests.conftest import SF01, SF001
from tests.test_detectors import frame, ok_frame, sequences, shifted


def add(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_score_stream_swaps_models_between_batches(spark, tmp_path):
    log, table, rejects = (str(tmp_path / n) for n in ("log", "table", "rejects"))
    records = views.json_log(spark, SF001)
    models = [("lr_v1", views.MODEL_1), ("lr_v2", LinearModel((0.0,) * 5, -1.0))]

    def run(model):
        events = feature_events(read_log(spark, "parquet", records.schema, log))
        score_stream(events, lambda: model, table, str(tmp_path / "check"), rejects).awaitTermination()

    add(records.filter("event_id < 600"), log)
    run(models[0])
    add(records.filter("event_id >= 500"), log)  # the first hundred come again
    run(models[1])
    run(models[1])  # nothing new
    got = read_table(spark, table)
    assert got.count() == got.select(KEY).distinct().count() == 920
    split = {r.model_version: r.n for r in got.groupBy("model_version").agg(F.max(F.col(KEY).cast("int")).alias("n")).collect()}
    assert split == {"lr_v1": 599, "lr_v2": 999}
    assert got.filter("model_version = 'lr_v2' and predicted_label <> 'DOWN'").isEmpty()
    assert read_table(spark, rejects).count() == 80 + 8


def test_rate_limit_gives_batches(spark, tmp_path):
    log, seen = str(tmp_path / "log"), []
    for i in range(3):
        add(spark.range(i * 10, i * 10 + 10), log)
    stream = read_log(spark, "parquet", spark.range(1).schema, log, maxFilesPerTrigger=1)
    for_each_batch(stream, lambda b, i: seen.append((i, b.count())), str(tmp_path / "c")).awaitTermination()
    assert seen == [(0, 10), (1, 10), (2, 10)]


def test_label_records(spark):
    raw = spark.createDataFrame([(b'{"eventID": 5, "label": "UP"}',), (b"?",)], "value binary")
    assert [tuple(r) for r in label_events(raw).collect()] == [("5", "UP"), (None, None)]


def error_stream(spark, tmp_path, data, cuts, crash=None):
    log, out, state, check = (str(tmp_path / n) for n in ("log", "out", "state", "check"))
    df = ok_frame(spark, data)
    for n, (low, high) in enumerate(zip([0, *cuts], [*cuts, 10**9])):
        add(df.filter((F.col("t") >= low) & (F.col("t") < high)), log)
        stream = read_log(spark, "parquet", df.schema, log)
        monitor_errors(stream, ["k"], ["t"], "ok", out, state, check).awaitTermination()
        if n == crash:  # the batch was processed but its commit got lost
            (tmp_path / "check" / "commits" / str(n)).unlink()
            (tmp_path / "check" / "commits" / f".{n}.crc").unlink(missing_ok=True)
    return df, read_table(spark, out)


def test_error_monitor_equals_batch_and_survives_a_replay(spark, tmp_path):
    data = sequences({"hot": 1200, "late": 60})
    df, got = error_stream(spark, tmp_path, data, [100, 101, 800], crash=1)
    want = ed.eddm(df, ["k"], ["t"], "ok")
    columns = ["k", "pos", "status", "num_errors", F.round("ratio", 9), F.round("mean_distance", 9), F.round("max_mean_std", 9)]
    assert rows(got, *columns) == rows(want, *columns)


def test_feature_monitor_equals_batch_and_survives_a_replay(spark, tmp_path):
    data = {"hot": shifted(900, 1), "b": shifted(300, 2)}
    df = frame(spark, ["k", "t", "x", "y"], [(k, t, *v) for k, seq in data.items() for t, v in enumerate(seq)])
    log, out, state, check = (str(tmp_path / n) for n in ("log", "out", "state", "check"))
    options = dict(features=["x", "y"], reference=100, current=34)
    for n, (low, high) in enumerate(((0, 60), (60, 400), (400, 410), (410, 10**9))):
        add(df.filter((F.col("t") >= low) & (F.col("t") < high)), log)
        stream = read_log(spark, "parquet", df.schema, log)
        monitor_features(stream, ["k"], ["t"], out, state, check, **options).awaitTermination()
        if n == 2:
            (tmp_path / "check" / "commits" / "2").unlink()
            (tmp_path / "check" / "commits" / ".2.crc").unlink(missing_ok=True)
    key = ["k", "feature", "pos", "h"]
    want = rows(kw.kswin(df, ["k"], ["t"], **options), *key)
    assert rows(read_table(spark, out), *key) == want and len(want) > 4


def late_logs(spark, tmp_path):
    p, l = str(tmp_path / "p"), str(tmp_path / "l")
    base = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") * 60)
    predictions = spark.range(300).withColumnRenamed("id", "n").select(
        F.col("n").cast("string").alias(KEY), F.lit("UP").alias("predicted_label"), base.alias("prediction_time"), "n"
    )
    labels = predictions.filter("n % 5 <> 0").select(
        KEY,
        F.when(F.col("n") % 3 == 0, "DOWN").otherwise("UP").alias("label"),
        (F.col("prediction_time") + F.expr("make_dt_interval(0, 0, int(n % 4) * 10, 0)")).alias("label_arrival_time"),
        "n",
    )
    return predictions, labels, p, l


def test_late_labels_in_batches_with_expiry(spark, tmp_path):
    predictions, labels, p, l = late_logs(spark, tmp_path)
    orphans = labels.filter("n % 50 = 1").withColumn(KEY, F.concat(F.lit("x"), KEY))
    again = labels.filter("n % 10 = 2")  # repeated at the same time
    both = labels.union(orphans).union(again)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for low, high in ((0, 100), (100, 200), (200, 300)):
        inside = f"n >= {low} and n < {high}"
        add(predictions.filter(inside).drop("n"), p)
        add(both.filter(inside).drop("n"), l)
        joined = sl.join_late_labels(
            read_log(spark, "parquet", predictions.drop("n").schema, p),
            read_log(spark, "parquet", labels.drop("n").schema, l),
            "20 minutes", "40 minutes", how="full_outer", once=True,
        )
        writer = joined.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True)
        writer.outputMode("append").start(out).awaitTermination()
    got = spark.read.parquet(out)
    matched = got.filter("prediction_time is not null and label_arrival_time is not null")
    want = labels.filter("n % 4 <= 2")  # those within the wait of 20 minutes
    assert rows(matched, KEY, "true_label") == rows(want, KEY, F.col("label"))
    assert matched.filter("is_correct <> (true_label = 'UP')").isEmpty()
    expired = {int(r[KEY]) for r in got.filter("label_arrival_time is null").collect()}
    unmatched = {n for n in range(300) if n % 5 == 0 or n % 4 == 3}
    assert expired <= unmatched and {n for n in unmatched if n < 150} <= expired
    lost = {r[KEY] for r in got.filter("prediction_time is null").collect()}
    assert {"x1", "x51", "x101"} <= lost


def test_repeats_are_dropped_within_the_watermark(spark, tmp_path):
    _, labels, _, l = late_logs(spark, tmp_path)
    for _ in range(2):
        add(labels.drop("n"), l)
    once = sl.once_per_key(read_log(spark, "parquet", labels.drop("n").schema, l, maxFilesPerTrigger=1), "label_arrival_time", "1 day")
    out = str(tmp_path / "out")
    writer = once.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    writer.start(out).awaitTermination()
    assert spark.read.parquet(out).count() == labels.count()


def test_a_key_sent_over_and_over_is_thinned_before_the_shuffle(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    rows_ = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias(KEY),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("at"),
        F.when(F.col("id") % 2 == 0, F.lit(None).cast("string")).otherwise("UP").alias("label"),
    )
    rows_.union(rows_.limit(1).withColumn(KEY, F.lit(None).cast("string"))).write.parquet(log)
    once = sl.once_per_key(read_log(spark, "parquet", rows_.schema, log), "at", "2 hours")
    writer = once.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    query = writer.start(out)
    query.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == got.select(KEY).distinct().count() == 2002
    assert got.filter(F.col(KEY) != "hot").join(rows_, [KEY, "at"]).count() == 2000
    dropped = max(int(p["stateOperators"][0]["customMetrics"]["numDroppedDuplicateRows"]) for p in query.recentProgress)
    assert dropped < 50


def test_planted_drift_is_reported_and_stationary_data_is_quiet(spark):
    rows_ = views.features(spark, SF01).select(*TIME, *FEATURES[:2])
    moved = views.shifted(spark, SF01).select(*TIME, *FEATURES[:2])
    options = dict(features=FEATURES[:2], stride=4)
    quiet = kw.kswin(rows_, [], TIME, **options)
    loud = kw.kswin(moved, [], TIME, **options).filter(F.col("feature") == FEATURES[0])
    cut = moved.filter(F.col("ts") < F.lit(views.SWAP).cast("timestamp_ntz")).count()
    found = [r.pos for r in loud.collect() if cut < r.pos <= cut + 336]
    assert len(found) >= 1 and quiet.count() <= 6


def test_flagship_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.columns[:4] == [KEY, "model_version", "pos", "status"] and got.count() > 0


def test_settle_waits_without_limit_and_keeps_corrections_apart(spark):
    at = F.timestamp_seconds
    make_p = lambda rows: spark.createDataFrame(rows, f"{KEY} string, predicted_label string, s long").select(
        KEY, "predicted_label", at("s").alias("prediction_time")
    )
    make_l = lambda rows: spark.createDataFrame(rows, f"{KEY} string, label string, s long").select(
        KEY, "label", at("s").alias("label_arrival_time")
    )
    one = sl.settle(make_p([("a", "UP", 1), ("b", "UP", 2), ("b", "DOWN", 3)]), make_l([("x", "UP", 5), ("a", "DOWN", 9), ("a", "UP", 7)]))
    assert rows(one.labelled, KEY, "true_label", "is_correct") == [("a", "UP", True)]
    assert rows(one.pending, KEY, "predicted_label") == [("b", "UP")] and rows(one.orphans, KEY) == [("x",)]
    two = sl.settle(
        make_p([("x", "UP", 10**7)]), make_l([("b", "DOWN", 10**8), ("a", "DOWN", 10**8), ("y", "UP", 1)]), one.pending, one.orphans, one.labelled.select(KEY)
    )
    assert rows(two.labelled, KEY, "true_label") == [("b", "DOWN"), ("x", "UP")]
    assert two.pending.isEmpty() and rows(two.orphans, KEY) == [("y",)]  # the second label of a is a correction


def test_batches_are_final_and_lost_state_is_an_error(spark, tmp_path):
    from driftline.sources.files import batches_of, read_before, write_batch

    table, state = str(tmp_path / "t"), str(tmp_path / "s")
    write_batch(spark.range(3), table, 4)
    write_batch(spark.range(9), table, 4)  # a replay changes nothing
    write_batch(spark.range(0), table, 5)
    assert read_table(spark, table).count() == 3 and batches_of(spark, table) == [4, 5]
    assert read_before(spark, state, 4, table) is None
    try:
        read_before(spark, state, 5, table)
        raise AssertionError("should fail")
    except FileNotFoundError:
        pass


def test_thinning_in_groups_of_blocks_equals_one_pass(spark):
    from driftline.operators.thin import thin

    places = sorted({(i * i * 7919) % 40_000 + 1 for i in range(3000)})
    df = spark.createDataFrame([("k", p) for p in places], "k string, pos long")
    kept, free = [], 0
    for p in places:
        if p >= free:
            kept.append(p)
            free = p + 90
    got = thin(df, ["k"], 90, block_length=100)  # 400 blocks, chained in two levels
    assert sorted(r.pos for r in got.collect()) == kept


def test_thinning_hands_no_large_group_to_a_task(spark, monkeypatch):
    from driftline.operators import thin as module

    stored, kept = {}, module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, label: stored.setdefault(label, kept(df, label)))
    got = module.thin(spark.range(1, 400_001).select(F.lit("k").alias("k"), F.col("id").alias("pos")), ["k"], 1000)
    assert got.count() == 400  # dense rows: the first of every thousand
    assert stored["maps"].count() >= 400_000 / 70_000  # a block is a group


def test_settle_makes_one_pass_and_tells_what_changes(spark, monkeypatch):
    at = F.timestamp_seconds
    make_p = lambda rows: spark.createDataFrame(rows, f"{KEY} string, predicted_label string, s long").select(
        KEY, "predicted_label", at("s").alias("prediction_time")
    )
    make_l = lambda rows: spark.createDataFrame(rows, f"{KEY} string, label string, s long").select(
        KEY, "label", at("s").alias("label_arrival_time")
    )
    stored, kept = [], sl.materialise
    monkeypatch.setattr(sl, "materialise", lambda df, label: stored.append(label) or kept(df, label))
    found = sl.settle(
        make_p([("x", "UP", 10), ("p", "DOWN", 9), ("n", "UP", 1), (None, "UP", 1)]),
        make_l([("b", "UP", 30), ("y", "UP", 4), ("z", "UP", 5), ("z", "UP", 5), ("a", "UP", 8), (None, "UP", 1)]),
        make_p([("b", "DOWN", 2), ("p", "UP", 3), ("n", "UP", 7)]),
        make_l([("x", "UP", 5), ("x", "DOWN", 4), ("y", "DOWN", 6), ("w", "UP", 1)]),
        lambda keys: keys.filter(F.col(KEY) == "a").select(KEY),
    )
    assert rows(found.labelled, KEY, "predicted_label", "true_label") == [("b", "DOWN", "UP"), ("x", "UP", "DOWN")]
    assert rows(found.pending, KEY, "predicted_label") == [("n", "UP"), ("p", "UP")]  # the first one of each
    assert rows(found.added_pending, KEY) == [("n",)] and rows(found.gone_pending, KEY) == [("b",), ("n",)]
    assert rows(found.orphans, KEY, "label") == [("w", "UP"), ("y", "DOWN"), ("y", "UP"), ("z", "UP"), ("z", "UP")]
    assert rows(found.added_orphans, KEY) == [("y",), ("z",), ("z",)] and rows(found.gone_orphans, KEY) == [("x",)]
    assert stored == ["met", "extra", "several"]  # both sides are sorted by key once


def test_logs_are_dealt_into_parts_once(spark, tmp_path):
    from driftline.plans.catalog import _dealt

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    table = spark.range(30).mapInArrow(seen, "id long")
    part = F.when(F.col("id") < 27, (F.col("id") % 3).cast("int"))
    dealt = _dealt(table, part, str(tmp_path / "dealt"))
    assert [dealt.filter(F.col("_part") == n).count() for n in range(3)] == [9, 9, 9] and made.value == 30
    assert dealt.drop("_part").schema == table.schema
