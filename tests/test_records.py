import json

import pytest
from pyspark.sql import functions as F

from driftline.functions import columns as c
from driftline.operators import quality, sampling
from driftline.operators.decode import decode_json, split_rejects
from driftline.schemas import FEATURE_EVENT, FEATURES, KEY, RAW_CSV
from driftline.sources.keyed import append_idempotent
from driftline.sources import database, files, logs


def test_csv_round_trip_keeps_key_text(spark, tmp_path):
    raw = [("0.000044", "2", "0.0", *[0.5] * 5, "UP"), ("0.9", "02", "1.0", *[1.5] * 5, "DOWN")]
    files.write_csv(spark.createDataFrame(raw, RAW_CSV), str(tmp_path / "raw"))
    back = files.read_csv(spark, str(tmp_path / "raw"))
    assert sorted(map(tuple, back.collect())) == sorted(raw)
    keys = back.select(c.event_key(F.col("date"), F.col("day"), F.col("period")).alias("k")).collect()
    assert {r.k for r in keys} == {"0000044200", "090210"}
    inferred = files.read_csv(spark, str(tmp_path / "raw"), None)
    assert dict(inferred.dtypes)["date"] == "double"
    assert files.preview(back, 1).count() == 1
    assert files.schema_rows(back)[0] == ("date", "string", True)


def test_key_rules(spark):
    df = spark.createDataFrame([("0.1", "1", None), ("1", "11", "1")], "a string, b string, p string")
    got = [r.k for r in df.select(c.event_key(F.col("a"), F.col("b"), F.col("p")).alias("k")).collect()]
    assert got == [None, "1111"]
    legacy = spark.createDataFrame([("007",), ("0",), ("00a",), ("10",), (None,)], "k string")
    assert [r.k for r in legacy.select(c.legacy_key(F.col("k")).alias("k")).collect()] == ["7", "0", "00a", "10", None]
    parts = spark.createDataFrame([("1", "11"), ("11", "1"), ("2", "2")], "x string, y string")
    clash = quality.key_collisions(parts.withColumn("k", F.concat("x", "y")), "k", ["x", "y"])
    assert [tuple(r) for r in clash.collect()] == [("111", 2)]


def test_label_rules(spark):
    df = spark.createDataFrame([("UP",), ("DOWN",), ("odd",), (None,)], "l string")
    got = df.select(*[c.encode_label(F.col("l"), u).alias(u) for u in ("up", "down", "null")]).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (0, 0, 0), (1, 0, None), (1, 0, None)]
    pairs = spark.createDataFrame([("UP", "UP"), ("UP", "DOWN"), ("UP", None), (None, None)], "p string, t string")
    ok = pairs.select(c.is_correct(F.col("p"), F.col("t")).alias("ok")).collect()
    assert [r.ok for r in ok] == [True, False, False, False]


def test_decode_and_rejects(spark):
    good = {KEY: 17, **dict.fromkeys(FEATURES, 1.5)}
    lines = [
        json.dumps(good),
        "not json",
        json.dumps({**good, FEATURES[0]: "x"}),
        json.dumps({k: v for k, v in good.items() if k != FEATURES[4]}),
        json.dumps({k: v for k, v in good.items() if k != KEY}),
        json.dumps({**good, FEATURES[1]: float("nan")}),
        None,
    ]
    raw = spark.createDataFrame([(i, x and x.encode()) for i, x in enumerate(lines)], "n int, value binary")
    decoded = decode_json(raw, FEATURE_EVENT, keep=["n"])
    assert decoded.count() == len(lines) and decoded.columns == ["n", KEY, *FEATURES]
    ok, bad = split_rejects(decoded)
    assert [(r.n, r[KEY]) for r in ok.collect()] == [(0, "17")]
    assert {r.n: r.reason for r in bad.collect()} == {
        1: "no key", 2: "bad nswprice", 3: "bad transfer", 4: "no key", 5: "bad nswdemand", 6: "no key",
    }


def test_constraints(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "long"), (None, "x")], f"{KEY} string, v string")
    got = {(r.rule, r.column): r.violations for r in quality.constraint_violations(df, KEY, [KEY, "v"], {"v": 3}).collect()}
    assert got == {("unique", KEY): 2, ("not null", KEY): 1, ("not null", "v"): 1, ("length", "v"): 1}
    none = quality.constraint_violations(df.limit(0), KEY, [KEY], {"v": 3})
    assert all(r.violations == 0 for r in none.collect())


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumn(KEY, F.col("id").cast("string")).withColumn("t", F.col("id") % 7)
    first, second = sampling.hash_split(df)
    again, _ = sampling.hash_split(df.repartition(64))
    assert sorted(r.id for r in first.collect()) == sorted(r.id for r in again.collect())
    assert first.count() + second.count() == 5000 and 3850 < first.count() < 4150
    for n in (1, 7):
        past, live = sampling.chrono_split(df.repartition(n), ["t", "id"], 1234)
        want = sorted((i % 7, i) for i in range(5000))[:1234]
        assert sorted((r.t, r.id) for r in past.collect()) == want and live.count() == 5000 - 1234
    past, live = sampling.chrono_split(df, ["t", "id"], 9999)
    assert past.count() == 5000 and live.isEmpty()


def test_latest_labelled_and_guard(spark):
    rows = [(str(i), "UP" if i % 3 else None, i // 10) for i in range(100)]
    df = spark.createDataFrame(rows, f"{KEY} string, true_label string, label_arrival_time int")
    top = [r[KEY] for r in sampling.latest_labelled(df, 9).collect()]
    labelled = sorted([r for r in rows if r[1]], key=lambda r: (-r[2], r[0]))
    assert top == [r[0] for r in labelled[:9]]
    assert sampling.retrain_rows(df, 66).count() == 66
    assert sampling.retrain_rows(df, 67).isEmpty()


def test_source_options():
    options = logs.kafka_options("a:1,b:2", "t", max_offsets=500)
    assert options["maxOffsetsPerTrigger"] == "500" and options["startingOffsets"] == "earliest"
    assert database.partition_options("id", 0, 100, 4)["numPartitions"] == "4"
    with pytest.raises(ValueError):
        database.partition_options("id", 0, 100, 0)


def test_batches_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], f"{KEY} string, v int")
    append_idempotent(batch, path, KEY, 0)
    append_idempotent(batch, path, KEY, 0)  # replay
    append_idempotent(batch.filter("v < 3").union(spark.createDataFrame([("c", 9)], batch.schema)), path, KEY, 1)
    append_idempotent(batch.limit(0), path, KEY, 2)
    append_idempotent(batch, path, KEY, 9)
    got = sorted(map(tuple, files.read_table(spark, path).select(KEY, "v", "batch_id").collect()))
    assert got == [("a", 1, 0), ("b", 3, 0), ("c", 9, 1)]
    assert files.read_table(spark, str(tmp_path / "none")) is None
    assert files.read_before(spark, path, 0) is None
    assert files.read_before(spark, path, 1).count() == 2
    files.drop_before(spark, path, 11, keep=10)
    assert files.read_table(spark, path).select("batch_id").distinct().count() == 1


def test_reasons_tell_malformed_from_missing(spark):
    from driftline.operators.decode import reject_records

    good = '"a":1,"b":2.5'
    texts = ["", "{", "[1]", "7", "null", f'{{{good}}}', f'{{"k":null,{good}}}', f'{{"k":{{}},{good}}}', f'{{"k":"x",{good}}}', f'{{"k":5,{good}}}']
    texts += ['{"k":"x","a":1}', '{"k":"x","a":null,"b":"2"}', '{"k":"x","a":true,"b":"2"}', '{"k":"x","a":1,"b":1e400}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    got = {r.i: r.reason for r in reject_records(df, key="k", features=["a", "b"]).collect()}
    assert got[0] == got[1] == got[14] == "not json"
    assert {got[i] for i in (2, 3, 4, 5, 6, 7)} == {"no key"} and 8 not in got and 9 not in got
    assert (got[10], got[11], got[12]) == ("missing b", "missing a", "bad type a,b")
