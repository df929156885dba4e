"""Tables by key, the reorder buffer, and what the monitors read and write per batch."""

import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import eddm as ed
from driftline.operators import kswin as kw
from driftline.operators.thin import _block_map, _chain, _compose
from driftline.schemas import KEY
from driftline.sources.files import batches_of, read_batch, read_table
from driftline.sources.keyed import KeyedTable, append_idempotent
from driftline.streaming import monitors as mo
from driftline.streaming.reorder import ReorderBuffer
from tests.test_detectors import ok_frame, sequences, shifted
from tests.test_streams import rows


def table_rows(df):
    return [] if df is None else sorted(map(tuple, df.select("k", "v").collect()))


@pytest.mark.parametrize("replaces", [False, True])
def test_keyed_table_equals_a_dictionary(spark, tmp_path, replaces):
    rng = random.Random(7)
    table = KeyedTable(str(tmp_path / "t"), ["k"], replaces, buckets=3, fan=2)
    known: dict[str, list[int]] = {}
    for batch in range(9):
        new = [(rng.choice("abcdefgh"), rng.randrange(100)) for _ in range(rng.randrange(5))]
        gone = rng.sample("abcdefgh", rng.randrange(3))
        active = spark.createDataFrame([(k,) for k in "abxh"], "k string")
        before = sorted((k, v) for k, vs in known.items() for v in vs if k in "abxh")
        assert table_rows(table.find(spark, batch, active)) == before
        for _ in range(2):  # and a replay
            table.put(batch, spark.createDataFrame(new, "k string, v int"), spark.createDataFrame([(k,) for k in gone], "k string"))
        for k in {*gone, *([k for k, _ in new] if replaces else [])}:
            known.pop(k, None)
        for k, v in new:
            known.setdefault(k, []).append(v)
        assert table_rows(table.everything(spark)) == sorted((k, v) for k, vs in known.items() for v in vs)
        live = [v for v in table._index(spark, batch + 1)[0] if v.until is None]
        assert max((sum(v.bucket == b for v in live) for b in range(3)), default=0) <= 4
    with pytest.raises(FileNotFoundError):
        KeyedTable(str(tmp_path / "none"), ["k"]).find(spark, 5, active, f"{table.path}/rows/merged=0")


def elsewhere(df, table, key):
    """Rows whose key is in another bucket than `key`."""
    own = df.sparkSession.createDataFrame([(key,)], "k string").select(table._bucket()).first()[0]
    return df.filter(table._bucket() != own)


def test_untouched_buckets_are_neither_read_nor_written(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["k"], True, buckets=64)
    idle = spark.range(1100).select(F.concat(F.lit("idle"), "id").alias("k"), F.col("id").cast("int").alias("v"))
    table.put(0, elsewhere(idle, table, "hot"))
    hot = spark.createDataFrame([("hot", 1)], "k string, v int")
    for batch in range(1, 6):
        table.put(batch, hot)
        versions, schema = table._index(spark, batch + 1)
        assert table.wrote(spark, batch).select("k").collect() == [("hot",)]
        assert sum(v.batch == batch and v.until is None for v in versions) == 1
        own = [v for v in versions if v.until is None and v.batch > 0]
        assert len(own) < 4 and len({v.bucket for v in own}) == 1
        assert table._rows(spark, own, schema).filter("k <> 'hot'").isEmpty()
        assert table_rows(table.find(spark, batch + 1, hot)) == [("hot", 1)]
    assert table.everything(spark).count() > 1000


def test_append_opens_few_files_however_long_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    opened = []
    for batch in range(14):
        rows_ = spark.range(batch * 50, batch * 50 + 60).select(F.col("id").cast("string").alias(KEY), F.lit(batch).alias("v"))
        index = KeyedTable(f"{path}_keys", [KEY], buckets=4)
        opened.append(len([v for v in index._index(spark, batch)[0] if v.until is None]))
        append_idempotent(rows_, path, KEY, batch, buckets=4)
    got = read_table(spark, path)
    assert got.count() == got.select(KEY).distinct().count() == 710
    assert got.groupBy("batch_id").count().filter("batch_id > 0 and count <> 50").isEmpty()
    assert max(opened) <= 4 * 2 * 3 and opened[13] <= opened[3] * 2  # fewer than `fan` versions a level
    (tmp_path / "t_keys").rename(tmp_path / "away")  # a table from before there was an index
    append_idempotent(spark.createDataFrame([("7", 99), ("x", 99)], f"{KEY} string, v int"), path, KEY, 30, buckets=4)
    assert read_batch(spark, path, 30).select(KEY).collect() == [("x",)]


def test_reorder_buffer_releases_in_order_of_time(spark, tmp_path):
    rng = random.Random(3)
    late, buffer = str(tmp_path / "late"), str(tmp_path / "buffer")
    made = lambda: ReorderBuffer(buffer, "t", 50, late)
    sent = sorted(range(400), key=lambda t: t + rng.uniform(0, 45))
    sent[120:120] = [0, 1]  # long after their time
    batches = [sent[i : i + 60] for i in range(0, len(sent), 60)]
    released, mark = [], None
    for b, times in enumerate(batches):
        df = spark.createDataFrame([(t,) for t in times] + [(None,)], "t long")
        for _ in range(2):  # and a replay
            reorder = made()
            got = sorted(r.t for r in reorder.release(df, b).collect())
        assert not released or not got or got[0] >= released[-1]
        released += got
        reorder.commit(spark, b)
        mark = max(times + ([mark + 50] if mark is not None else [])) - 50
        assert released == sorted({t for p in batches[: b + 1] for t in p if t < mark})
        assert len(batches_of(spark, f"{buffer}/rows")) <= 4
    waiting, number = made().rest(spark)
    assert number == len(batches) and released + sorted(r.t for r in waiting.collect()) == list(range(400))
    assert sorted((r.t is None, r.t) for r in read_table(spark, late).filter("t is not null").collect()) == [(False, 0), (False, 1)]
    assert read_table(spark, late).filter("t is null").count() == len(batches)


def test_monitors_with_rows_out_of_order_equal_batch(spark, tmp_path):
    data = sequences({"hot": 500, "b": 60})
    df = ok_frame(spark, data)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    reorder = ReorderBuffer(str(tmp_path / "buffer"), "t", 100)
    mixed = df.withColumn("part", F.expr("least(2, (t + pmod(hash(k, t), 90)) div 200)")).persist()
    for b in range(3):
        mo.in_order(reorder, mixed.filter(F.col("part") == b).drop("part"), b, lambda r, b=b: mo.errors_step(r, b, ["k"], ["t"], "ok", out, state))
    mo.finish_errors(spark, ["k"], ["t"], "ok", out, state, reorder)
    columns = ["k", "pos", "status", "num_errors", F.round("ratio", 9), F.round("mean_distance", 9)]
    assert rows(read_table(spark, out), *columns) == rows(ed.eddm(df, ["k"], ["t"], "ok"), *columns)


def test_feature_state_of_idle_keys_is_left_alone(spark, tmp_path):
    """A thousand idle keys: a batch of another key reads and writes its own state only."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    idle = spark.range(3000).select(F.concat(F.lit("i"), F.col("id") % 1000).alias("k"), F.expr("id div 1000").alias("t"), F.lit(1.0).alias("x"))
    hot = spark.createDataFrame([("hot", t, float(v[0])) for t, v in enumerate(shifted(500, 1))], "k string, t long, x double")
    options = dict(features=["x"], reference=100, current=34, buckets=64)
    idle = elsewhere(idle, KeyedTable("", ["k"], buckets=64), "hot")
    mo.features_step(idle, 0, ["k"], ["t"], out, state, **options)
    for b, (low, high) in enumerate(((0, 200), (200, 210), (210, 500)), 1):
        mo.features_step(hot.filter(F.col("t").between(low, high - 1)), b, ["k"], ["t"], out, state, **options)
        for part in ("totals", "tail"):
            table = KeyedTable(f"{state}/{part}", ["k"], True, buckets=64)
            assert table.wrote(spark, b).select("k").distinct().collect() == [("hot",)]
            new = [v for v in table._index(spark, b + 1)[0] if v.batch == b]
            assert len({v.bucket for v in new}) == 1
    key = ["feature", "pos", "h"]
    want = rows(kw.kswin(hot, ["k"], ["t"], features=["x"], reference=100, current=34), *key)
    assert rows(read_table(spark, out), *key) == want and len(want) > 1


def test_composed_maps_stay_small_and_right():
    gap, length = 50, 200
    pos = np.unique(np.random.default_rng(1).integers(1, 200 * length, 30_000))  # dense: nearly every position
    blocks = [(c, pos[(pos - 1) // length == c]) for c in range(200)]
    maps = [_block_map(p, c * length + 1, gap) for c, p in blocks]
    whole = maps[0]
    for m in maps[1:]:
        whole = _compose(whole, m, 1 + gap)
        assert len(whole[0]) <= gap + 1
    for free in range(1, gap + 1):
        kept = pos[_chain(pos, free, gap)]
        i = np.searchsorted(whole[0], free)
        assert whole[1][i] == kept[-1] + gap


def label_batches(spark):
    at = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + c * 60)
    predictions = spark.range(300).select(F.col("id").cast("string").alias(KEY), F.lit("UP").alias("predicted_label"), at(F.col("id")).alias("prediction_time"))
    labels = spark.range(300).filter("id % 5 <> 0").select(
        F.when(F.col("id") % 50 == 1, F.concat(F.lit("x"), "id")).otherwise(F.col("id").cast("string")).alias(KEY),
        F.lit("UP").alias("label"),
        at(F.col("id") + 3).alias("label_arrival_time"),
    )
    return predictions, labels


@pytest.mark.parametrize("max_wait", [None, timedelta(minutes=60)])
def test_followed_labels_write_what_changes_and_expire(spark, tmp_path, max_wait):
    from driftline.sources.logs import read_log

    predictions, labels = label_batches(spark)
    tables = mo.LabelTables(*[str(tmp_path / n) for n in mo.LabelTables._fields])
    for low in range(0, 300, 50):
        inside = f"pmod(cast(ltrim('x', {KEY}) as int), 300) between {low} and {low + 49}"
        predictions.filter(inside).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
        labels.filter(inside).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        streams = [read_log(spark, "parquet", d.schema, str(tmp_path / n)) for d, n in ((predictions, "p"), (labels, "l"))]
        mo.follow_labels(*streams, [], ["label_arrival_time", KEY], tables, str(tmp_path / "c"), max_wait=max_wait, buckets=4).awaitTermination()
    never = {str(i) for i in range(300) if i % 5 == 0 or i % 50 == 1}
    strange = {f"x{i}" for i in range(1, 300, 50)}
    pending = {r[KEY] for r in KeyedTable(tables.pending, [KEY]).everything(spark).collect()}
    orphans = {r[KEY] for r in KeyedTable(tables.orphans, [KEY]).everything(spark).collect()}
    assert read_table(spark, tables.labelled).count() == 300 - len(never)
    last = 299 + 3  # minutes at the last label
    if max_wait is None:
        assert pending == never and orphans == strange
        # A batch writes its own rows, however many wait.
        table = KeyedTable(tables.pending, [KEY])
        assert table.wrote(spark, batches_of(spark, f"{tables.pending}/index")[-1]).count() <= 11
    else:
        expired = read_table(spark, tables.expired)
        assert {r[KEY] for r in expired.filter("kind = 'prediction'").collect()} == {k for k in never if int(k) < last - 60}
        assert {r[KEY] for r in expired.filter("kind = 'label'").collect()} == {k for k in strange if int(k[1:]) + 3 < last - 60}
        assert pending == {k for k in never if int(k) >= last - 60} and orphans == {k for k in strange if int(k[1:]) + 3 >= last - 60}
