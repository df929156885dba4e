import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from driftline.functions.columns import encode_label
from driftline.operators import labels as lb
from driftline.operators import retrain as rt
from driftline.operators import scoring
from driftline.plans import views
from driftline.schemas import KEY, PREDICTION_COLUMNS
from tests.conftest import SF001
from tests.recurrence import thinned


def test_label_joins(spark):
    predictions = spark.createDataFrame(
        [("a", "UP", "v1"), ("b", "DOWN", "v1"), ("c", "UP", "v2")], f"{KEY} string, predicted_label string, model_version string"
    )
    log = spark.createDataFrame(
        [("a", "UP", 1), ("a", "DOWN", 3), ("a", "UP", 2), ("b", None, 1), ("z", "UP", 1), (None, "UP", 5)],
        f"{KEY} string, label string, label_arrival_time int",
    )
    latest = lb.latest_label(log)
    assert {r[KEY]: r.label for r in latest.collect()} == {"a": "DOWN", "b": None, "z": "UP"}
    joined = {r[KEY]: r.is_correct for r in lb.join_labels(predictions, latest).collect()}
    assert joined == {"a": False, "b": False}
    assert [r[KEY] for r in lb.pending_predictions(predictions, latest).collect()] == ["c"]
    assert {r[KEY] for r in lb.orphan_labels(predictions, log).collect()} == {"z", None}
    view = {r[KEY]: r.true_label for r in lb.prediction_view(predictions, log).collect()}
    assert view == {"a": "DOWN", "b": None, "c": None}


def test_attach_does_not_multiply(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], f"{KEY} string, v int")
    right = spark.createDataFrame([("a", 7), ("a", 5), (None, 1)], f"{KEY} string, w int")
    got = sorted(map(tuple, lb.attach_by_key(left, right, KEY, ["w"]).collect()))
    assert got == [("a", 1, 5), ("a", 2, 5)]


def test_expression_score_equals_model(spark, tmp_path):
    rows = views.truth(spark, SF001).withColumn("label", encode_label(F.col("label")))
    model = scoring.fit(rows)
    ours = scoring.score(rows, scoring.LinearModel.of(model)).select(KEY, "prediction")
    theirs = model.transform(scoring.feature_vector(rows)).select(KEY, F.col("prediction").alias("other"))
    assert ours.join(theirs, KEY).filter("prediction <> other").isEmpty() and ours.count() == 1000
    model.setThreshold(0.7)
    theirs = model.transform(scoring.feature_vector(rows)).select(KEY, F.col("prediction").alias("other"))
    ours = scoring.score(rows, scoring.LinearModel.of(model)).select(KEY, "prediction")
    assert ours.join(theirs, KEY).filter("prediction <> other").isEmpty()
    got = scoring.accuracy(scoring.score(rows, scoring.LinearModel.of(model))).first()
    assert got.rows == 1000 and 0.6 < got.accuracy <= 1


def test_missing_feature_is_skipped_in_training(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "x double, y double")
    assert scoring.feature_vector(df, ["x", "y"]).count() == 1


def test_prediction_row_layout(spark):
    rows = scoring.prediction_rows(scoring.score(views.features(spark, SF001), views.MODEL_1), "lr_v1")
    assert rows.columns == PREDICTION_COLUMNS
    assert dict(rows.dtypes)["label_arrival_time"] == "timestamp" and dict(rows.dtypes)["true_label"] == "string"
    assert rows.filter("true_label is not null or model_version <> 'lr_v1' or prediction_time is null").isEmpty()


def test_train_retrain_and_registry(spark, tmp_path):
    registry, models = str(tmp_path / "registry"), str(tmp_path / "models")
    cache = rt.ModelCache(spark, registry)
    base = views.truth(spark, SF001).withColumn("label", encode_label(F.col("label")))
    rt.train_version(base, registry, models, 1)
    name, first = cache.current()
    assert name == "lr_v1" and cache.current()[1] is first
    table = views.labelled(spark, SF001)
    assert rt.retrain(table, registry, models, rows=5000) is None
    assert cache.current()[0] == "lr_v1"
    assert rt.retrain(table, registry, models, rows=500) is not None
    name, second = cache.current()
    assert name == "lr_v2" and second is not first
    entry = rt.current_model(rt.read_registry(spark, registry)).first()
    assert (entry.version, entry["rows"]) == (2, 500)
    assert LogisticRegressionModel.load(entry.path).getRegParam() == 0.0
    rt.register(spark, registry, 3, "lr_v3", f"{models}/absent", 0)
    with pytest.raises(FileNotFoundError):
        cache.current()


def requests_by_rows(drifts, finishes, cooldown, timeout):
    """One pass in order of position: what is running, since when, and what ended last."""
    running, ended, out = None, None, []
    events = sorted([(p, 0) for p in finishes] + [(p, 1) for p in drifts])
    for pos, kind in events:
        if kind == 0:
            running, ended = None, pos
            continue
        if ended is not None and pos < ended + cooldown:
            continue
        if running is None or (timeout and pos >= running + timeout):
            running = pos
            out.append(pos)
    return out


@pytest.mark.parametrize("cooldown,timeout", [(0, None), (15, None), (0, 40), (25, 60)])
def test_retrain_requests(spark, cooldown, timeout):
    drifts = {"v1": [*range(10, 200, 3), 400, 401], "v2": [5, 6, 300]}
    finishes = {"v1": [34, 100, 399], "v2": []}
    make = lambda d: spark.createDataFrame([(k, p) for k, ps in d.items() for p in ps], "k string, pos bigint")
    got = rt.retrain_requests(make(drifts), make(finishes), ["k"], cooldown, timeout).collect()
    for k in drifts:
        want = requests_by_rows(drifts[k], finishes[k], cooldown, timeout)
        assert sorted(r.pos for r in got if r.k == k) == want


def test_timeout_is_thinning_within_an_open_span(spark):
    drifts = spark.createDataFrame([("v", p) for p in range(1, 500, 7)], "k string, pos bigint")
    got = rt.retrain_requests(drifts, drifts.limit(0), ["k"], timeout=50)
    assert sorted(r.pos for r in got.collect()) == thinned(range(1, 500, 7), 50)


def test_writers_never_share_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "registry")

    def write(n):
        version = rt.next_version(spark, root)
        rt.register(spark, root, version, f"lr_v{version}", f"m{n}", n)
        return version

    with ThreadPoolExecutor(6) as writers:
        versions = list(writers.map(write, range(6)))
    stored = rt.read_registry(spark, root).collect()
    assert sorted(versions) == sorted(r.version for r in stored) == [1, 2, 3, 4, 5, 6]
    assert sorted(r.path for r in stored) == [f"m{n}" for n in range(6)] and rt.next_version(spark, root) == 7
