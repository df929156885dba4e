"""Retraining requests and the registry of models."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.sampling import retrain_rows
from driftline.operators.scan import prefix_scan
from driftline.operators.scoring import LinearModel, fit
from driftline.operators.thin import thin
from driftline.functions.columns import encode_label
from driftline.schemas import FEATURES, REGISTRY, RETRAIN_ROWS
from driftline.session import materialise
from driftline.sources.files import append_file, claim, read_table


def retrain_requests(
    drifts: DataFrame,
    finishes: DataFrame,
    keys: Sequence[str],
    cooldown: int = 0,
    timeout: int | None = None,
) -> DataFrame:
    """Drift rows that start a retraining.

    `drifts` and `finishes` carry `keys` and `pos`. Between two finishes only the first drift makes a
    request, since a retraining then runs; drifts within `cooldown` positions of a finish make none. A
    request that saw no finish for `timeout` positions is given up, and the next drift makes a new one.
    """
    keys = list(keys)
    marks = finishes.select(*keys, "pos", F.lit(0).alias("_kind")).distinct()
    log = drifts.select(*keys, "pos", F.lit(1).alias("_kind")).unionByName(marks)
    ended = {"since": F.when(F.col("_kind") == 0, F.col("pos"))}
    spans = prefix_scan(log, keys, ["pos", "_kind"], maxes=ended, position=None).filter("_kind = 1")
    spans = spans.withColumn("since", F.coalesce("since", F.lit(0))).filter(
        (F.col("since") == 0) | (F.col("pos") >= F.col("since") + cooldown)
    )
    if timeout is None:
        return spans.groupBy(*keys, "since").agg(F.min("pos").alias("pos"))
    spans = materialise(spans.select(*keys, "since", "pos"), "spans")
    return thin(spans, [*keys, "since"], timeout)


def new_requests(
    drifts: DataFrame,
    requests: DataFrame,
    finishes: DataFrame,
    keys: Sequence[str],
    timeout: int | None = None,
    cooldown: int = 0,
) -> DataFrame:
    """Requests that the drifts of one batch add to the log of earlier `requests`.

    A row of `finishes` names the request it ends by `keys` and `pos`. A key with an open request gets
    no other one until `timeout` positions have passed, and none within `cooldown` positions of the request answered last.
    """
    keys = list(keys)
    ended = finishes.groupBy(*keys).agg(F.max("pos").alias("_ended"))
    last = requests.groupBy(*keys).agg(F.max("pos").alias("_last")).join(ended, keys, "left")
    free = F.col("_last").isNull() | ((F.col("_ended") >= F.col("_last")) & (F.col("pos") >= F.col("_ended") + cooldown))
    if timeout is not None:
        free = free | (F.col("pos") >= F.col("_last") + timeout)
    fresh = drifts.select(*keys, "pos").join(last, keys, "left").filter(F.coalesce(free, F.lit(False)))
    return fresh.groupBy(*keys).agg(F.min("pos").alias("pos"))


def current_model(registry: DataFrame) -> DataFrame:
    """The registry row with the highest version; of two with the same version the one trained last."""
    rank = F.struct("version", *[c for c in ("trained_at", "path") if c in registry.columns])
    return registry.agg(F.max_by(F.struct(*registry.columns), rank).alias("_row")).select("_row.*").dropna(
        subset=["version"]
    )


def register(spark: SparkSession, registry_path: str, version: int, name: str, path: str, rows: int) -> None:
    """Append a version. Readers take the highest, so they see the old one or the new one, never a mix."""
    from datetime import datetime, timezone

    entry = [(version, name, path, datetime.now(timezone.utc), rows)]
    append_file(spark.createDataFrame(entry, REGISTRY), registry_path)


def next_version(spark: SparkSession, registry_path: str) -> int:
    """A version number that no other writer gets, above all there are.

    A number is taken by creating its file exclusively beside the registry; who comes second takes the next one. A writer that
    fails afterwards leaves a number unused.
    """
    registry = read_table(spark, registry_path, REGISTRY)
    row = current_model(registry).first()
    version = 1 if row is None else row["version"] + 1
    while not claim(spark, f"{registry_path.rstrip('/')}/_versions/{version}"):
        version += 1
    return version


def read_registry(spark: SparkSession, registry_path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(registry_path)


class ModelCache:
    """The current model, loaded again only when the registry names another one."""

    def __init__(self, spark: SparkSession, registry_path: str):
        self.spark, self.registry_path = spark, registry_path
        self._name: str | None = None
        self._path: str | None = None
        self._model: LinearModel | None = None

    def current(self) -> tuple[str, LinearModel]:
        """Name and model from one registry read, so they always belong together."""
        row = current_model(read_registry(self.spark, self.registry_path)).first()
        if row is None:
            raise FileNotFoundError(f"no model in registry {self.registry_path}")
        if row["path"] != self._path:
            files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
            try:
                files.load(f"{row['path']}/metadata").limit(1).count()
            except Exception as error:
                raise FileNotFoundError(f"model {row['name']} not found at {row['path']}") from error
            self._model = LinearModel.of(LogisticRegressionModel.load(row["path"]))
            self._name, self._path = row["name"], row["path"]
        return self._name, self._model


def train_version(
    df: DataFrame, registry_path: str, models_path: str, version: int | None = None, label: str = "label", features=FEATURES
) -> LogisticRegressionModel:
    """Fit on `df`, save the model and make it the current version; without a `version` it gets a new one of its own."""
    spark = df.sparkSession
    df = df.select(*features, label).persist()
    try:
        model, rows = fit(df, label, features), df.count()
    finally:
        df.unpersist()
    version = version if version is not None else next_version(spark, registry_path)
    name = f"lr_v{version}"
    path = f"{models_path.rstrip('/')}/{name}-{uuid.uuid4().hex}"  # never a path that someone may be reading
    model.write().save(path)
    register(spark, registry_path, version, name, path, rows)
    return model


def retrain(
    table: DataFrame,
    registry_path: str,
    models_path: str,
    rows: int = RETRAIN_ROWS,
    unknown: str = "null",
    features: Sequence[str] = FEATURES,
) -> LogisticRegressionModel | None:
    """Next version from the latest labelled rows, or None if there are too few.

    Rows whose label is neither UP nor DOWN are left out unless `unknown` says otherwise.
    """
    latest = retrain_rows(table, rows).withColumn("label", encode_label(F.col("true_label"), unknown))
    latest = latest.dropna(subset=["label", *features])
    if latest.isEmpty():
        return None
    read_registry(table.sparkSession, registry_path)  # there must be one
    return train_version(latest, registry_path, models_path, features=features)
