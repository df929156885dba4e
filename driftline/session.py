"""Session settings and the shared scratch folder."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scope = threading.local()


def build_session(master: str | None = None, name: str = "driftline", conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the jobs expect; `conf` adds to them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        # Join and deduplication state lives on disk, not in the executor heap.
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        **(conf or {}),
    }
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: in `spark.checkpoint.dir`, which every executor must reach.

    A session without that setting uses its warehouse, which all executors share as well.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{shared.rstrip('/')}/driftline-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write `df` to the scratch folder and read it back.

    Cuts the lineage in a way that outlives lost executors, fixes values that would change on
    recomputation (row ids), lets later passes read only the columns they need, and tells the
    planner the true size, so that it broadcasts small tables only. `compression` is a codec of Parquet
    files in place of the session's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables materialised inside; use it where results are stored before leaving."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        for path in _scope.paths:
            delete(spark, path)
        _scope.paths = outer


def release_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application."""
    delete(spark, scratch_root(spark))


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
