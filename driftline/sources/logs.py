"""Streams of records from a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from driftline.operators.decode import decode_json
from driftline.schemas import FEATURE_EVENT, LABEL_EVENT


def kafka_options(servers: str, topic: str, starting: str = "earliest", max_offsets: int | None = None) -> dict:
    """Source options for one topic. `max_offsets` bounds a batch over all partitions together."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if max_offsets is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def read_log(
    spark: SparkSession, source: str = "kafka", schema: T.StructType | None = None, path: str | None = None, **options
) -> DataFrame:
    """Streaming frame of raw records: `kafka`, or any file format with a schema and a path."""
    reader = spark.readStream.format(source).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def feature_events(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature events of a log; `keep` names envelope columns such as timestamp and offset."""
    return decode_json(log, FEATURE_EVENT, keep=keep)


def label_events(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return decode_json(log, LABEL_EVENT, keep=keep)
