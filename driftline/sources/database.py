"""Tables in a database reached by JDBC; the driver jar comes with the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def partition_options(column: str, lower, upper, partitions: int) -> dict:
    """Options that make a table scan run as `partitions` range queries; the bounds cut no rows off."""
    if partitions < 1:
        raise ValueError("partitions must be positive")
    return {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_jdbc(
    spark: SparkSession, url: str, table: str, properties: dict, ranges: dict, fetch: int = 10_000
) -> DataFrame:
    """Scan of a table in `ranges` (see `partition_options`); without them it would run in one task."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch, **properties)
    return reader.options(**ranges).load()


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict, connections: int = 16) -> None:
    """Append by at most `connections` parallel writers, in bulk inserts."""
    writer = df.write.format("jdbc").mode("append")
    writer.options(url=url, dbtable=table, numPartitions=connections, batchsize=10_000, **properties).save()
