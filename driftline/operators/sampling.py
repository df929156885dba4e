"""Splits, cuts and latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.columns import draw_hash, hash_share
from driftline.operators.scan import ordered_index
from driftline.schemas import KEY, KS_SEED, PAST_ROWS, RETRAIN_ROWS, TRAIN_SEED, TRAIN_SHARE


def chrono_split(df: DataFrame, order: Sequence[str], rows: int = PAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The first `rows` rows in `order`, and the rest.

    Only the order columns are indexed to find the row at the cut; the table itself is filtered in place.
    """
    place = F.struct(*order)
    cut = ordered_index(df.select(*order), [], order).filter(F.col("pos") == rows).select(*order).first()
    if cut is None:
        return df, df.limit(0)
    last = F.struct(*[F.lit(cut[c]).cast(df.schema[c].dataType).alias(c) for c in order])
    return df.filter(place <= last), df.filter(place > last)


def hash_split(
    df: DataFrame, key: str = KEY, share: float = TRAIN_SHARE, seed: int = TRAIN_SEED
) -> tuple[DataFrame, DataFrame]:
    """Random split by key: the same rows on every run, however the table is partitioned."""
    place = hash_share(F.col(key), seed)
    return df.filter(place < share), df.filter(place >= share)


def draw_sample(df: DataFrame, keys: Sequence[str], rows: int, position: str = "pos", seed: int = KS_SEED) -> DataFrame:
    """Random `rows` rows per key without replacement: those whose position has the smallest hashes.

    The rank filter lets Spark cut every task down to its own `rows` smallest per key before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(draw_hash(F.col(position), seed), position))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= rows).drop("_rank")


def latest_labelled(
    df: DataFrame, rows: int = RETRAIN_ROWS, arrival: str = "label_arrival_time", key: str = KEY
) -> DataFrame:
    """The labelled rows that came last; equal arrivals are ordered by key."""
    return df.filter(F.col("true_label").isNotNull()).orderBy(F.col(arrival).desc(), F.col(key)).limit(rows)


def enough_labelled(df: DataFrame, rows: int = RETRAIN_ROWS) -> bool:
    """Whether `rows` labelled rows exist; stops counting there."""
    return df.filter(F.col("true_label").isNotNull()).select("true_label").limit(rows).count() >= rows


def retrain_rows(df: DataFrame, rows: int = RETRAIN_ROWS, **columns) -> DataFrame:
    """The rows to retrain on: the latest `rows` labelled ones, or none if there are fewer."""
    latest = latest_labelled(df, rows, **columns)
    return latest if enough_labelled(df, rows) else latest.limit(0)
