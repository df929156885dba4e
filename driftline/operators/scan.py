"""Ordered running totals that stay parallel when one key holds most rows.

A plain window per key sorts the whole key in one task. Here rows are range-partitioned by
(key, order), so a large key spans many partitions ("blocks"); each block is scanned on its own and
starts from the totals of the blocks before it. The table of block totals has at most one row per
partition plus one per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import materialise

BLOCK, ROW = "_block", "_row"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stored copy of `df` with `_block` (range partition) and `_row` (place in the block).

    `order` must be total within a key, so that a range can be cut anywhere. A null key is an error: later
    joins by key would lose its rows.
    """
    checked = {k: F.coalesce(F.col(k), F.raise_error(F.lit(f"null in key column {k}"))) for k in keys}
    ids = (
        df.withColumns(checked)
        .repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    blocks = ids.withColumns(
        {
            BLOCK: F.shiftright("_id", _ROW_BITS).cast("int"),
            ROW: F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    ).drop("_id")
    return materialise(blocks, "blocks")


def join_totals(df: DataFrame, totals: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach one row of `totals` per key; without keys it is a single row, attached as constants."""
    if keys:
        return df.join(totals, list(keys), how)
    row = totals.first()
    return df.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in totals.schema})


def earlier_blocks(keys: Sequence[str]):
    """Frame over the block totals of one key before the current block."""
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def within_block(keys: Sequence[str]):
    """Frame over the rows of one block of one key up to the current row."""
    return (
        Window.partitionBy(*keys, BLOCK).orderBy(ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    position: str | None = "pos",
) -> DataFrame:
    """Add running sums and maxima per key in `order`, and the 1-based position.

    Running sums start at 0; running maxima are null until the first non-null value.
    """
    keys, sums, maxes = list(keys), dict(sums or {}), dict(maxes or {})
    columns = df.columns
    rows = ordered_blocks(df.withColumns({**sums, **maxes}), keys, order)

    totals = rows.groupBy(*keys, BLOCK).agg(
        F.min(ROW).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.max(c).alias(c) for c in maxes],
    )
    before = earlier_blocks(keys)
    carry = materialise(
        totals.select(
            *keys,
            BLOCK,
            "_first",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}0") for c in sums],
            *[F.max(c).over(before).alias(f"_{c}0") for c in maxes],
        ),
        "carry",
    )

    here = within_block(keys)
    out = rows.join(carry, [*keys, BLOCK])
    return out.select(
        *[c for c in columns if c not in sums and c not in maxes],
        *([(F.col("_n0") + F.col(ROW) - F.col("_first") + 1).alias(position)] if position else []),
        *[(F.col(f"_{c}0") + F.coalesce(F.sum(c).over(here), F.lit(0))).alias(c) for c in sums],
        *[F.greatest(F.col(f"_{c}0"), F.max(c).over(here)).alias(c) for c in maxes],
    )


def ordered_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str = "pos") -> DataFrame:
    """1-based position of every row within its key."""
    return prefix_scan(df, keys, order, position=position)
