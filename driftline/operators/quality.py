"""Checks that take the place of table constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.schemas import KEY, PREDICTION_WIDTHS


def constraint_violations(
    df: DataFrame,
    key: str = KEY,
    required: Sequence[str] = (KEY,),
    widths: Mapping[str, int] = PREDICTION_WIDTHS,
) -> DataFrame:
    """Rows of (rule, column, violations).

    Rules are `unique` (rows beyond the first of a key), `not null` and `length`. One scan serves the
    row rules; keys are counted per task before the shuffle.
    """
    checks = {("not null", c): F.col(c).isNull() for c in required}
    checks |= {("length", c): F.length(c) > width for c, width in widths.items() if c in df.columns}
    counted = df.agg(*[F.count_if(test).alias(f"_{i}") for i, test in enumerate(checks.values())])
    rules = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"), F.col(f"_{i}").alias("violations"))
            for i, (rule, c) in enumerate(checks)
        ]
    )
    repeats = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .count()
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
        .select(F.lit("unique").alias("rule"), F.lit(key).alias("column"), "violations")
    )
    return counted.select(F.inline(rules)).unionByName(repeats)


def key_collisions(df: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """Keys built from more than one combination of parts."""
    return df.groupBy(key).agg(F.count_distinct(*parts).alias("sources")).filter("sources > 1")
