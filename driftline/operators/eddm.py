"""Early drift detection on the distance between errors.

For error i at position p_i: distance d_i = p_i - p_(i-1), mean m_i = p_i / i (the distances add up to
the position), s_i the sample deviation of d_1..d_i, c_i = m_i + 2 s_i. From error `min_errors` on, the
ratio of c_i to the largest c so far (from the second error) is compared with the two thresholds.

Every part is a running sum or maximum, so the work is split into ordered blocks: only errors are
shuffled a second time, and one key may span any number of tasks. Squares are summed as exact
integers, so results do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.scan import BLOCK, ROW, earlier_blocks, join_totals, ordered_blocks, within_block
from driftline.schemas import EDDM_DRIFT, EDDM_MIN_ERRORS, EDDM_WARNING
from driftline.session import materialise

WIDE = "decimal(38,0)"
STATE = {"n": "bigint", "errors": "bigint", "last": "bigint", "squares": WIDE, "best": "double"}


class EddmRun(NamedTuple):
    rows: DataFrame
    state: DataFrame


def _with_state(carry: DataFrame, keys: list[str], state: DataFrame | None) -> DataFrame:
    """Attach the totals left by earlier input to every block of a key."""
    if state is None:
        return carry.withColumns({f"_s_{c}": F.lit(0).cast(t) for c, t in STATE.items()})
    prior = state.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in STATE])
    joined = join_totals(carry, prior, keys, "left")
    return joined.withColumns({f"_s_{c}": F.coalesce(f"_s_{c}", F.lit(0).cast(t)) for c, t in STATE.items()})


def _spread(i: Column, p: Column, squares: Column) -> Column:
    """m + 2 s of the first i distances, from their sum p and the sum of their squares."""
    exact = i.cast("decimal(18,0)") * squares - (p.cast("decimal(18,0)") * p.cast("decimal(18,0)")).cast(WIDE)
    n = i.cast("double")
    variance = exact.cast("double") / (n * (n - 1))
    return F.when(i >= 2, p / n + 2 * F.sqrt(variance))


def _locate(
    df: DataFrame, keys: list[str], order: Sequence[str], ok: str, state: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """Rows with `pos`, and per block the counts and what the blocks before it left.

    The rows carry the error number (`_e0`) and the error position (`_p0`) their block starts from.
    A missing verdict counts as an error.
    """
    columns = [c for c in df.columns if c != ok]
    rows = ordered_blocks(df.select(*columns, F.coalesce(ok, F.lit(False)).alias("_ok")), keys, order)
    bad = F.when(~F.col("_ok"), F.col(ROW))
    counts = rows.groupBy(*keys, BLOCK).agg(
        F.min(ROW).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
        F.count(bad).alias("_e"),
        F.max(bad).alias("_last_row"),
    )
    before = earlier_blocks(keys)
    carry = _with_state(counts, keys, state).withColumns(
        {
            "_n0": F.col("_s_n") + F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_e0": F.col("_s_errors") + F.coalesce(F.sum("_e").over(before), F.lit(0)),
        }
    )
    carry = carry.withColumn("_last", F.col("_n0") + F.col("_last_row") - F.col("_first") + 1)
    carry = materialise(carry.withColumn("_p0", F.greatest("_s_last", F.max("_last").over(before))), "carry")
    located = rows.join(carry.select(*keys, BLOCK, "_first", "_n0", "_e0", "_p0"), [*keys, BLOCK])
    return located.withColumn("pos", F.col("_n0") + F.col(ROW) - F.col("_first") + 1).drop("_first", "_n0"), carry


def _distances(located: DataFrame, keys: list[str]) -> DataFrame:
    """Errors with their number and their distance from the error before (from 0 for the first)."""
    rows = Window.partitionBy(*keys, BLOCK).orderBy(ROW)
    return located.filter(~F.col("_ok")).withColumns(
        {
            "distance": F.col("pos") - F.coalesce(F.lag("pos").over(rows), F.col("_p0")),
            "num_errors": F.col("_e0") + F.row_number().over(rows),
        }
    )


def error_distance(df: DataFrame, keys: Sequence[str], order: Sequence[str], ok: str) -> DataFrame:
    """Errors with their position and the distance from the error before."""
    keys = list(keys)
    located, _ = _locate(df, keys, order, ok, None)
    return _distances(located, keys).select(*[c for c in df.columns if c != ok], "pos", "distance")


def eddm_run(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    ok: str,
    warning: float = EDDM_WARNING,
    drift: float = EDDM_DRIFT,
    min_errors: int = EDDM_MIN_ERRORS,
    state: DataFrame | None = None,
    errors_only: bool = False,
) -> EddmRun:
    """Detector rows for `df`, and the state to hand to the next call on later input.

    `keys` also serve as the reset: a new key value (a new model version, say) starts afresh.
    With `errors_only` the rows of correct predictions are left out.
    """
    keys = list(keys)
    columns = [c for c in df.columns if c != ok]
    before, here = earlier_blocks(keys), within_block(keys)
    zero = F.lit(0).cast(WIDE)

    # Pass 1 over all rows: positions and error numbers.
    located, carry = _locate(df, keys, order, ok, state)

    # Pass 2 over errors only: distances and the running sum of their squares.
    wide = F.col("distance").cast("decimal(18,0)")
    errors = _distances(located, keys).withColumn("_q", F.sum(wide * wide).over(here).cast(WIDE))
    errors = materialise(errors.drop("_ok", "_e0", "_p0"), "errors")
    squares = errors.groupBy(*keys, BLOCK).agg(F.max("_q").alias("_q"))
    carry = carry.join(squares, [*keys, BLOCK], "left").withColumn("_q", F.coalesce("_q", zero))
    earlier = F.coalesce(F.sum("_q").over(before), zero)
    carry = carry.withColumn("_q0", (F.col("_s_squares") + earlier).cast(WIDE))

    # Pass 3: c of every error, then its running maximum.
    errors = errors.join(carry.select(*keys, BLOCK, "_q0"), [*keys, BLOCK]).withColumn(
        "_c", _spread(F.col("num_errors"), F.col("pos"), (F.col("_q0") + F.col("_q")).cast(WIDE))
    )
    best = errors.groupBy(*keys, BLOCK).agg(F.max("_c").alias("_c"))
    carry = carry.join(best, [*keys, BLOCK], "left").withColumn("_c", F.coalesce("_c", F.lit(0.0)))
    earlier = F.coalesce(F.max("_c").over(before), F.lit(0.0))
    carry = carry.withColumn("_c0", F.greatest("_s_best", earlier))

    shown = errors.select(*columns, BLOCK, ROW, "pos", "distance", "num_errors", "_c", F.col("pos").alias("_p"))
    if not errors_only:
        fine = located.filter("_ok").select(*columns, BLOCK, ROW, "pos")
        shown = shown.unionByName(fine, allowMissingColumns=True)
    done = shown.join(carry.select(*keys, BLOCK, "_e0", "_p0", "_c0"), [*keys, BLOCK]).withColumns(
        {
            "_i": F.greatest(F.col("_e0"), F.max("num_errors").over(here)),
            "_at": F.greatest(F.col("_p0"), F.max("_p").over(here)),
            "max_mean_std": F.greatest(F.col("_c0"), F.max("_c").over(here)),
        }
    )
    ratio = F.when(F.col("num_errors") >= min_errors, F.col("_c") / F.col("max_mean_std"))
    status = F.when(ratio < drift, "drift").when(ratio < warning, "warning").otherwise("normal")
    result = done.select(
        *columns,
        "pos",
        "distance",
        status.alias("status"),
        F.coalesce((ratio < warning) & (ratio >= drift), F.lit(False)).alias("warning"),
        F.coalesce(ratio < drift, F.lit(False)).alias("drift"),
        ratio.alias("ratio"),
        F.col("pos").alias("num_instances"),
        F.col("_i").alias("num_errors"),
        F.when(F.col("_i") > 0, F.col("_at") / F.col("_i")).otherwise(F.lit(0.0)).alias("mean_distance"),
        "max_mean_std",
    )

    # All totals only grow, so the state of a key is the maximum over its blocks.
    ends = carry.select(
        *keys,
        (F.col("_n0") + F.col("_n")).alias("n"),
        (F.col("_e0") + F.col("_e")).alias("errors"),
        F.greatest("_p0", "_last").alias("last"),
        (F.col("_q0") + F.col("_q")).cast(WIDE).alias("squares"),
        F.greatest("_c0", "_c").alias("best"),
    )
    if state is not None:
        ends = ends.unionByName(state.select(*keys, *STATE))
    return EddmRun(result, ends.groupBy(*keys).agg(*[F.max(c).alias(c) for c in STATE]))


def eddm(df: DataFrame, keys: Sequence[str], order: Sequence[str], ok: str, **options) -> DataFrame:
    """Detector result for every instance, see `eddm_run`."""
    return eddm_run(df, keys, order, ok, **options).rows
