"""Sliding-window two-sample tests per feature.

At every position the last `current` values are compared with `current` values drawn from the
`reference` values before them. The draw takes the smallest hashes: each position has one hash, so a
draw is uniform without replacement, the same for every feature, and needs no generator state. A test
that fires restarts the window, which delays the next test by `reference` positions and changes
nothing else; so all positions are tested in parallel and the hits are thinned afterwards.

Work is split by position into blocks; each also gets the window before it. One key may thus span any
number of tasks, and all features of a row share its hash, its draw and its trip over the network.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import draw_hash
from driftline.functions.ks import critical_h, p_value, p_value_of, p_value_up_to
from driftline.operators.scan import join_totals, ordered_index, prefix_scan
from driftline.operators.thin import thin
from driftline.schemas import FEATURES, KS_ALPHA, KS_CURRENT, KS_REFERENCE, KS_SEED
from driftline.session import materialise

BLOCK_LENGTH = 8192
_GRID = 16
_CHUNK = 256  # windows tested at once; keeps the work arrays inside the cache


def unpivot_features(df: DataFrame, ids: Sequence[str], features: Sequence[str] = FEATURES) -> DataFrame:
    """One row per (row, feature) with its value."""
    return df.unpivot(list(ids), list(features), "feature", "value")


def _statistics(views: list[np.ndarray], draw_view: np.ndarray, limits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """h = n D of the windows at `starts` (rows) for each feature (columns).

    `views` hold twice the rank of each value: with 1 added to the current ones, one sort orders both
    samples and tells them apart.
    """
    reference = draw_view.shape[1]
    current = views[0].shape[1] - reference
    h = np.empty((len(starts), len(views)), dtype=np.int32)
    for at in range(0, len(starts), _CHUNK):
        part = starts[at : at + _CHUNK]
        drawn = draw_view[part] <= limits[part, None]
        for f, view in enumerate(views):
            window = view[part]
            both = np.concatenate(
                [window[:, :reference][drawn].reshape(-1, current), window[:, reference:] + 1], axis=1
            )
            both.sort(axis=1)
            steps = np.cumsum((1 - 2 * (both & 1)).astype(np.int8), axis=1, dtype=np.int16)
            ends = np.ones(both.shape, dtype=bool)  # compare only after the last of equal values
            ends[:, :-1] = (both[:, 1:] >> 1) != (both[:, :-1] >> 1)
            h[at : at + _CHUNK, f] = np.abs(steps * ends).max(axis=1)
    return h


def _windows(
    values: np.ndarray, draws: np.ndarray, reference: int, current: int, tested: np.ndarray, least: int
) -> np.ndarray:
    """h per tested window start (rows, ascending) and feature (columns), or -1 where h < least is certain.

    A step of the window replaces one current value and at most two drawn ones, and each replacement
    moves h by at most 1. So windows on a coarse grid are tested first; between two of them only those
    that could reach `least` are.
    """
    size = reference + current
    h = np.full((len(tested), values.shape[1]), -1, dtype=np.int32)
    if not len(tested):
        return h
    ranks = np.empty(len(draws), dtype=np.int32)
    ranks[np.argsort(draws, kind="stable")] = np.arange(len(draws), dtype=np.int32)
    draw_view = np.lib.stride_tricks.sliding_window_view(ranks, reference)
    codes = [2 * np.unique(v, return_inverse=True)[1].astype(np.int32) for v in values.T]
    views = [np.lib.stride_tricks.sliding_window_view(c, size) for c in codes]
    limits = np.concatenate(
        [
            np.partition(draw_view[at : at + _CHUNK], current - 1, axis=1)[:, current - 1]
            for at in range(0, len(values) - size + 1, _CHUNK)
        ]
    )[: len(values) - size + 1]

    grid = np.unique(np.append(np.arange(0, len(tested), _GRID if least > 0 else 1), len(tested) - 1))
    h[grid] = _statistics(views, draw_view, limits, tested[grid])
    if len(grid) == len(tested):
        return h
    leaving, coming = ranks[: len(limits) - 1] <= limits[:-1], ranks[reference:][: len(limits) - 1] <= limits[1:]
    moves = np.append(0, np.cumsum(1 + leaving + coming))[tested]
    between = np.setdiff1d(np.arange(len(tested)), grid)
    after = np.searchsorted(grid, between)
    low, high = grid[after - 1], grid[after]
    for f, view in enumerate(views):
        reach = np.minimum(
            h[low, f] + moves[between] - moves[low],
            h[high, f] + moves[high] - moves[between],
        )
        open_ = between[reach >= least]
        h[open_, f] = _statistics([view], draw_view, limits, tested[open_])[:, 0]
    return h


def window_tests(
    df: DataFrame,
    keys: Sequence[str],
    keep: Sequence[str],
    features: Sequence[str],
    reference: int,
    current: int,
    seed: int,
    stride: int = 1,
    least: int = 0,
    block_length: int = BLOCK_LENGTH,
) -> DataFrame:
    """Long rows (keys, keep, pos, feature, h) for every full window of rows that carry `pos`.

    Windows end at positions reference + current + k * stride. Only tests with h >= least come back.
    """
    keys, keep, features = list(keys), list(keep), list(features)
    size = reference + current
    block_length = max(block_length, 4 * size)  # else most of a cell would be the window before it
    covering = F.sequence(
        F.expr(f"(pos - 1) div {block_length}"), F.expr(f"(pos - 1 + {size - 1}) div {block_length}")
    )
    spread = df.select(
        *keys, *[c for c in keep if c not in keys], "pos", *features, draw_hash(F.col("pos"), seed).alias("_draw")
    ).withColumn("_cell", F.explode(covering))
    kept = [*keys, *[c for c in keep if c not in keys], "pos"]
    columns = [f"_h{i}" for i in range(len(features))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)

    def test(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", ignore_index=True)
        ends = group["pos"].to_numpy()[size - 1 :]
        starts = np.flatnonzero((ends - size) % stride == 0)
        h = _windows(group[features].to_numpy(), group["_draw"].to_numpy(), reference, current, starts, least)
        hit = (h >= least).any(axis=1)
        found = group.loc[starts[hit] + size - 1, kept]
        return found.assign(**dict(zip(columns, h[hit].T)))

    # Bytes are few and the tests costly, so the cells get tasks by number, not by size.
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    cells = spread.repartition(tasks, *keys, "_cell").groupBy(*keys, "_cell")
    tested = cells.applyInPandas(test, schema + "".join(f", {c} int" for c in columns))
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(c).alias("h")) for f, c in zip(features, columns)]
    return tested.select(*kept, F.inline(F.array(*pairs))).filter(F.col("h") >= least)


def complete_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose features are all numbers; others cannot enter a window."""
    for f in features:
        df = df.filter(F.col(f).isNotNull() & ~F.isnan(f))
    return df


class KswinRun(NamedTuple):
    drifts: DataFrame
    totals: DataFrame
    tail: DataFrame
    last: DataFrame


def kswin_anchors(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    features: Sequence[str] = FEATURES,
    reference: int = KS_REFERENCE,
    current: int = KS_CURRENT,
    alpha: float = KS_ALPHA,
    seed: int = KS_SEED,
    stride: int = 1,
) -> DataFrame:
    """Statistic, p-value and verdict of every window, without restarts."""
    rows = complete_rows(df.select(*dict.fromkeys([*keys, *order, *features])), features)
    indexed = ordered_index(rows, keys, order)
    tests = window_tests(indexed, keys, order, features, reference, current, seed, stride)
    return _judged(tests, current, alpha)


def _judged(tests: DataFrame, current: int, alpha: float) -> DataFrame:
    return tests.withColumns(
        {
            "ks_statistic": F.col("h") / F.lit(float(current)),
            "p_value": p_value_of(F.col("h"), current),
            "drift": F.col("h") >= critical_h(current, alpha),
        }
    )


def kswin_run(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    features: Sequence[str] = FEATURES,
    reference: int = KS_REFERENCE,
    current: int = KS_CURRENT,
    alpha: float = KS_ALPHA,
    seed: int = KS_SEED,
    stride: int = 1,
    block_length: int = BLOCK_LENGTH,
    state: tuple[DataFrame, DataFrame, DataFrame | None] | None = None,
) -> KswinRun:
    """Drift rows of `df`, and the state to hand to the next call on later input.

    The state is, per key, the row count and the last window of rows, and per key and feature the last
    drift. Its size depends on the number of keys only.
    """
    keys, order, features = list(keys), list(order), list(features)
    kept = list(dict.fromkeys([*keys, *order, *features]))
    totals, tail, last = state or (None, None, None)
    rows = ordered_index(complete_rows(df.select(*kept), features), keys, order)
    if state is not None:
        rows = _shift(rows, totals, keys)
        rows = rows.unionByName(tail)
    tests = window_tests(
        rows, keys, order, features, reference, current, seed, stride, critical_h(current, alpha), block_length
    )
    hits = materialise(tests, "hits")
    drifts = _judged(thin(hits, [*keys, "feature"], reference, last=last), current, alpha)

    ends = rows.groupBy(*keys).agg(F.max("pos").alias("n"))
    latest = drifts.select(*keys, "feature", "pos")
    if state is not None:
        ends = ends.unionByName(totals).groupBy(*keys).agg(F.max("n").alias("n"))
    if last is not None:
        latest = latest.unionByName(last)
    near = join_totals(rows, ends, keys).filter(F.col("pos") > F.col("n") - (reference + current - 1)).select(*kept, "pos")
    return KswinRun(drifts, ends, near, latest.groupBy(*keys, "feature").agg(F.max("pos").alias("pos")))


def _shift(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Continue the positions of earlier input."""
    earlier = totals.withColumnRenamed("n", "_n0")
    joined = join_totals(rows, earlier, keys, "left")
    return joined.withColumn("pos", F.col("pos") + F.coalesce("_n0", F.lit(0))).drop("_n0")


def kswin(df: DataFrame, keys: Sequence[str], order: Sequence[str], **options) -> DataFrame:
    """Drift rows per key and feature, see `kswin_run`."""
    return kswin_run(df, keys, order, **options).drifts


def readiness(
    indexed: DataFrame,
    drifts: DataFrame,
    keys: Sequence[str],
    features: Sequence[str] = FEATURES,
    reference: int = KS_REFERENCE,
    current: int = KS_CURRENT,
) -> DataFrame:
    """Fill of the window before each row enters it, per feature.

    A drift refills the window over the next `reference` rows. The last drift of each feature is a running
    maximum over rows and drifts in order of position; rows are taken apart by feature only at the end.
    """
    keys, size = list(keys), reference + current
    names = {f: f"_drift_{f}" for f in features}
    at = [F.max(F.when(F.col("feature") == f, F.col("pos"))).alias(c) for f, c in names.items()]
    marks = drifts.groupBy(*keys, "pos").agg(*at).withColumn("_kind", F.lit(1))
    rows = indexed.select(*keys, "pos", F.lit(0).alias("_kind")).unionByName(marks, allowMissingColumns=True)
    run = prefix_scan(rows, keys, ["pos", "_kind"], maxes={c: F.col(c) for c in names.values()}, position=None)
    since = lambda c: F.col("pos") - 1 - F.col(c)
    fill = lambda c: F.coalesce(
        F.when(since(c) < reference, since(c) + current), F.least(F.col("pos") - 1, F.lit(size))
    )
    wide = run.filter("_kind = 0").select(*keys, "pos", *[fill(c).alias(f) for f, c in names.items()])
    long = wide.unpivot([*keys, "pos"], list(features), "feature", "fill")
    return long.select(*keys, "feature", "pos", "fill", (F.col("fill") == size).alias("ready"))


def ks_two_sample(
    df: DataFrame, keys: Sequence[str], value: str, is_reference: Column, exact_up_to: int | None = None
) -> DataFrame:
    """Statistic and p-value per key for two samples of any size.

    The p-value is exact for samples of equal size, and Kolmogorov's limit for others. With `exact_up_to` (10,000, say) it is exact as
    well where neither sample is larger than that, and `method` tells which it is; its work is the product of the two sizes.

    Equal values are counted first; the counts are then scanned in value order in blocks, so neither
    a large key nor a frequent value ends up in one task.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull() & is_reference.isNotNull())
        .groupBy(*keys, value)
        .agg(
            F.count(F.when(is_reference, 1)).alias("_a"),
            F.count(F.when(~is_reference, 1)).alias("_b"),
        )
    )
    counts = materialise(counts, "counts")
    sizes = materialise(
        counts.groupBy(*keys).agg(F.sum("_a").alias("n_reference"), F.sum("_b").alias("n_current")), "sizes"
    )
    running = prefix_scan(counts, keys, [value], {"_fa": F.col("_a"), "_fb": F.col("_b")}, position=None)
    running = join_totals(running, sizes, keys)
    wide = "decimal(19,0)"
    cross = F.col("_fa").cast(wide) * F.col("n_current") - F.col("_fb").cast(wide) * F.col("n_reference")
    gaps = running.groupBy(*keys, "n_reference", "n_current").agg(F.max(F.abs(cross)).alias("_gap"))
    n, m, gap = F.col("n_reference"), F.col("n_current"), F.col("_gap").cast("double")
    chance = p_value if exact_up_to is None else p_value_up_to(exact_up_to)
    exact = (n > 0) & (m > 0) & ((n == m) | (F.greatest(n, m) <= (exact_up_to or 0)))
    return gaps.select(
        *keys,
        "n_reference",
        "n_current",
        F.try_divide(gap, n.cast("double") * m).alias("ks_statistic"),
        chance(gap, n, m).alias("p_value"),
        *([] if exact_up_to is None else [F.when(exact, "exact").otherwise("limit").alias("method")]),
    )
