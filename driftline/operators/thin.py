"""Refractory thinning: after a row is kept, the next kept row lies at least `gap` positions later.

Which rows are kept depends on every earlier choice, but only through one number: the position from
which a row may be kept again. A block of positions is therefore summed up by how it maps that number
at its start to the number at its end, a step function of at most `gap` steps. Blocks are summed up in
parallel, the summaries are chained in groups of a fixed number, and the groups' summaries likewise, until
one group is left; the blocks then pick their rows in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import materialise

BLOCK_LENGTH = 65_536  # a block is one group of a task, so this bounds its memory
FAN = 32  # block summaries chained in one task


def _block_map(pos: np.ndarray, start: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps of a block: the last row of each run of chain beginnings, and what such a chain leaves free."""
    following = np.searchsorted(pos, pos + gap)
    last = np.where(following < len(pos), following, np.arange(len(pos)))
    while True:  # double the jump until every row points at the end of its chain
        jumped = last[last]
        if np.array_equal(jumped, last):
            break
        last = jumped
    heads = np.searchsorted(pos, start + gap) + 1
    free = pos[last[:heads]] + gap
    step = np.append(np.diff(free) != 0, True)[: len(free)]  # chains that meet share a step
    return pos[:heads][step], free[step]


def _chain(pos: np.ndarray, free: int, gap: int) -> np.ndarray:
    """Indices kept in one block when rows from position `free` on may be kept."""
    kept = []
    i = int(np.searchsorted(pos, free))
    while i < len(pos):
        kept.append(i)
        i = int(np.searchsorted(pos, pos[i] + gap))
    return np.array(kept, dtype=np.int64)


def _apply(heads: np.ndarray, frees: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Where a block leaves each of the positions `free`."""
    if not len(heads):
        return free
    i = np.searchsorted(heads, free)
    return np.where(i < len(heads), frees[np.minimum(i, len(heads) - 1)], free)


def _compose(
    first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], reach: int
) -> tuple[np.ndarray, np.ndarray]:
    """Step function of two blocks in a row, of which a chain enters the first at a position below `reach`.

    Such a chain takes the first head from there on, so heads after the first one beyond `reach` say nothing: a map
    has as many steps as a block has, however many blocks it sums up.
    """
    beyond = second[0] > (first[0][-1] if len(first[0]) else -1)
    heads = np.concatenate([first[0], second[0][beyond]])
    frees = np.concatenate([_apply(*second, first[1]), second[1][beyond]])
    wanted = np.searchsorted(heads, reach) + 1
    heads, frees = heads[:wanted], frees[:wanted]
    last = np.append(np.diff(frees) != 0, True)[: len(frees)]
    return heads[last], frees[last]


def _entries(maps: DataFrame, keys: list[str], key_ddl: str) -> DataFrame:
    """Position from which rows may be kept, at the start of every block; no task chains more than `FAN` blocks."""
    cells = maps.agg(F.max("_cell")).first()[0] or 0
    part = F.expr(f"_cell div {FAN}")

    def steps(group: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.asarray(h, np.int64), np.asarray(f, np.int64)) for h, f in zip(group["heads"], group["frees"])]

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_cell")
        free, found = np.array([group["_start"].iloc[0]], np.int64), []
        for step in steps(group):
            found.append(int(free[0]))
            free = _apply(*step, free)
        return group[[*keys, "_cell"]].assign(_free=found)

    if cells < FAN:
        started = maps.withColumn("_start", F.lit(1).cast("bigint")).withColumn("_part", F.lit(0).cast("bigint"))
    else:

        def chain(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("_cell")
            reach = int(group["reach"].iloc[0])
            heads, frees = reduce(lambda a, b: _compose(a, b, reach), steps(group))
            cell = group["_cell"].iloc[0] // FAN
            return group.iloc[:1][keys].assign(_cell=cell, reach=reach, heads=[heads.tolist()], frees=[frees.tolist()])

        schema = f"{key_ddl}_cell bigint, reach bigint, heads array<bigint>, frees array<bigint>"
        upper = maps.withColumn("_part", part).groupBy(*keys, "_part").applyInPandas(chain, schema)
        starts = _entries(materialise(upper, "maps"), keys, key_ddl).withColumnsRenamed({"_cell": "_part", "_free": "_start"})
        started = maps.withColumn("_part", part).join(materialise(starts, "starts"), [*keys, "_part"])
    return started.groupBy(*keys, "_part").applyInPandas(resolve, f"{key_ddl}_cell bigint, _free bigint")


def thin(
    rows: DataFrame,
    keys: Sequence[str],
    gap: int,
    position: str = "pos",
    last: DataFrame | None = None,
    block_length: int | None = None,
) -> DataFrame:
    """Greedy thinning of `rows` per key in the order of `position` (unique per key).

    `last` gives per key the position kept last in earlier input, as column `position`. `rows` is
    read three times: pass a stored table.
    """
    keys, columns = list(keys), rows.columns
    length = max(block_length or BLOCK_LENGTH, gap)
    if last is not None:
        prior = last.select(*keys, F.col(position).alias("_last"))
        rows = rows.join(prior, keys, "left").filter(
            F.col("_last").isNull() | (F.col(position) - F.col("_last") >= gap)
        )
        rows = rows.select(columns)
    blocked = rows.withColumn("_cell", F.expr(f"({position} - 1) div {length}"))
    key_ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema)

    def summarise(group: pd.DataFrame) -> pd.DataFrame:
        pos = np.sort(group[position].to_numpy())
        start = int(group["_cell"].iloc[0]) * length + 1
        heads, frees = _block_map(pos, start, gap)
        return group.iloc[:1][[*keys, "_cell"]].assign(reach=start + gap, heads=[heads.tolist()], frees=[frees.tolist()])

    maps = (
        blocked.select(*keys, "_cell", position)
        .groupBy(*keys, "_cell")
        .applyInPandas(summarise, f"{key_ddl}_cell bigint, reach bigint, heads array<bigint>, frees array<bigint>")
    )

    entries = _entries(materialise(maps, "maps"), keys, key_ddl)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(position, ignore_index=True)
        kept = _chain(group[position].to_numpy(), int(group["_free"].iloc[0]), gap)
        return group.loc[kept, columns]

    return blocked.join(entries, [*keys, "_cell"]).groupBy(*keys, "_cell").applyInPandas(pick, rows.schema)
