"""Sharding by longest-processing-time scheduling.

Documents with the same text form a group that stays together. Groups, largest first, go to the least
loaded shard through a heap. When there are more groups than one task should hold, they are dealt by hash into
buckets, each bucket's groups are bundled by the same rule into many bundles of near-equal size, and the
bundles take the place of the groups; this repeats until one heap can take the rest. A group
with a large share of all rows ends up as a bundle of its own.

Defined cases: null text is empty text and groups with it; repeated rows count each for itself and get a slot
each; null ids are kept and come first in their shard; no rows give no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import text_key
from driftline.session import materialise

HEAP_ROWS = 50_000
BUNDLES = 1024


def longest_first(sizes: np.ndarray, targets: int) -> np.ndarray:
    """Target of each size: largest first, each to the least loaded; ties in the order given."""
    heap = [(0, t) for t in range(targets)]
    chosen = np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        load, target = heap[0]
        chosen[i] = target
        heapq.heapreplace(heap, (load + int(sizes[i]), target))
    return chosen


def schedule(items: DataFrame, shards: int, heap_rows: int = HEAP_ROWS, bundles: int = BUNDLES) -> DataFrame:
    """Shard of each item; `items` is stored and has the unique key (k1, k2) and `bytes`."""
    rows = items.count()
    buckets = -(-rows // heap_rows)
    targets = shards if buckets <= 1 else bundles

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["k1", "k2"])
        chosen = longest_first(group["bytes"].to_numpy(), targets)
        return group[["k1", "k2", "bytes"]].assign(target=chosen + int(group["bucket"].iloc[0]) * targets)

    dealt = items.withColumn("bucket", F.pmod(F.xxhash64(F.lit("shard"), "k1", "k2"), F.lit(max(1, buckets))))
    placed = dealt.groupBy("bucket").applyInPandas(assign, "k1 bigint, k2 bigint, bytes bigint, target bigint")
    placed = materialise(placed, "placed")
    if buckets <= 1:
        return placed.select("k1", "k2", F.col("target").cast("int").alias("shard"))
    bundled = placed.groupBy(F.col("target").alias("k1"), F.lit(0).cast("bigint").alias("k2")).agg(F.sum("bytes").alias("bytes"))
    upper = schedule(materialise(bundled, "bundles"), shards, heap_rows, min(bundles, heap_rows // 4))
    return placed.join(upper.select(F.col("k1").alias("target"), "shard"), "target").select("k1", "k2", "shard")


def numbered(rows: DataFrame, key: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Gapless place of every row within its key, from 0, without gathering a key in one task."""
    ids = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ids = ids.withColumn("_id", F.monotonically_increasing_id())
    stored = materialise(ids.withColumn("_part", F.shiftright("_id", 33)), "numbered")
    starts = stored.groupBy("_part", key).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "starts")
    out = stored.join(starts.drop("_n"), ["_part", key])
    return out.select(*rows.columns, (F.col("_before") + F.col("_id") - F.col("_first")).alias(slot))


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", heap_rows: int = HEAP_ROWS, bundles: int = BUNDLES
) -> DataFrame:
    """id, size, text_crc32, law `bytes`, shard, slot and grown_shard (null: this law deals anew when shards are added)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = text_key(text_col)
    rows = materialise(
        docs.select(
            id_col,
            (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            k1.alias("k1"),
            k2.alias("k2"),
        ),
        "sizes",
    )
    groups = materialise(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")), "groups")
    shard = materialise(schedule(groups, shards, heap_rows, bundles), "shards")
    placed = rows.join(shard, ["k1", "k2"]).select(id_col, "size", "text_crc32", "shard")
    return numbered(placed, "shard", [id_col]).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
