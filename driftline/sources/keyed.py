"""Tables of rows by key that change with every batch, at a cost that follows the batch and not what the table holds.

Keys are dealt into buckets. A batch writes, for the buckets it touches, only its new rows and the keys it removes: a new version
of these buckets. When a bucket has `fan` versions of a level, they are merged into one of the next level, so a row is rewritten
as often as the table has levels (the logarithm of its versions), and a bucket is never more than a few files a level. Buckets that a
batch does not touch are neither read nor written.

Which versions make up a bucket is noted per batch in a small index (a line per bucket and version), which is also what commits a
batch. A replayed batch starts from the index before it and finds its own rows already written. Versions that were merged are
deleted a batch later, when no replay can ask for them.

Rows of a key may be many (a label sent over and over): nothing is grouped by key in one task, and buckets that a batch fills
are written by several tasks.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.scan import join_totals
from driftline.session import delete, materialise
from driftline.sources.files import (
    batches_of,
    drop_before,
    folders_of,
    new_keys,
    note_before,
    read_batch,
    read_table,
    write_batch,
    write_note,
)

BUCKETS = 32
FAN = 4


class Version(NamedTuple):
    """A bucket as a batch left it: its own rows (level 0) or a merge; `until` is the batch that merged it away, None while it is live."""

    bucket: int
    batch: int
    level: int
    until: int | None

    @property
    def folder(self) -> str:
        return f"merged={int(self.level > 0)}/batch_id={self.batch}/bucket={self.bucket}"


class KeyedTable:
    """Rows by `keys` under `path`. With `replaces` the rows of a key take the place of all its earlier ones; else they add up.

    Choose `buckets` by the bytes a table will hold: about one per 128 MB. Null keys are dropped. Without keys the table is one bucket.
    """

    def __init__(self, path: str, keys: Sequence[str], replaces: bool = False, buckets: int = BUCKETS, fan: int = FAN):
        self.path, self.keys, self.replaces = path, list(keys), replaces
        self.buckets, self.fan = buckets if keys else 1, fan

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def _index(self, spark: SparkSession, batch_id: int, results: str | None = None) -> tuple[list[Version], T.StructType | None]:
        """Versions as the last batch before `batch_id` left them, a few per bucket, and the schema of their rows."""
        note = note_before(spark, f"{self.path}/index", batch_id, results)
        if note is None:
            return [], None
        note = json.loads(note)
        return [Version(*v) for v in note["versions"]], T.StructType.fromJson(note["schema"])

    def _rows(self, spark: SparkSession, versions: Sequence[Version], schema: T.StructType) -> DataFrame:
        """Stored rows with their `_version` and `bucket`."""
        root = f"{self.path}/rows"
        whole = T.StructType([*schema, *[T.StructField(c, T.LongType()) for c in ("batch_id", "merged")], T.StructField("bucket", T.IntegerType())])
        if not versions:
            rows = spark.createDataFrame([], whole)
        else:
            rows = spark.read.schema(whole).option("basePath", root).parquet(*[f"{root}/{v.folder}" for v in versions])
        return rows.drop("merged").withColumnRenamed("batch_id", "_version")

    def _live(self, rows: DataFrame, tombstones: bool = False) -> DataFrame:
        """Rows that nothing later removes or replaces; on demand also the removals, once per key."""
        ends = rows if self.replaces else rows.filter("_gone")
        removed = ends.groupBy(*self.keys).agg(F.max("_version").alias("_end"))
        kept = join_totals(rows.filter("not _gone"), removed, self.keys, "left")
        kept = kept.filter(F.col("_end").isNull() | (F.col("_version") >= F.col("_end"))).drop("_end")
        if tombstones:
            gone = rows.filter("_gone").groupBy(*self.keys, "bucket").agg(F.max("_version").alias("_version"))
            kept = kept.unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        return kept

    def find(
        self, spark: SparkSession, batch_id: int, active: DataFrame, results: str | None = None, unique: bool = False
    ) -> DataFrame | None:
        """Rows of the keys in `active` as they were before `batch_id`; None if nothing was ever stored.

        Only the buckets of these keys are read. Where `results` holds earlier batches, a missing index is an error. With `unique`
        the keys in `active` are known to differ.
        """
        versions, schema = self._index(spark, batch_id, results)
        live = [v for v in versions if v.until is None]
        if not live:
            return None
        if not self.keys:
            return self._live(self._rows(spark, live, schema)).drop("_gone", "_version", "bucket")
        keys = active.select(*self.keys).dropna()
        keys = keys if unique else keys.distinct()
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # at most `buckets`
        rows = self._rows(spark, [v for v in live if v.bucket in touched], schema)
        found = materialise(rows.join(keys, self.keys, "left_semi"), "found")
        return self._live(found).drop("_gone", "_version", "bucket")

    def everything(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame | None:
        """All rows as they were before `batch_id`, or now; None if nothing was ever stored."""
        batch_id = batch_id if batch_id is not None else (batches_of(spark, f"{self.path}/index") or [-1])[-1] + 1
        versions, schema = self._index(spark, batch_id)
        if schema is None:
            return None
        return self._live(self._rows(spark, [v for v in versions if v.until is None], schema)).drop("_gone", "_version", "bucket")

    def put(self, batch_id: int, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Store the changes of a batch: new rows, and keys whose earlier rows go. Rows of the same call stay."""
        spark = rows.sparkSession
        fresh = (rows.dropna(subset=self.keys) if self.keys else rows).withColumn("_gone", F.lit(False))
        if gone is not None:
            removed = gone.select(*self.keys).dropna().distinct().withColumn("_gone", F.lit(True))
            fresh = fresh.unionByName(removed, allowMissingColumns=True)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in fresh.schema])
        self._write(fresh.withColumn("bucket", self._bucket()), batch_id, 0)
        before, _ = self._index(spark, batch_id)
        live = [v for v in before if v.until is None]
        index, merges = [], {}
        for bucket in map(int, folders_of(spark, f"{self.path}/rows/merged=0/batch_id={batch_id}", "bucket")):
            mine, taken, level = [v for v in live if v.bucket == bucket], [], 0
            while len(same := [v for v in mine if v.level == level]) + 1 >= self.fan:
                taken += same
                level += 1
            own = Version(bucket, batch_id, 0, None)
            index.append(own if not level else own._replace(until=batch_id))
            if level:
                merges[bucket] = (level, [*taken, own], len(taken) == len(mine))
        if merges:
            parts = self._rows(spark, [v for _, taken, _ in merges.values() for v in taken], schema)
            whole = [bucket for bucket, (_, _, all_) in merges.items() if all_]  # nothing older is left to remove
            merged = self._live(parts, tombstones=True).filter(~(F.col("_gone") & F.col("bucket").isin(whole)))
            self._write(merged.drop("_version"), batch_id, 1)
            for bucket in map(int, folders_of(spark, f"{self.path}/rows/merged=1/batch_id={batch_id}", "bucket")):
                index.append(Version(bucket, batch_id, merges[bucket][0], None))
        old = {v for _, taken, _ in merges.values() for v in taken}
        for v in before:
            if v.until is not None:  # no replay goes back that far
                delete(spark, f"{self.path}/rows/{v.folder}")
            else:
                index.append(v._replace(until=batch_id) if v in old else v)
        write_note(spark, f"{self.path}/index/batch_id={batch_id}", json.dumps({"versions": index, "schema": schema.jsonValue()}))
        drop_before(spark, f"{self.path}/index", batch_id)

    def _write(self, rows: DataFrame, batch_id: int, merged: int) -> None:
        write_batch(rows.hint("rebalance", "bucket"), f"{self.path}/rows/merged={merged}", batch_id, by=["bucket"])

    def wrote(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What a batch wrote of its own, removals (`_gone`) included."""
        versions, schema = self._index(spark, batch_id + 1)
        own = [v for v in versions if v.batch == batch_id and not v.level]
        return self._rows(spark, own, schema).drop("_version", "bucket")


def append_idempotent(
    df: DataFrame, path: str, key: str, batch_id: int, order: list[str] | None = None, buckets: int = BUCKETS
) -> None:
    """Append the rows of a batch whose key is new to the table; a replayed batch changes nothing.

    The keys of the table are kept a second time beside it (`_keys`), by bucket: a batch looks only into the buckets of its own keys, which
    are a few files each however many batches there were. A table that has no such index yet gets one first.
    """
    spark = df.sparkSession
    index = KeyedTable(f"{path.rstrip('/')}_keys", [key], buckets=buckets)
    earlier = [b for b in batches_of(spark, path) if b < batch_id]
    if earlier and not batches_of(spark, f"{index.path}/index"):
        index.put(earlier[-1], read_table(spark, path).filter(F.col("batch_id") <= earlier[-1]).select(key))
    fresh = materialise(new_keys(df, None, key, order), "fresh")
    write_batch(new_keys(fresh, index.find(spark, batch_id, fresh), key, order), path, batch_id)
    index.put(batch_id, read_batch(spark, path, batch_id, df.schema).select(key))
