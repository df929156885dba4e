"""CSV and table files."""

from __future__ import annotations

import pathlib
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from driftline.operators.labels import first_per_key
from driftline.schemas import RAW_CSV


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = RAW_CSV) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, at the price of a second scan."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV parts with a header each, written by the executors."""
    df.write.mode(mode).option("header", True).csv(path)


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)


def schema_rows(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Name, type and nullability of each column."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]


def _folder(spark: SparkSession, path: str):
    """A path and its file system, as the JVM knows them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_batch(df: DataFrame, path: str, batch_id: int, by: Sequence[str] = ()) -> None:
    """Store `df` as partition `batch_id` of a table, once and for all; `by` names columns that divide it further.

    The rows are written aside and appear by one rename. A batch that is there already stays as it is: a replay
    computes the same rows, and a stream may be reading the files.
    """
    spark = df.sparkSession
    final, fs = _folder(spark, f"{path}/batch_id={batch_id}")
    if fs.exists(final):
        return
    aside, _ = _folder(spark, f"{path}/_writing-{batch_id}")
    df.write.mode("overwrite").partitionBy(*by).parquet(aside.toString())
    if not fs.rename(aside, final) and not fs.exists(final):
        raise OSError(f"cannot move {aside.toString()} to {final.toString()}")


def append_file(df: DataFrame, path: str) -> None:
    """Add the rows of a small frame to a table as one file, by one rename.

    Several writers may do so at once, which Spark's own append does not allow: who ends first removes what the others are writing.
    """
    spark = df.sparkSession
    aside, fs = _folder(spark, f"{path}/_writing-{uuid.uuid4().hex}")
    df.coalesce(1).write.parquet(aside.toString())
    for entry in fs.listStatus(aside):
        if entry.getPath().getName().startswith("part-"):
            final, _ = _folder(spark, f"{path}/{entry.getPath().getName()}")  # a name no other writer has
            if not fs.rename(entry.getPath(), final):
                raise OSError(f"cannot move {entry.getPath().toString()} to {final.toString()}")
    fs.delete(aside, True)


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Store a small text under a final name, by one rename; one that is there already stays."""
    final, fs = _folder(spark, path)
    if fs.exists(final):
        return
    aside, _ = _folder(spark, f"{path.rpartition('/')[0]}/_writing-{path.rpartition('/')[2]}")
    out = fs.create(aside, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if not fs.rename(aside, final) and not fs.exists(final):
        raise OSError(f"cannot move {aside.toString()} to {final.toString()}")


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless there is one; of any number of callers exactly one gets True.

    Stores with an exclusive create decide that themselves. A local file system, as in tests, has one outside of Hadoop's interface only.
    """
    target, fs = _folder(spark, path)
    if fs.getScheme() == "file":
        local = pathlib.Path(target.toUri().getPath())
        local.parent.mkdir(parents=True, exist_ok=True)
        try:
            local.touch(exist_ok=False)
        except FileExistsError:
            return False
        return True
    try:
        fs.create(target, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def read_note(spark: SparkSession, path: str) -> str:
    target, fs = _folder(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def note_before(spark: SparkSession, path: str, batch_id: int, results: str | None = None) -> str | None:
    """The last note `batch_id=...` under `path` before `batch_id`; as for tables, a missing one may be an error."""
    earlier = _earlier(spark, path, batch_id, results)
    return read_note(spark, f"{path}/batch_id={earlier}") if earlier is not None else None


def batches_of(spark: SparkSession, path: str) -> list[int]:
    """Batches of a table in ascending order, from the names of their folders."""
    root, fs = _folder(spark, path)
    if not fs.exists(root):
        return []
    names = [entry.getPath().getName() for entry in fs.listStatus(root)]
    return sorted(int(name.split("=")[1]) for name in names if name.startswith("batch_id="))


def read_batch(spark: SparkSession, path: str, batch_id: int, schema: str | T.StructType | None = None) -> DataFrame:
    """One batch of a table; no other folder is looked at."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/batch_id={batch_id}")


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame | None:
    """The table at `path`. If nothing was written yet: no rows where a schema is given, else None."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema) if schema else None


def read_before(
    spark: SparkSession, path: str, batch_id: int, results: str | None = None, schema: str | T.StructType | None = None
) -> DataFrame | None:
    """The last batch stored before `batch_id`, or None.

    Where the table `results` holds earlier batches, a missing state is an error: going on would start afresh in silence.
    """
    earlier = _earlier(spark, path, batch_id, results)
    return read_batch(spark, path, earlier, schema) if earlier is not None else None


def _earlier(spark: SparkSession, path: str, batch_id: int, results: str | None) -> int | None:
    earlier = [b for b in batches_of(spark, path) if b < batch_id]
    if earlier:
        return earlier[-1]
    if results and any(b < batch_id for b in batches_of(spark, results)):
        raise FileNotFoundError(f"no state before batch {batch_id} in {path}, but results of earlier batches in {results}")
    return None


def folders_of(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column, from the folders of a table or of one of its batches."""
    root, fs = _folder(spark, path)
    names = [entry.getPath().getName() for entry in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(name.split("=", 1)[1] for name in names if name.startswith(f"{column}="))


def ensure_folder(spark: SparkSession, path: str) -> None:
    """Make the folder of a table that a stream will read before anything is written to it."""
    target, fs = _folder(spark, path)
    fs.mkdirs(target)


def drop_before(spark: SparkSession, path: str, batch_id: int, keep: int = 10) -> None:
    """Delete state more than `keep` batches old; a replay goes back one batch only."""
    for batch in batches_of(spark, path):
        if batch < batch_id - keep:
            target, fs = _folder(spark, f"{path}/batch_id={batch}")
            fs.delete(target, True)


def new_keys(df: DataFrame, existing: DataFrame | None, key: str, order: list[str] | None = None) -> DataFrame:
    """First row in `order` of every key of `df` that `existing` does not hold. Null keys are dropped."""
    fresh = first_per_key(df, [key], order or [c for c in df.columns if c != key])
    return fresh if existing is None else fresh.join(existing.select(key), key, "left_anti")
