"""Removal of lines that many documents share, with built-in functions only.

Long lines are reduced to 128-bit hashes, range-partitioned by (hash, document descending, position) and
sorted in that order, so that a very frequent line spreads over several ranges. Each range is read
as a stream in which the first row of a hash is its first occurrence: the largest document that holds it. A
hash that crosses ranges is put together from one row per range. What goes back to the documents is not
text but a bitmap per document: 64 lines a word, words without a dropped line left out.

Defined cases: null or empty text is one empty line; rows with a null id keep all lines and do not count as
documents; rows with the same id are one document, and each of them keeps or loses lines alike; a line repeated in the
document that keeps it stays each time; no rows give no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import SPACES, ascii_lower
from driftline.session import materialise

MIN_LENGTH = 40
MIN_DOCUMENTS = 5


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_length: int) -> DataFrame:
    """Hashes of the keys of long lines with the place where they stand."""
    lines = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text_col).alias("version"),
        F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"),
    )
    # Trimming only shortens, so most short lines fall before it.
    keys = lines.filter(F.octet_length("line") >= min_length).withColumn("line", F.btrim("line", F.lit(SPACES)))
    key = ascii_lower(F.col("line"))
    return keys.filter(F.char_length("line") >= min_length).select(
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("2"), key).alias("h2"), "doc", "version", "pos"
    )


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_length: int, min_documents: int) -> DataFrame:
    """Places (doc, version, pos) of the lines to drop."""
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("pos")]
    lines = materialise(long_lines(docs, id_col, text_col, min_length), "lines")
    ranges = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = materialise(ranges.withColumn("block", F.spark_partition_id()), "runs")

    stream = Window.partitionBy("block", "h1", "h2").orderBy(F.col("doc").desc(), "pos")
    new_document = F.coalesce(F.lag("doc").over(stream) != F.col("doc"), F.lit(True))
    in_block = (
        runs.select("block", "h1", "h2", "doc", new_document.cast("int").alias("new"))
        .groupBy("block", "h1", "h2")
        .agg(F.sum("new").alias("n"), F.max("doc").alias("first"), F.min("doc").alias("last"))
    )
    spans = F.sort_array(F.collect_list(F.struct("block", "first", "last")))
    keys = in_block.groupBy("h1", "h2").agg(
        F.sum("n").alias("n"), F.max("first").alias("keeper"), F.count(F.lit(1)).alias("blocks"), spans.alias("spans")
    )
    # A document cut by the border of two ranges was counted in both.
    cut_twice = F.expr(
        "case when blocks = 1 then 0 else size(filter(sequence(1, cast(blocks as int) - 1),"
        " i -> spans[i].first = spans[i - 1].last)) end"
    )
    frequent = materialise(keys.filter(F.col("n") - cut_twice >= min_documents).select("h1", "h2", "keeper"), "frequent")
    return runs.join(frequent, ["h1", "h2"]).filter(F.col("doc") != F.col("keeper")).select("doc", "version", "pos")


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """Per document with a dropped line: doc, version (hash of the text), n_dropped, and `drops`, the words of
    its bitmap that are not all zero, as map from word number to 64 bits. A set bit is a line to leave out."""
    drops = dropped_lines(docs, id_col, text_col, min_length, min_documents).distinct()
    words = drops.groupBy("doc", "version", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    return words.groupBy("doc", "version").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`row` (the whole row of `docs`), kept_text, n_lines and n_dropped; rows without a bitmap keep all lines."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text_col).alias("own"))
    same = (F.col(f"row.{id_col}") == F.col("doc")) & (F.col("own") == F.col("version"))
    text = f"coalesce(row.`{text_col}`, '')"
    kept = F.expr(
        f"case when drops is null then {text} else array_join(filter(split({text}, '\\n', -1), (line, i) ->"
        " coalesce(element_at(drops, i div 64), 0L) & shiftleft(1L, i % 64) = 0), '\\n') end"
    )
    n_lines = F.expr(f"cast(length({text}) - length(replace({text}, '\\n', '')) + 1 as bigint)")
    return rows.join(bitmaps, same, "left").select(
        "row", kept.alias("kept_text"), n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped")
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """id, n_lines, n_dropped, kept_text of every row of `docs`."""
    own = docs.select(id_col, text_col)
    bitmaps = materialise(keep_bitmaps(own, id_col, text_col, min_length, min_documents), "bitmaps")
    return apply_bitmaps(own, bitmaps, id_col, text_col).select(f"row.{id_col}", "n_lines", "n_dropped", "kept_text")
