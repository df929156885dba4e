"""From raw documents to packed sequences: language, shared lines, near copies, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import unused
from driftline.llm.language_id import learn_profiles, length_class, predict_languages, score_bounds
from driftline.llm.line_dedup import apply_bitmaps, keep_bitmaps
from driftline.llm.near_dedup import near_duplicates
from driftline.llm.packing import pack_documents
from driftline.llm.pii import mask_pii
from driftline.session import materialise

NEAR_WORDS, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: texts without a letter, and texts far from every learned language, go.

    Profiles are learned from all labelled rows, and so is how near a text of some length must come to its language; the
    language of a row without a label is filled in. Without any label nothing can be learned, and only texts without a letter go.
    """
    profiles = learn_profiles(docs)
    if profiles.empty:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    bounds = spark.createDataFrame(score_bounds(docs, profiles), "_lang string, _length int, _bound double")
    lang, score = unused("lang_pred", docs.columns), unused("score", docs.columns)
    found = predict_languages(docs, profiles, lang_out=lang, score_out=score).filter(F.col(lang) != "und")
    near = (F.col(lang) == F.col("_lang")) & (length_class("text") == F.col("_length"))
    kept = found.join(bounds, near).filter(F.col(score) >= F.col("_bound"))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one document only; documents that lose all lines go."""
    bitmaps = materialise(keep_bitmaps(docs), "bitmaps")
    rows = apply_bitmaps(docs, bitmaps).filter("n_dropped < n_lines")
    text = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    return rows.select(*[text.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Where an id stands for several rows, each row is a document of its own, so that no text goes without a copy that stays.
    """
    ids = docs.filter(F.col("doc_id").isNotNull())
    if ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = near_duplicates(docs, words=NEAR_WORDS, percent=NEAR_PERCENT).filter(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    row = unused("row", docs.columns)
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kept = near_duplicates(numbered, row, words=NEAR_WORDS, percent=NEAR_PERCENT).filter("kept").select(row)
    return numbered.join(kept, row, "left_semi").select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; every document stays."""
    masked = mask_pii(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in a sequence."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]

ORACLE_SQL = None  # no SQL for language profiles, tokens and packing; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`; what a stage returns is stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
