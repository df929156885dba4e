"""Quality rules with thresholds that adapt to language and source, with built-in functions only.

Every document gets whole-text measures. Four of them, as shares in thousandths (word length in tenths), feed one quantile
sketch per language and source: counts per unit bucket, of which there are 1,001 at most. Such sketches merge by
addition, so tasks pre-aggregate them, and a group with too few documents takes the sketch of its language, or
of everything, merged from the same counts. A measure fails above its fence: the 90 % quantile plus a
multiple of its distance from the median, plus a margin. Where the 90 % quantile itself lies above the fence that
the 75 % quantile gives, a tenth of the group or more is junk, and that lower fence counts; likewise from there to the 55 %
quantile, so that junk is found while it is less than 45 % of a group. The fences are joined back and the verdicts applied.

Defined cases: null text has no words; null language or source is a group of its own; null ids and repeated
rows are kept and counted; no rows give no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import SPACES
from driftline.session import materialise

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
MIN_GROUP = 200
SPREAD = 3
LEVELS = (90, 75, 55)
#: Measure and margin of its fence.
MARGINS = {"symbols": 50, "dup_lines": 100, "repeats": 100, "word_length": 50}
_POSITION_BITS = 28


def _adjacent(sorted_codes: str) -> str:
    """The codes whose hash part also stands beside them in the sorted array."""
    same = lambda step: f"shiftright(x, {_POSITION_BITS}) <=> shiftright(get({sorted_codes}, i {step} 1), {_POSITION_BITS})"
    return f"filter({sorted_codes}, (x, i) -> {same('-')} or {same('+')})"


def _codes(hashes: str, seed: int, position: str) -> str:
    """Hash of the window at a position in the high bits, the position in the low ones."""
    parts = ", ".join(f"get({hashes}, cast({position} as int) + {n})" for n in range(WINDOW))
    return f"shiftleft(xxhash64({seed}, {parts}), {_POSITION_BITS}) | {position}"


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Columns `keep` with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words.

    Repeated windows are found by sorting 36 bits of their hashes together with their positions; what meets there is
    sorted once more by another hash, so that two windows are taken as equal on 72 bits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = f"{(1 << _POSITION_BITS) - 1}L"
    rows = docs.select(
        *keep,
        text.alias("_text"),
        F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+", -1), "").alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_lines"),
    )
    rows = rows.withColumn("_hashes", F.expr("transform(_words, w -> xxhash64(w))"))
    starts = f"case when size(_words) < {WINDOW} then array() else sequence(0L, cast(size(_words) - {WINDOW} as bigint)) end"
    rows = rows.withColumn("_codes", F.expr(f"sort_array(transform({starts}, i -> {_codes('_hashes', 1, 'i')}))"))
    rows = rows.withColumn("_met", F.expr(_adjacent("_codes")))
    rows = rows.withColumn("_again", F.expr(f"sort_array(transform(_met, c -> {_codes('_hashes', 2, f'(c & {mask})')}))"))
    found = f"sort_array(transform({_adjacent('_again')}, c -> c & {mask}))"
    covered = (
        f"aggregate({found}, struct({-WINDOW}L as last, 0L as words),"
        f" (a, p) -> struct(p as last, a.words + least({WINDOW}L, p - a.last) as words), a -> a.words)"
    )
    return rows.select(
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.char_length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
    )


#: Measure: part, whole and scale of its share.
SHARES = {
    "symbols": ("n_symbols", "word_chars", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "repeats": ("n_repeat_words", "n_words", 1000),
    "word_length": ("word_chars", "n_words", 10),
}


def value(measure: str) -> Column:
    part, whole, scale = SHARES[measure]
    return F.expr(f"cast(least(1000, {scale} * {part} div greatest({whole}, 1)) as int)")


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key, measure and bucket."""
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), value(name).alias("bucket")) for name in SHARES])
    long = rows.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.measure", "m.bucket")
    return long.groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of coarser groups."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str], spread: int = SPREAD) -> DataFrame:
    """Per key its number of documents and the fence of each measure."""
    group = Window.partitionBy(*keys, "measure")
    up_to = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketches.select(*keys, "measure", "bucket", F.sum("n").over(up_to).alias("below"), F.sum("n").over(group).alias("all"))
    at = lambda percent: F.min(F.when(F.col("below") * 100 >= F.col("all") * percent, F.col("bucket")))
    quantiles = [at(p).alias(f"q{p}") for p in (50, *LEVELS)]
    cuts = ranked.groupBy(*keys, "measure").agg(F.max("all").alias("docs"), *quantiles)
    margin = F.element_at(F.create_map(*[F.lit(x) for pair in MARGINS.items() for x in pair]), F.col("measure"))
    above = lambda p: F.col(f"q{p}") + spread * (F.col(f"q{p}") - F.col("q50")) + margin
    limit, clean = above(LEVELS[-1]), F.lit(True)
    for lower, level in zip(LEVELS[::-1], LEVELS[-2::-1]):
        clean &= F.col(f"q{level}") <= above(lower)
        limit = F.when(clean, above(level)).otherwise(limit)
    fence = lambda name: F.max(F.when(F.col("measure") == name, limit))
    return cuts.groupBy(*keys).agg(F.max("docs").alias("docs"), *[fence(name).alias(name) for name in MARGINS])


def adaptive_fences(rows: DataFrame, lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source and one fence per measure; groups below `min_group` documents take a coarser one."""
    fine = materialise(sketch(rows, [lang, source]), "sketches")
    by_lang = fences(merge(fine, [lang]), [lang]).withColumnsRenamed({c: f"_l_{c}" for c in (lang, "docs", *MARGINS)})
    overall = fences(merge(fine.withColumn("_all", F.lit(0)), ["_all"]), ["_all"]).withColumnsRenamed({c: f"_o_{c}" for c in MARGINS})
    own = fences(fine, [lang, source]).withColumn("_all", F.lit(0))
    joined = own.join(by_lang, F.col(lang).eqNullSafe(F.col(f"_l_{lang}")), "left").join(overall.drop("docs"), "_all")
    pick = lambda m: F.when(F.col("docs") >= min_group, F.col(m)).when(F.col("_l_docs") >= min_group, F.col(f"_l_{m}")).otherwise(F.col(f"_o_{m}"))
    return materialise(joined.select(lang, source, *[pick(m).alias(f"_fence_{m}") for m in MARGINS]), "fences")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP
) -> DataFrame:
    """id, the measures, base_failed, kept and `failed`, the names of the measures above their fence."""
    rows = materialise(measures(docs, text_col, (id_col, lang, source)), "measures")
    limits = adaptive_fences(rows, lang, source, min_group).withColumnsRenamed({lang: "_lang", source: "_source"})
    joined = rows.join(limits, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")))
    above = F.array_compact(F.array(*[F.when(value(m) > F.col(f"_fence_{m}"), F.lit(m)) for m in MARGINS]))
    base = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words")
    verdicts = joined.withColumns({"failed": above, "base_failed": base})
    return verdicts.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed",
    )
