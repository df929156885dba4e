"""Language identification by rank-order profiles.

A text is reduced to its letters in lower case, every run of other characters being one separator. Its n-grams
of one to three characters are counted over the whole text; the most frequent ones, in order, are its profile. A
language's profile comes from all its labelled training rows. The out-of-place distance adds up, over the n-grams of the document,
how far their ranks lie apart; an n-gram that the language lacks counts the full profile length. The nearest language
wins, ties going to the first in alphabetical order.

Counting runs where the documents lie. Of a language only its n-gram counts are shuffled, already summed per
task, and only the first `size` n-grams per language reach the driver and the tasks.

A text in no learned language resembles each of them far less than their own texts do. How much that is depends on the length of
a text, so `score_bounds` takes it from the scores of the labelled rows by language and number of letters.

Defined cases: null text or text without a letter is `und` with score 0, as is every text when there is no labelled
row; labels that are null are not learned; ids, labels and sources are no inputs of a prediction; null ids and repeated
rows are kept; no rows give no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import text_slices
from driftline.session import materialise

SIZE = 300
ORDERS = 3
LENGTHS = 32  # classes of texts, each of twice as many letters as the one before
LOW_PERCENT = 10  # the labelled rows of a class below this quantile do not move its bound, so junk among them does not either
FRACTION = 0.65  # of that quantile; texts in other languages and random letters stay below it, clean texts above
MIN_CLASS = 20
_BITS = 21  # of a code point
_SEPARATOR = 1
_CHUNK = 1_000_000


@lru_cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _symbols(text: str) -> np.ndarray:
    """Code points of the letters of a text with one separator before, between and after its words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, _SEPARATOR).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[_SEPARATOR], codes[keep], [_SEPARATOR] if len(letter) and letter[-1] else []]).astype(np.int64)


def _count(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes, times = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(times, first)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text, ascending, and how often each occurs. The separator alone does not count."""
    s = _symbols(text or "")
    if len(s) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts = []
    for start in range(0, len(s), _CHUNK):  # n-grams begin in the chunk
        grams, codes = [], np.zeros(min(_CHUNK, len(s) - start), np.int64)
        for n in range(ORDERS):
            nxt = s[start + n : start + n + len(codes)]
            codes = (codes[: len(nxt)] << _BITS) | nxt
            grams.append(codes if n else codes[codes != _SEPARATOR])
        parts.append(_count(np.concatenate(grams)))
    return _merge(parts)


def _profile(codes: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    return codes[np.argsort(-times, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> pd.DataFrame:
    """Columns lang, code, place: the first `size` n-grams of every language. `size` rows a language reach the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        rows = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, times = _merge(parts)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "code": codes, "times": times})
            held.clear()

        for batch in text_slices(batches, text_col):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            fresh: dict[str, list] = {}
            for lang, text in zip(langs, texts):
                fresh.setdefault(lang, []).append(text or "")
            for lang, own in fresh.items():
                # One separator between texts, and none counted for it twice, keeps their n-grams apart.
                counted = gram_counts("\n".join(own))
                held[lang] = [_merge([*held.get(lang, []), counted])]
            rows = sum(len(p[0][0]) for p in held.values())
            if rows > 1_000_000:
                yield from emit()
        yield from emit()

    labelled = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias(text_col))
    sums = labelled.mapInArrow(count, "lang string, code bigint, times bigint").groupBy("lang", "code").agg(F.sum("times").alias("times"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("times").desc(), "code"))
    first = materialise(sums.withColumn("place", place - 1).filter(F.col("place") < size).drop("times"), "profiles")
    return first.toPandas().sort_values(["lang", "place"], ignore_index=True)


class RankModel:
    """The profile n-grams in order of their codes, each with the languages that list it and its ranks there."""

    def __init__(self, profiles: pd.DataFrame, size: int):
        self.size = size
        self.langs = sorted(profiles["lang"].unique())
        codes = profiles["code"].to_numpy(np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.first, self.listed = np.unique(codes[order], return_index=True, return_counts=True)
        self.lang = pd.Categorical(profiles["lang"], self.langs).codes[order]
        self.place = profiles["place"].to_numpy(np.int64)[order]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and 1 less its distance as a share of the largest possible."""
        codes, times = gram_counts(text)
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = _profile(codes, times, self.size)
        row = np.searchsorted(self.codes, own)
        row[row == len(self.codes)] = 0
        known = np.flatnonzero(self.codes[row] == own)
        first, listed = self.first[row[known]], self.listed[row[known]]
        at = np.repeat(first - (np.cumsum(listed) - listed), listed) + np.arange(listed.sum())
        # An n-gram that a language does not list is `size` places apart; any other one is nearer by `gain`.
        gain = self.size - np.abs(self.place[at] - np.repeat(known, listed))
        distance = len(own) * self.size - np.bincount(self.lang[at], gain, len(self.langs)).astype(np.int64)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (len(own) * self.size))


def predict_languages(
    docs: DataFrame, profiles: pd.DataFrame, text_col: str = "text", size: int = SIZE, lang_out: str = "lang_pred", score_out: str = "score"
) -> DataFrame:
    """`docs` with the predicted language and its score, under names that `docs` does not use."""
    schema = T.StructType(list(docs.schema.fields)).add(lang_out, "string").add(score_out, "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = RankModel(profiles, size)
        for batch in text_slices(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found = [model.predict(t) for t in texts]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, lang_out, score_out])

    return docs.mapInArrow(run, schema)


def identify_languages(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SIZE
) -> DataFrame:
    """id, lang_pred and score of every row, learned from the rows where `training` holds."""
    profiles = learn_profiles(docs.filter(training), text_col, lang_col, size)
    return predict_languages(docs.select(id_col, text_col), profiles, text_col, size).drop(text_col)


def length_class(text_col: str) -> Column:
    """Class of a text by its letters; classes double."""
    letters = F.char_length(F.regexp_replace(text_col, "[^\\p{L}]+", ""))
    return F.least(F.floor(F.log2(F.greatest(letters, F.lit(1)))), F.lit(LENGTHS - 1)).cast("int")


def score_bounds(
    docs: DataFrame, profiles: pd.DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE
) -> pd.DataFrame:
    """Columns lang, length, bound: of each language and class of texts the score below which a text is in no learned language.

    It is `FRACTION` of a low quantile of the scores of the labelled rows found in that language and class. A class
    of less than `MIN_CLASS` rows takes the lowest bound of its language, which takes one quantile of all its rows
    if it has no larger class. A language in which no labelled row is found takes the lowest bound of all.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"))
    found = predict_languages(labelled, profiles, "text", size, "found", "score").filter("found <> 'und'")
    bucket = F.floor(F.col("score") * 1000).cast("int").alias("bucket")
    counts = materialise(found.select("found", length_class("text").alias("length"), bucket).groupBy("found", "length", "bucket").agg(F.count(F.lit(1)).alias("n")), "scores")

    def low(keys: list[str]) -> DataFrame:
        group = Window.partitionBy(*keys)
        up_to = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
        ranked = sums.select(*keys, "bucket", F.sum("n").over(up_to).alias("below"), F.sum("n").over(group).alias("rows"))
        at = F.min(F.when(F.col("below") * 100 >= F.col("rows") * LOW_PERCENT, F.col("bucket")))
        return ranked.groupBy(*keys).agg(F.max("rows").alias("rows"), (FRACTION * at / 1000).alias("bound"))

    classes = low(["found", "length"]).filter(F.col("rows") >= MIN_CLASS).toPandas()  # a row per language and class
    whole = low(["found"]).toPandas().set_index("found")["bound"]
    lowest = classes.groupby("found")["bound"].min().combine_first(whole)
    lowest = lowest.reindex(sorted(profiles["lang"].unique())).fillna(lowest.min() if len(lowest) else 0.0)
    own = dict(zip(zip(classes["found"], classes["length"]), classes["bound"]))
    rows = [(lang, k, float(own.get((lang, k), bound))) for lang, bound in lowest.items() for k in range(LENGTHS)]
    return pd.DataFrame(rows, columns=["lang", "length", "bound"])
