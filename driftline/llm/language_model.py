"""Scoring by a log-bilinear language model, trained by noise-contrastive estimation.

Vocabulary and counts come from all training documents. The context of a word is the two words before it:
    h = C1 * R[w1] + C2 * R[w2]          (C1 and C2 are diagonal)
    p(v | h) = p(class of v | h) * p(v | class, h)
    p(class | h) ~ exp(Qc[class] . h + bc[class])        p(v | class, h) ~ exp(Q[v] . h + b[v]) within the class
The modelled words are the most frequent ones; their number grows with the cube root of the training tokens
(`words_modelled`). They stand in order of frequency and are cut into about as many classes as a class has words, each
with the same share of the square roots of the counts, so that the most frequent words are classes of their own. All other
words are one class, in which a word takes its add-one share: the probabilities of all words, one unseen word included,
sum to one. Both sets of scores learn by noise-contrastive estimation, the noise being the unigrams of words and of classes.

Normalising takes two matrix products per block of tokens: contexts by classes, and for every class the contexts of its
tokens by its words. The work per token grows with the square root of the vocabulary.

How the work is spread. Documents are tokenised once, in blocks: each task writes token numbers local to its block, and the
block's own word list. Counts are summed over those lists, joined back to them, and each block is resolved beside its
list; no row per token is ever shuffled. Training runs in rounds over disjoint shares of all documents: every
learner makes its steps from the same start, and each word's parameters are averaged by the number of steps that touched the
word, so that a rare word's lesson is not thinned out by learners that never met it; words nobody met stay as they were.
The number of learners follows from the tokens and the size of the model, not from the partitions of the table.
The driver sees the model: (2 * words + classes) * (width + 1) numbers.

Defined cases: null text is empty and is one end token; without training tokens the model is the uniform one over its
classes; null ids are kept and count as empty text in the split; repeated rows are scored and, if in training,
counted each for itself; no rows give no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import as_bytes, text_slices
from driftline.session import materialise

VOCABULARY_RATE = 48  # words modelled per cube root of the training tokens
WIDTH = 32
NOISE = 64
ROUNDS = 3
BATCH = 4096
RATE = 0.1
BLOCK_TOKENS = 3_000_000
LEARNER_TOKENS = 256  # tokens of all rounds that a learner takes, per word of the vocabulary
SCORED_TOGETHER = 65_536
START, REST = 0, 1  # ids before the first word, and of all words outside the vocabulary
_END = b""  # the end of a text; no word is empty


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, all lowest bytes first: the higher ones are mostly zero, and zeros side by side compress well."""
    return numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def tokenised(docs: DataFrame, training: Column, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds per block: documents (id, train, tokens) and words (number, word, n in training)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = None, 0
        numbers: dict[bytes, int] = {}
        counts = np.zeros(0, np.int64)

        def words() -> pa.RecordBatch:
            known = len(numbers)
            return rows(block, [None] * known, [None] * known, [None] * known, range(known), list(numbers), counts[:known])

        def rows(block, ids, train, tokens, number, word, n) -> pa.RecordBatch:
            nothing = [None] * len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), block, np.int64)),
                    ids if isinstance(ids, pa.Array) else pa.array(ids, kind_of_id),
                    pa.array(train, pa.bool_()),
                    pa.array(tokens, pa.binary()),
                    pa.array(nothing if number is None else number, pa.int32()),
                    pa.array(nothing if word is None else word, pa.binary()),
                    pa.array(nothing if n is None else n, pa.int64()),
                ],
                names=["block", "id", "train", "tokens", "number", "word", "n"],
            )

        kind_of_id = None
        for batch in text_slices(batches, "text"):
            ids = batch.column(0)
            kind_of_id = ids.type
            if block is None or size >= BLOCK_TOKENS:
                if block is not None:
                    yield words()
                # Named by its first row, so that a repeated task names it alike.
                block = batch.column(3)[0].as_py()
                numbers = defaultdict(itertools.count().__next__)
                counts, size = np.zeros(0, np.int64), 0
            tokens = []
            train = batch.column(1).to_pylist()
            learned = []
            for text, use in zip(as_bytes(batch, "text"), train):
                split = text.lower().split()
                split.append(_END)
                own = np.fromiter(map(numbers.__getitem__, split), np.int32, len(split))
                size += len(own)
                tokens.append(packed(own))
                if use:
                    learned.append(own)
            if len(counts) < len(numbers):
                counts = np.concatenate([counts, np.zeros(2 * len(numbers) - len(counts), np.int64)])
            if learned:
                seen = np.bincount(np.concatenate(learned), minlength=len(counts))
                counts[: len(seen)] += seen
            yield rows(block, ids, train, tokens, None, None, None)
        if block is not None:
            yield words()

    kind = docs.schema[id_col].dataType.simpleString()
    place = F.monotonically_increasing_id().alias("place")
    given = docs.select(F.col(id_col).alias("id"), training.alias("train"), F.col(text_col).alias("text"), place)
    schema = f"block bigint, id {kind}, train boolean, tokens binary, number int, word binary, n bigint"
    return given.mapInArrow(run, schema)


def words_modelled(tokens: int, rate: float = VOCABULARY_RATE) -> int:
    """Size of the vocabulary, START and REST included."""
    return 2 + int(rate * tokens ** (1 / 3))


def word_counts(stored: DataFrame) -> DataFrame:
    """word, c: occurrences in training documents, over all blocks; words seen elsewhere only have 0."""
    return stored.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c"))


def resolved(stored: DataFrame, counts: DataFrame, vocabulary: DataFrame, kind_of_word: type) -> DataFrame:
    """Per document: id, train, n_tokens, n_known, log_counts (sum of log10(c + 1)), rest, rest_logs, model (ids).

    `rest` counts the tokens outside the vocabulary, `rest_logs` is their part of log_counts.
    """
    known = counts.join(vocabulary, "word", "left").select("word", "c", F.coalesce("model", F.lit(REST)).alias("model"))
    lists = stored.filter("word is not null").select(F.col("block").alias("list"), "number", "word").join(known, "word").drop("word")
    texts = stored.filter("word is null").select("block", "id", "train", "tokens")

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words["number"].to_numpy())
        c, model = words["c"].to_numpy()[order], words["model"].to_numpy()[order].astype(kind_of_word)
        logs = np.log10(c + 1.0)
        out = []
        for tokens in docs["tokens"].to_pylist():
            at = unpacked(tokens)
            ids, own = model[at], logs[at]
            rest = ids == REST
            out.append((len(at), int((c[at] > 0).sum()), float(own.sum()), int(rest.sum()), float(own[rest].sum()), ids.tobytes()))
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "log_counts": pa.float64(), "rest": pa.int64(), "rest_logs": pa.float64(), "model": pa.binary()}
        columns = zip(*out) if out else [[]] * len(kinds)
        found = {name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), columns)}
        return pa.table({"id": docs["id"], "train": docs["train"]} | found)

    kind = stored.schema["id"].dataType.simpleString()
    schema = f"id {kind}, train boolean, n_tokens bigint, n_known bigint, log_counts double, rest bigint, rest_logs double, model binary"
    return texts.groupBy("block").cogroup(lists.groupBy("list")).applyInArrow(run, schema)


class LogBilinear:
    """Parameters as one table of width + 1 columns: R (the last column is unused) and Q with b of the words, Qc with bc
    of the classes, C1 and C2. `counts` are those of the words by id, from REST on in falling order; START has none."""

    def __init__(self, counts: np.ndarray, width: int, table: np.ndarray | None = None, seed: int = 0):
        self.size, self.width = len(counts), width
        share = np.sqrt(counts[1:])
        turns = np.floor(np.cumsum(share) / share.sum() * np.sqrt(self.size)).astype(np.int64)
        # REST is a class by itself, then equal shares; a word that spans several shares is one class.
        new = np.concatenate([[True, True], np.diff(turns)[1:] > 0])[: self.size - 1]
        self.class_of = np.concatenate([[0], np.cumsum(new) - 1])
        self.cuts = np.concatenate([np.flatnonzero(new) + 1, [self.size]])  # the words of a class are neighbours
        self.classes = len(self.cuts) - 1
        self.words_noise = counts / counts.sum()
        self.class_noise = np.add.reduceat(self.words_noise, self.cuts[:-1])
        self.length = 2 * self.size + self.classes + 2
        if table is None:
            table = np.random.default_rng(seed).normal(0, 0.1, (self.length, width + 1)).astype(np.float32)
            table[: self.size, -1] = 0
            with np.errstate(divide="ignore"):
                table[self.size : 2 * self.size, -1] = np.maximum(np.log(self.words_noise), -80)
                table[2 * self.size : -2, -1] = np.log(self.class_noise)
            table[-2], table[-1] = 1, 0.5
        self.table = table

    def hidden(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Contexts, and a one for the bias."""
        h = self.table[-2] * self.table[near] + self.table[-1] * self.table[far]
        h[:, -1] = 1
        return h

    def train(self, near: np.ndarray, far: np.ndarray, target: np.ndarray, rate: float, samples: int, seed: int) -> None:
        """One pass of noise-contrastive steps; the noise of a batch is shared by its tokens.

        Steps shrink with the squared gradients that a parameter has seen (AdaGrad), which start at 1.
        `touched` counts the batches in which a row of the table had a gradient.
        """
        rng = np.random.default_rng(seed)
        if not hasattr(self, "seen"):
            self.seen, self.touched = np.ones_like(self.table), np.zeros(self.length, np.int64)
        heads = []
        for base, noise in ((self.size, self.words_noise), (2 * self.size, self.class_noise)):
            with np.errstate(divide="ignore"):
                heads.append((base, np.cumsum(noise), np.log(noise * samples).astype(np.float32)))
        for start in range(0, len(target), BATCH):
            v = target[start : start + BATCH]
            order = np.argsort(v, kind="stable")  # tokens of a word, and of a class, side by side
            w1, w2, v = (x[start : start + BATCH][order] for x in (near, far, target))
            r1, r2 = self.table.take(w1, axis=0), self.table.take(w2, axis=0)
            hidden = self.table[-2] * r1
            hidden += self.table[-1] * r2
            hidden[:, -1] = 1
            toward, moves = np.zeros_like(hidden), []
            for (base, cumulative, log_noise), wanted in zip(heads, (v, self.class_of[v])):
                drawn = np.searchsorted(cumulative, rng.random(samples) * cumulative[-1], side="right")
                drawn = np.sort(np.minimum(drawn, len(cumulative) - 1))
                first = _firsts(wanted)
                at = wanted[first].astype(np.int64)
                # The logarithm of the noise goes into the bias: the last column meets a one.
                q, noise = self.table.take(base + wanted.astype(np.int64), axis=0), self.table[base + drawn]
                q[:, -1] -= log_noise[wanted]
                noise[:, -1] -= log_noise[drawn]
                true = _sigmoid(np.einsum("ij,ij->i", hidden, q))  # 1 - sigmoid of the score
                false = _sigmoid(hidden @ -noise.T)
                q *= true[:, None]
                toward += q
                toward -= false @ noise
                away = _firsts(drawn)
                moves.append((base + at, _run_sums(true[:, None] * hidden, first)))
                moves.append((base + drawn[away], -_run_sums(false.T @ hidden, away)))
            toward[:, -1] = 0
            both = np.stack([np.einsum("ij,ij->j", toward, r1), np.einsum("ij,ij->j", toward, r2)])
            words, at = np.concatenate([w1, w2]), np.empty((2 * len(v), self.width + 1), np.float32)
            np.multiply(toward, self.table[-2], out=at[: len(v)])
            np.multiply(toward, self.table[-1], out=at[len(v) :])
            order = np.argsort(words, kind="stable")
            first = _firsts(words[order])
            moves.append((words[order[first]].astype(np.int64), _run_sums(at.take(order, axis=0), first)))
            moves.append((np.array([self.length - 2, self.length - 1]), both))
            for at, gradient in moves:
                self.touched[at] += 1
                seen = self.seen.take(at, axis=0)
                seen += gradient * gradient
                self.seen[at] = seen
                np.sqrt(seen, out=seen)
                gradient /= seen
                gradient *= np.float32(rate)
                gradient += self.table.take(at, axis=0)
                self.table[at] = gradient

    def log_probabilities(self, near: np.ndarray, far: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of p(target | far, near) for every token; over all targets but START they sum to one."""
        out = np.empty(len(target))
        q, qc = self.table[self.size : 2 * self.size], self.table[2 * self.size : -2]
        for start in range(0, len(target), SCORED_TOGETHER):
            v = target[start : start + SCORED_TOGETHER]
            order = np.argsort(v, kind="stable")
            w1, w2, v = (x[start : start + SCORED_TOGETHER][order] for x in (near, far, target))
            hidden, wanted = self.hidden(w1, w2), self.class_of[v]
            logs = np.empty(len(v))
            for first in range(0, len(v), BATCH):  # as many scores as the cache holds
                some = slice(first, first + BATCH)
                logs[some] = _log_softmax(hidden[some] @ qc.T, wanted[some])
            ends = np.searchsorted(wanted, np.arange(self.classes + 1))
            for c in np.flatnonzero((np.diff(ends) > 0) & (np.diff(self.cuts) > 1)):
                first, last = self.cuts[c], self.cuts[c + 1]
                for at in range(ends[c], ends[c + 1], BATCH):
                    own = slice(at, min(at + BATCH, ends[c + 1]))
                    logs[own] += _log_softmax(hidden[own] @ q[first:last].T, v[own].astype(np.int64) - first)
            out[start + order] = logs
        return out


def _log_softmax(scores: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of each row, the normalised logarithm of one column. Overwrites the scores."""
    own = scores[np.arange(len(scores)), wanted].astype(np.float64)
    limit = np.abs(scores).max() if scores.size else 0
    top = 0.0
    if not limit < 60:  # exp of 32-bit numbers overflows at 88, and their sums earlier
        top = scores.max(axis=1)
        scores -= top[:, None]
    np.exp(scores, out=scores)
    return own - top - np.log(scores @ np.ones(scores.shape[1], np.float32))


def _sigmoid(minus_x: np.ndarray) -> np.ndarray:
    """Of the negated argument, in place. What overflows becomes zero, as it should."""
    with np.errstate(over="ignore"):
        np.exp(minus_x, out=minus_x)
    minus_x += 1
    return np.reciprocal(minus_x, out=minus_x)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _run_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of each run; most runs are short, and few hold many rows."""
    runs = np.diff(np.append(first, len(rows)))
    out = rows.take(first, axis=0)
    for i in np.flatnonzero(runs > 16):
        out[i] = rows[first[i] : first[i] + runs[i]].sum(axis=0)
    left = np.flatnonzero((runs > 1) & (runs <= 16))
    for k in range(1, 16):
        if not len(left):
            break
        out[left] += rows.take(first[left] + k, axis=0)
        left = left[runs[left] > k + 1]
    return out


def contexts(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before, the one before that, and the word, for every token of texts that begin at `starts`."""
    near = np.concatenate([[START], tokens[:-1]]).astype(tokens.dtype)
    far = np.concatenate([[START, START], tokens[:-2]]).astype(tokens.dtype)[: len(tokens)]
    near[starts] = far[starts] = START
    second = starts + 1
    far[second[second < len(tokens)]] = START
    return near, far, tokens


def joined(texts: Iterable[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of several texts in a row, and where each begins. Every text has its end at least."""
    texts = list(texts)
    ends = np.cumsum([len(t) for t in texts]) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(texts), kind), np.concatenate([[0], ends[:-1]]).astype(np.int64)


def fit(
    rows: DataFrame, counts: np.ndarray, kind: type, width: int = WIDTH, rounds: int = ROUNDS, rate: float = RATE, samples: int = NOISE
) -> LogBilinear:
    """Rounds over disjoint shares of the training rows, together all of them."""
    model = LogBilinear(counts, width)
    learners = 1 + int(counts.sum()) // (LEARNER_TOKENS * model.size)
    cells = [f"x{i}" for i in range(width + 1)]
    for turn in range(rounds):
        start, step = model.table.copy(), rate / (1 + turn)

        def run(batches: Iterable[pa.RecordBatch], start=start, step=step, turn=turn) -> Iterator[pa.RecordBatch]:
            own, tokens, held, waiting = LogBilinear(counts, width, start.copy()), 0, [], 0

            def learn() -> int:
                near, far, target = contexts(*joined(held, kind))
                order = np.random.default_rng(tokens).permutation(len(target))
                own.train(near[order], far[order], target[order], step, samples, tokens + turn)
                return len(target)

            for batch in batches:
                for text in batch.column(0).to_pylist():
                    held.append(text)
                    waiting += len(text) // np.dtype(kind).itemsize
                    if waiting > 1_000_000:
                        tokens += learn()
                        held, waiting = [], 0
            if held:
                tokens += learn()
            if tokens:
                met = np.flatnonzero(own.touched)
                found = {"row": pa.array(met, pa.int32()), "weight": pa.array(own.touched[met])}
                moved = (own.table[met] - start[met]) * own.touched[met, None]
                yield pa.RecordBatch.from_pydict(found | {x: pa.array(moved[:, i], pa.float32()) for i, x in enumerate(cells)})

        share = rows.filter(F.col("train") & (F.pmod(F.xxhash64("n_tokens", "log_counts"), F.lit(rounds)) == turn)).select("model")
        schema = "row int, weight bigint, " + ", ".join(f"{x} float" for x in cells)
        parts = share.coalesce(learners).mapInArrow(run, schema)
        means = [(F.sum(x) / F.sum("weight")).cast("float").alias(x) for x in cells]
        merged = parts.groupBy("row").agg(*means).toPandas()  # at most the model
        if len(merged):
            table = start.copy()
            table[merged["row"].to_numpy()] += merged[cells].to_numpy(np.float32)
            model = LogBilinear(counts, width, table)
    return model


def score_documents(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_size: int | None = None,
    width: int = WIDTH,
    rounds: int = ROUNDS,
) -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, both log10 of the text.

    `vocabulary_size` fixes the number of words modelled; None lets it grow with the training tokens.
    """
    stored = materialise(tokenised(docs, training, id_col, text_col), "tokens", "zstd")
    counts = materialise(word_counts(stored), "counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = int(totals["n"] or 0), int(totals["v"])
    modelled = (vocabulary_size or words_modelled(n)) - 2
    first = counts.filter("c > 0").orderBy(F.col("c").desc(), "word").limit(modelled).toPandas()
    kind = np.uint16 if len(first) + 2 <= 1 << 16 else np.uint32
    vocabulary = first[["word"]].assign(model=np.arange(2, len(first) + 2, dtype=np.int32))
    spark = docs.sparkSession
    vocabulary = spark.createDataFrame([(bytes(w), int(m)) for w, m in vocabulary.itertuples(index=False)], "word binary, model int")
    rows = materialise(resolved(stored, counts, vocabulary, kind), "resolved", "zstd")

    inside = first["c"].to_numpy(np.float64)
    rest_tokens, rest_words = n - int(inside.sum()), v - len(first)
    smoothed = np.concatenate([[0.0], [rest_tokens + rest_words + 1.0], inside + 1.0])  # START never follows anything
    model = fit(rows, smoothed, kind, width, rounds)
    base_norm, rest_norm = np.log10(n + v + 1.0), np.log10(rest_tokens + rest_words + 1.0)
    table = model.table

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LogBilinear(smoothed, width, table)
        for batch in text_slices(batches, "model"):
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            tokens, starts = joined(column["model"].to_pylist(), kind)
            logs = np.add.reduceat(own.log_probabilities(*contexts(tokens, starts)), starts) / np.log(10)
            scores = logs + column["rest_logs"].to_numpy() - column["rest"].to_numpy() * rest_norm
            base = column["log_counts"].to_numpy() - column["n_tokens"].to_numpy() * base_norm
            new = {"train_tokens": np.full(len(scores), n), "base_score": base, "score": scores}
            yield pa.RecordBatch.from_pydict({name: column[name] for name in ("id", "train", "n_tokens", "n_known")} | new)

    id_kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
