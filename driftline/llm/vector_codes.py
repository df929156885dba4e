"""Compressed vectors: short codes of parts against trained codebooks, in whole numbers.

Vectors are cut into equal parts, and the parts of each position have a codebook of entries. Assigning all parts to their nearest
entries is a depth-first walk through the trie of the distinct parts in lexicographic order: a node at depth d is a prefix of d
components and holds the distances of that prefix to all entries, so parts with a common prefix share them, and a leaf only
takes the smallest distance. The walk takes a block of leaves at a time and keeps the distances along its last path, from which
the next block goes on. Leaves carry how many vectors have the part; sums and counts per entry, weighted by that, are all that a
round hands on, a few rows per task.

Distinct parts are those of a slice of rows, so nothing is shuffled for them, and copies of one vector cost a leaf a slice however
many there are. They are stored sorted once and read in every round. The codebooks (`entries` per part) are all that the
driver holds and each task receives.

All numbers are integers: components are floor(scale * x), means are rounded down, ties go to the lower entry. The result does
therefore not depend on the partitioning.

Defined cases: vectors that are null or hold null or non-finite components are dropped, and so are vectors of another length than
the most frequent one that divides into parts (of equally frequent ones the shorter); scaled components beyond 2^26 either way count
as that bound, so that sums fit 64 bits; repeated rows count each; null ids seed codebooks last; with fewer rows than entries the codebooks
are shorter; null labels are one label; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAVES = 512  # of a block; their distances to all entries are in memory at once
BOUND = 1 << 26


def quantise(vector: Column, scale: int, bound: int = BOUND) -> Column:
    """Components as floor(scale * x) in double precision, held within the bound."""
    limited = lambda x: F.greatest(F.lit(-float(bound)), F.least(F.lit(float(bound)), x.cast("double") * F.lit(float(scale))))
    return F.transform(vector, lambda x: F.floor(limited(x)).cast("int"))


def whole_vectors(vectors: DataFrame, vector_col: str, divisor: int = 1) -> DataFrame:
    """Rows whose vector has only finite components and the most frequent length that the divisor divides."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(v.isNotNull() & finite & (F.size(v) > 0) & (F.size(v) % divisor == 0))
    length = rows.groupBy(F.size(v).alias("length")).count().orderBy(F.col("count").desc(), "length").first()
    return rows if length is None else rows.filter(F.size(v) == length["length"])


def components_of(column: pa.ListArray) -> np.ndarray:
    """A matrix of the vectors of a column."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, how often each occurs, and the place of every row among them."""
    order = np.lexsort(parts.T[::-1])
    ranked = parts[order]
    fresh = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])
    leaf = np.empty(len(parts), np.int64)
    leaf[order] = np.cumsum(fresh) - 1
    return ranked[fresh], np.bincount(leaf), leaf


def nearest_entries(leaves: np.ndarray, book: np.ndarray, block: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each leaf and its squared distance, by a walk through the trie of the leaves.

    `leaves` are best in lexicographic order; in any other order fewer prefixes are shared and the result is the same.
    """
    n, depth = leaves.shape
    entry, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return entry, distance
    span = int(max(abs(int(leaves.min())), abs(int(leaves.max())), abs(int(book.min())), abs(int(book.max()))))
    kind = np.int32 if depth * (2 * span) ** 2 < 2**31 else np.int64
    leaves, columns = leaves.astype(kind), np.ascontiguousarray(book.T.astype(kind))
    differs = np.ones((n, depth), bool)
    differs[1:] = leaves[1:] != leaves[:-1]
    own = np.argmax(differs, axis=1)  # depth at which a leaf leaves the path of the one before
    path = np.zeros((depth + 1, len(book)), kind)  # distances along the path of the last leaf
    for start in range(0, n, block):
        stop = min(start + block, n)
        branch = own[start:stop]
        shared = int(branch.min())  # what all leaves of the block have in common with the path
        # Nodes of depth d in the block: its first leaf and all leaves that branch off above d.
        node = np.zeros(stop - start, np.int64)
        sums = path[shared][None, :]
        for d in range(shared, depth):
            opens = branch <= d
            opens[0] = True
            first = np.flatnonzero(opens)
            step = leaves[start + first, d][:, None] - columns[d][None, :]
            step *= step
            if len(first) > len(sums):
                step += sums[node[first]]
            else:
                step += sums
            sums = step
            node = np.cumsum(opens) - 1
            path[d + 1] = sums[-1]
        entry[start:stop] = sums.argmin(axis=1)[node]
        distance[start:stop] = sums[node, entry[start:stop]]
    return entry, distance


def _books(rows: DataFrame, id_col: str, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the first vectors by id, a bounded number of rows."""
    first = rows.orderBy(F.col(id_col).asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return []
    return np.split(np.array([r["v"] for r in first], np.int64), parts, axis=1)


def _learn(stored: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: entries replaced by the mean of the parts nearest to them, rounded down; unused entries stay."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            position = batch.column(0).to_numpy()
            leaves, weight = components_of(batch.column(1)), batch.column(2).to_numpy()
            for p in np.unique(position):
                mine = position == p
                entry, _ = nearest_entries(leaves[mine], books[p])
                np.add.at(sums[p], entry, leaves[mine].astype(np.int64) * weight[mine][:, None])
                np.add.at(counts[p], entry, weight[mine])
        for p, (total, count) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict(
                {
                    "position": pa.array(np.full(len(used), p, np.int32)),
                    "entry": pa.array(used.astype(np.int32)),
                    "n": pa.array(count[used]),
                    "sums": pa.array(list(total[used]), pa.list_(pa.int64())),
                }
            )

    partial = stored.mapInArrow(gather, "position int, entry int, n bigint, sums array<bigint>")
    flat = partial.select("position", "entry", "n", F.posexplode("sums").alias("k", "total"))
    totals = flat.groupBy("position", "entry", "k").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()
    learnt = [b.copy() for b in books]
    for p, book in enumerate(learnt):
        t = totals[totals["position"] == p]
        book[t["entry"].to_numpy(), t["k"].to_numpy()] = t["total"].to_numpy() // t["n"].to_numpy()
    return learnt


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place within the part."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, codes, error) of every kept vector, and the codebooks by part. `error` is the squared distance to the code."""
    if not 1 <= entries <= 256:
        raise ValueError("codes of one byte need 1 to 256 entries")
    whole = whole_vectors(vectors, vector_col, parts)
    rows = materialise(
        whole.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), quantise(F.col(vector_col), scale).alias("v")), "quantised"
    )
    books = _books(rows, "id", parts, entries)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = components_of(batch.column(0))
            if not matrix.size:
                continue
            for p, part in enumerate(np.split(matrix, parts, axis=1)):
                leaves, weight, _ = distinct_parts(part)
                flat = pa.array(leaves.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * leaves.shape[1]), flat)
                position = pa.array(np.full(len(leaves), p, np.int32))
                yield pa.RecordBatch.from_arrays([position, lists, pa.array(weight)], names=["position", "part", "n"])

    if books:
        stored = materialise(rows.select("v").mapInArrow(split, "position int, part array<int>, n bigint"), "parts")
        for _ in range(rounds):
            books = _learn(stored, books)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = components_of(batch.column(2))
            codes = np.zeros((len(matrix), parts), np.uint8)
            error = np.zeros(len(matrix), np.int64)
            for p, part in enumerate(np.split(matrix, parts, axis=1) if matrix.size else ()):
                leaves, _, leaf = distinct_parts(part)
                entry, distance = nearest_entries(leaves, books[p])
                codes[:, p] = entry[leaf]
                error += distance[leaf]
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(error)], names=["id", "label", "codes", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    coded = rows.mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, codes binary, error bigint")
    return coded, books


def decode(codes: bytes, books: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The vector a code stands for: the middle of each step of 1 / scale."""
    return np.concatenate([books[p][c] for p, c in enumerate(codes)]) / scale + 0.5 / scale


def with_label_error(coded: DataFrame) -> DataFrame:
    """`label_error`, the error summed over rows of equal labels; nulls are one label.

    Sums are reduced in each task before they are shuffled, and stored: the join then knows their size, and a label with a third of
    all rows is no more than one row on that side.
    """
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    sums = sums.withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
