"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by k-means with a penalty on crowded clusters. Every vector is indexed: it
goes to its nearest centroid and, as a boundary vector, also to others almost as near, unless a centroid
chosen before lies closer to that one (those two lists are visited together anyway). Queries find centroids by
best-first search in a neighbour graph of the centroids held in memory; a list is searched while its centroid is not farther than the
reach times a ratio. The reach is the distance of the list that completes enough candidates, lists taken nearest first: mostly
the nearest one, but more for a query whose nearest centroids sit on lone vectors. Scores are cosines of the original vectors in double precision.

Lists are split into blocks of bounded size, and the queries of a list likewise, so that a list with a third of all vectors
is many small matrix products; a task returns the best few per query and block. Equal vectors are searched once: each
distinct vector stands for the smallest ids that carry it, enough for any answer.

The centroids (at most `max_lists`) are the only thing each task receives.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a
null id or vectors of another length than most of the sample; repeated rows with the same id count once; a query
is never its own neighbour; with fewer candidates than asked for, all are returned; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import materialise

SAMPLE = 20_000
LIST_LENGTH = 200
MAX_LISTS = 2048
REPLICAS = 4
BOUNDARY = 1.1  # a centroid this much farther than the nearest still takes the vector
RATIO = 1.25  # and this much farther a query still searches the list
ENOUGH = REPLICAS  # entries for each neighbour asked for that set the reach; a vector has `REPLICAS` at most, so the answers are full
DEGREE = 16
BEAM = 16
BLOCK = 2000


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Unit centroids; a cluster above its fair share becomes less attractive in the next round."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    fair, penalty = len(sample) / lists, np.zeros(lists)
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centroids.T - penalty).argmax(axis=1) for part in np.array_split(sample, -(-len(sample) // 4096))])
        size = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1)
        alive = norm > 1e-9
        centroids[alive] = sums[alive] / norm[alive, None]
        penalty += 0.02 * np.log((size + 1) / (fair + 1))
    return centroids


class CentroidGraph:
    """Neighbour graph of the centroids; best-first search for a batch of queries at a time."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.centroids = centroids
        lists = len(centroids)
        near = centroids @ centroids.T
        np.fill_diagonal(near, -2)
        nearest = np.argsort(-near, axis=1, kind="stable")[:, : min(degree, lists - 1)]
        # A ring through all nodes keeps the graph in one piece.
        ring = np.stack([(np.arange(lists) + 1) % lists, (np.arange(lists) - 1) % lists], axis=1)
        self.neighbours = np.concatenate([nearest, ring], axis=1)
        # Entry points far apart from each other, so that no cluster of centroids is left without one.
        entries, near_entry = [0], near[0].copy()
        near_entry[0] = np.inf
        for _ in range(min(lists, max(32, 4 * int(np.sqrt(lists)))) - 1):
            entries.append(int(np.argmin(near_entry)))
            near_entry = np.maximum(near_entry, near[entries[-1]])
            near_entry[entries[-1]] = np.inf
        self.entries = np.array(entries)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each query up to `width` centroids found, nearest first, and their squared distances; -1 pads."""
        lists, rows = len(self.centroids), np.arange(len(queries))[:, None]
        width = min(width, lists)
        seen = np.zeros((len(queries), lists), bool)
        open_ = np.zeros((len(queries), lists), bool)
        close = np.full((len(queries), lists), -np.inf)

        def visit(nodes: np.ndarray) -> None:
            fresh = ~seen[rows, nodes]
            seen[rows, nodes] = True
            value = np.einsum("qd,qnd->qn", queries, self.centroids[nodes])
            close[rows, nodes] = value
            open_[rows, nodes] |= fresh

        visit(np.broadcast_to(self.entries, (len(queries), len(self.entries))))
        step = min(max(1, width // 8), 8, lists)
        while True:
            # Expand the nearest open nodes while they are among the `width` nearest seen.
            value = np.where(open_, close, -np.inf)
            best = np.argpartition(-value, step - 1, axis=1)[:, :step]
            value = np.take_along_axis(value, best, 1)
            bound = -np.partition(-close, width - 1, axis=1)[:, width - 1 : width]
            go = np.isfinite(value) & (value >= bound)
            if not go.any():
                break
            open_[rows, best] &= ~go
            visit(np.where(go[:, :, None], self.neighbours[best], best[:, :, None]).reshape(len(queries), -1))
        order = np.argsort(-close, axis=1, kind="stable")[:, :width]
        value = close[rows, order]
        return np.where(np.isfinite(value), order, -1), 2 - 2 * np.where(np.isfinite(value), value, -1.0)


def reached_lists(
    graph: CentroidGraph, queries: np.ndarray, length: np.ndarray, enough: int, ratio: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a query's place and a list that it searches.

    The beam starts narrow. It is doubled for those queries whose lists found hold too few entries, or whose last list
    found still lies within reach.
    """
    left, width = np.arange(len(queries)), BEAM
    while len(left):
        list_, distance = graph.search(queries[left], width)
        distance = np.sqrt(np.maximum(distance, 0))
        held = np.cumsum(np.where(list_ >= 0, length[list_], 0), axis=1)
        last = np.minimum((held < enough).sum(axis=1, keepdims=True), list_.shape[1] - 1)  # the list that completes them
        limit = ratio * np.maximum(np.take_along_axis(distance, last, 1), 1e-6)
        done = (held[:, -1] >= enough) & (distance[:, -1] > limit[:, 0]) & (list_[:, -1] >= 0)
        if width >= len(length):
            done[:] = True
        q, k = np.nonzero(done[:, None] & (list_ >= 0) & (distance <= limit))
        yield left[q], list_[q, k]
        left, width = left[~done], 2 * width


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of finite doubles that are not zero."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, queries: Column, holders: int) -> DataFrame:
    """(id, v, ids, asks): each distinct vector under its smallest id, with the `holders` smallest ids that carry
    it; `asks` says whether a query carries it. Ranks are cut before the shuffle, so frequent vectors stay cheap."""
    rows = rows.dropDuplicates(["id"]).withColumn("query", queries)
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = rows.withColumn("place", place).filter(F.col("place") <= holders)
    asked = rows.filter("query").select("v").distinct().withColumn("asks", F.lit(True))
    grouped = first.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))
    return grouped.join(asked, "v", "left").select("id", "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))


def search(
    vectors: DataFrame,
    queries: Column,
    neighbours: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
    list_length: int = LIST_LENGTH,
    max_lists: int = MAX_LISTS,
    ratio: float = RATIO,
    boundary: float = BOUNDARY,
) -> DataFrame:
    """(query_id, rank, id, score) of the `neighbours` nearest found of each row where `queries`, a condition on `id`, holds."""
    rows = materialise(usable(vectors, id_col, vector_col), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"query_id {kind}, rank int, `{id_col}` {kind}, score double"
    first = lambda df: df.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample).select("v")
    sizes = first(rows).select(F.size("v").alias("size")).toPandas()["size"]  # of at most `sample` vectors
    if sizes.empty:
        return rows.sparkSession.createDataFrame([], shape)
    size = Counter(sizes).most_common(1)[0][0]
    rows = rows.filter(F.size("v") == int(size))
    distinct = materialise(distinct_vectors(rows, queries, neighbours + 1), "distinct")
    # Scaled by the largest component first, so that squares of tiny or huge ones stay in range.
    fitted = _units(first(distinct).toPandas()["v"])
    lists = int(min(max_lists, len(fitted), max(1, distinct.count() // list_length)))
    graph = CentroidGraph(balanced_centroids(fitted, lists))

    def assign(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for start in range(0, len(f), 1024):
                part = f.iloc[start : start + 1024]
                v = _units(part["v"])
                list_, distance = graph.search(v, 4 * REPLICAS)
                chosen = np.zeros(list_.shape, bool)
                chosen[:, 0] = True
                for k in range(1, list_.shape[1]):
                    near = (list_[:, k] >= 0) & (np.sqrt(np.maximum(distance[:, k], 0)) <= boundary * np.sqrt(np.maximum(distance[:, 0], 0)))
                    apart = 2 - 2 * np.einsum("qd,qkd->qk", graph.centroids[list_[:, k]], graph.centroids[list_[:, :k]])
                    covered = (chosen[:, :k] & (apart < distance[:, k : k + 1])).any(axis=1)
                    chosen[:, k] = near & ~covered & (chosen[:, :k].sum(axis=1) < REPLICAS)
                q, k = np.nonzero(chosen)
                yield part.iloc[q][["id", "v"]].assign(list=list_[q, k])

    schema = f"id {kind}, v array<double>, list int"
    entries = materialise(distinct.select("id", "v").mapInPandas(assign, schema), "entries")
    held = entries.groupBy("list").count().toPandas()  # a row per list
    length = np.zeros(lists, np.int64)
    length[held["list"].to_numpy()] = held["count"].to_numpy()
    enough = ENOUGH * (neighbours + 1)

    def route(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for start in range(0, len(f), 256):
                part = f.iloc[start : start + 256]
                for places, list_ in reached_lists(graph, _units(part["v"]), length, enough, ratio):
                    yield part.iloc[places][["id", "v"]].assign(list=list_)

    asks = materialise(distinct.filter("asks").select("id", "v").mapInPandas(route, schema), "asks")
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = materialise(blocks(entries, "blocks").join(blocks(asks, "turns"), "list"), "sizes")  # a row per list
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    held = entries.join(sizes, "list").select("list", deal("blocks").alias("block"), spread("turns").alias("turn"), "id", "v")
    asked = asks.join(sizes, "list").select(
        F.col("list").alias("a_list"), spread("blocks").alias("a_block"), deal("turns").alias("a_turn"), F.col("id").alias("query"), F.col("v").alias("q")
    )

    def compare(right: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        if right.empty or left.empty:
            return pd.DataFrame({"query": [], "near": [], "score": []})
        right = right.sort_values("id", ignore_index=True)
        score = cosines(np.stack(left["q"]), np.stack(right["v"]))
        keep = min(neighbours + 1, len(right))
        order = np.argsort(-score, axis=1, kind="stable")[:, :keep]  # ties to the smaller id
        who = np.repeat(left["query"].to_numpy(), keep)
        return pd.DataFrame({"query": who, "near": right["id"].to_numpy()[order.ravel()], "score": np.take_along_axis(score, order, 1).ravel()})

    found = (
        held.groupBy("list", "block", "turn")
        .cogroup(asked.groupBy("a_list", "a_block", "a_turn"))
        .applyInPandas(compare, f"query {kind}, near {kind}, score double")
    )
    # A query keeps the vectors that answer it: at most one more than asked for, itself among them.
    found = found.groupBy("query", "near").agg(F.max("score").alias("score"))
    top = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "near"))
    found = found.withColumn("place", top).filter(F.col("place") <= neighbours + 1)
    carried = distinct.select(F.col("id").alias("near"), "ids")
    answers = materialise(found.join(carried, "near").select("query", "score", F.explode("ids").alias("found")), "answers")

    # All queries that carry a vector get its answers, each without itself.
    askers = rows.dropDuplicates(["id"]).filter(queries).select("id", "v")
    askers = askers.join(distinct.select(F.col("id").alias("query"), "v"), "v").select(F.col("id").alias("query_id"), "query")
    each = askers.join(answers, "query").filter(F.col("query_id") != F.col("found"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "found"))
    ranked = each.withColumn("rank", rank).filter(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", F.col("found").alias(id_col), "score")


def _units(values: Iterable) -> np.ndarray:
    v = np.stack(list(values)).astype(float)
    return unit(v / np.abs(v).max(axis=1, keepdims=True))


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of every pair in double precision; scaled so that squares neither overflow nor vanish."""
    q = queries / np.abs(queries).max(axis=1, keepdims=True)
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :])
