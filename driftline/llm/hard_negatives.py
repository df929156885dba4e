"""Hard negatives: rows of another label that score nearly as high with an anchor as its positives do.

Scores are inner products of whole numbers. Rows are packed into R-trees by sort-tile-recursion: a range partition by (label, leading
coordinate, id) gives each tree a tile of rows, inside which rows are sorted and cut along the widest coordinate in turn down to
leaves. A node knows the box of its rows, coordinate by coordinate, and their range of labels. From the box follows an interval for the inner
product with an anchor: each coordinate adds the smaller and the larger product with the two sides.

An anchor's queue takes nodes by the upper end of that interval, highest first. Nodes are left out whose interval lies outside all
score windows of the anchor, whose labels cannot serve it, or whose upper end is strictly below the k-th score found so far in
every window (a node as high as that may hold a smaller id). The anchors of a group take a step together: each
opens its next few nodes, and anchors that open the same leaf share one matrix product.

Groups are pairs of a tree and a block of anchors, both of bounded size. Anchors visit their trees in two rounds: in the first about the square root
of their number, starting at a place of their own; the k-th scores found there are where the second round starts, so that
few candidates leave a group. Positives come from the trees of the anchor's own label, negatives from all.

Defined cases: rows with a null id or label, a null vector, or any null or non-finite component take no part, nor do vectors of
another length than the most frequent one (of equally frequent ones the shorter); scaled components beyond 2^26 either way count as that bound; of
rows with the same id the least (label, vector) counts; ties of scores go to the smaller id; an anchor without positives has no negatives; with
fewer rows than asked for, all are returned; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.vector_codes import components_of, quantise, whole_vectors
from driftline.operators.labels import first_per_key
from driftline.session import materialise

TILE = 32_768  # rows of a tree
ANCHORS = 8_192  # anchors of a block
LEAF = 64  # rows of a leaf
FANOUT = 16  # children of an inner node
NONE = -(1 << 62)  # below every score
LEAVES = (
    "tile int, leaf int, ids array<bigint>, labels array<bigint>, v array<int>, low array<int>, high array<int>,"
    " label_low bigint, label_high bigint"
)


def tile_order(vectors: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Rows of each leaf by sort-tile-recursion: sorted along the widest coordinate, cut into slabs, and so on."""
    pages = -(-len(vectors) // leaf)
    levels = max(1, int(np.log2(pages)) // 2)
    slabs = max(2, round(pages ** (1 / levels)))
    out: list[np.ndarray] = []

    def pack(rows: np.ndarray, level: int) -> None:
        if len(rows) <= leaf:
            out.append(rows)
            return
        part = vectors[rows]
        widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        rows = rows[np.argsort(part[:, widest], kind="stable")]
        count = -(-len(rows) // leaf)
        size = leaf * -(-count // (slabs if level < levels else count))
        for start in range(0, len(rows), size):
            pack(rows[start : start + size], level + 1)

    pack(np.arange(len(vectors)), 1)
    return out


class Tree:
    """Boxes of a packed tile, level by level from the root's children down to the leaves."""

    def __init__(self, low: np.ndarray, high: np.ndarray, label_low: np.ndarray, label_high: np.ndarray, fanout: int = FANOUT):
        self.levels = [(low, high, label_low, label_high)]
        while len(self.levels[0][0]) > fanout:
            starts = np.arange(0, len(self.levels[0][0]), fanout)
            low, high, label_low, label_high = self.levels[0]
            self.levels.insert(
                0,
                (
                    np.minimum.reduceat(low, starts),
                    np.maximum.reduceat(high, starts),
                    np.minimum.reduceat(label_low, starts),
                    np.maximum.reduceat(label_high, starts),
                ),
            )
        self.fanout = fanout

    def bounds(self, anchors: np.ndarray, labels: np.ndarray, floors: np.ndarray, ceilings: np.ndarray, same: bool) -> np.ndarray:
        """Upper end of each leaf's interval for each anchor; NONE where it or a node above it is left out.

        `floors` and `ceilings` are the ends of the score windows, one column per window.
        """
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        alive = None
        for low, high, label_low, label_high in self.levels:
            upper = up @ high.T + down @ low.T
            lower = up @ low.T + down @ high.T
            inside = np.zeros(upper.shape, bool)
            for j in range(floors.shape[1]):
                inside |= (upper >= floors[:, j : j + 1]) & (lower <= ceilings[:, j : j + 1])
            one = labels[:, None]
            serves = (label_low <= one) & (one <= label_high) if same else (label_low != one) | (one != label_high)
            inside &= serves
            if alive is not None:
                inside &= np.repeat(alive, self.fanout, axis=1)[:, : inside.shape[1]]
            alive = inside
        return np.where(alive, upper, NONE)


def best_first(
    tree: Tree,
    starts: np.ndarray,
    ids: np.ndarray,
    row_labels: np.ndarray,
    rows: np.ndarray,
    anchors: np.ndarray,
    anchor_ids: np.ndarray,
    labels: np.ndarray,
    floors: np.ndarray,
    ceilings: np.ndarray,
    same: bool,
    k: int,
    opened: list[int] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, window, id, score) of the first k rows in every window of every anchor, scores at the floor of the window or above.

    Rows of leaf i are `starts[i]` to `starts[i + 1]`. `opened` gets the number of leaves that each round opened.
    """
    windows = floors.shape[1]
    floors = floors.copy()
    bound = tree.bounds(anchors, labels, floors, ceilings, same)
    queue = np.argsort(-bound, axis=1, kind="stable")  # of all leaves left: what a queue of nodes by upper end hands out
    bound = np.take_along_axis(bound, queue, 1)
    left = (bound > NONE).sum(axis=1)
    at = np.zeros(len(anchors), np.int64)
    kept = tuple(np.zeros(0, np.int64) for _ in range(4))
    width = 1
    while True:
        # An anchor goes on while its next leaf may still reach the floor of some window.
        more = at < left
        more[more] = bound[more, at[more]] >= floors[more].min(axis=1)
        active = np.flatnonzero(more)
        if not len(active):
            return kept
        place = at[active][:, None] + np.arange(width)
        who, step = np.nonzero(place < left[active][:, None])
        leaf = queue[active[who], place[who, step]]
        who = active[who]
        go = bound[who, at[who] + step] >= floors[who].min(axis=1)
        who, leaf = who[go], leaf[go]
        at[active] += width
        width = min(2 * width, 32)
        if opened is not None:
            opened.append(len(leaf))
        order = np.argsort(leaf, kind="stable")
        who, leaf = who[order], leaf[order]
        cuts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]]))
        found = [[], [], [], []]
        reach, roof = floors.min(axis=1), ceilings.max(axis=1)
        for a, b in zip(cuts[:-1], cuts[1:]):
            mine, span = who[a:b], slice(starts[leaf[a]], starts[leaf[a] + 1])
            score = anchors[mine] @ rows[span].T
            hit = (score >= reach[mine, None]) & (score <= roof[mine, None])
            if same:
                hit &= (row_labels[span] == labels[mine, None]) & (ids[span] != anchor_ids[mine, None])
            else:
                hit &= row_labels[span] != labels[mine, None]
            i, r = np.nonzero(hit)
            if not len(i):
                continue
            value, i, near = score[i, r].astype(np.int64), mine[i], ids[span][r]
            for j in range(windows):
                keep = (value >= floors[i, j]) & (value <= ceilings[i, j])
                for column, part in zip(found, (i[keep], np.full(int(keep.sum()), j), near[keep], value[keep])):
                    column.append(part)
        if not found[0]:
            continue
        anchor, window, near, value = (np.concatenate([old, *new]) for old, new in zip(kept, found))
        order = np.lexsort((near, -value, window, anchor))
        anchor, window, near, value = anchor[order], window[order], near[order], value[order]
        group = anchor * windows + window
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)])
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        last = rank == k - 1
        floors[anchor[last], window[last]] = np.maximum(floors[anchor[last], window[last]], value[last])
        kept = tuple(c[rank < k] for c in (anchor, window, near, value))


def _product_type(size: int, *matrices: np.ndarray):
    """Doubles where they hold all inner products exactly, else 64-bit integers."""
    top = [int(np.abs(m).max()) if m.size else 0 for m in matrices]
    return np.float64 if 2 * size * top[0] * max(top[1:]) < 2**53 else np.int64


def build_trees(rows: DataFrame, tile: int = TILE, leaf: int = LEAF) -> DataFrame:
    """Leaves of the trees over rows of (id, label, v), a tree per range of (label, leading coordinate, id)."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        # A partition is a tile, whose size the number of partitions bounds.
        ids, labels, v = pa.Table.from_batches(parts).combine_chunks().to_batches()[0].columns
        matrix, ids, labels = components_of(v), ids.to_numpy(), labels.to_numpy()
        pages = tile_order(matrix, leaf)
        column = lambda part: [part(r) for r in pages]
        yield pa.RecordBatch.from_pydict(
            {
                "tile": [TaskContext.get().partitionId()] * len(pages),
                "leaf": range(len(pages)),
                "ids": column(lambda r: ids[r]),
                "labels": column(lambda r: labels[r]),
                "v": column(lambda r: matrix[r].ravel()),
                "low": column(lambda r: matrix[r].min(axis=0)),
                "high": column(lambda r: matrix[r].max(axis=0)),
                "label_low": column(lambda r: int(labels[r].min())),
                "label_high": column(lambda r: int(labels[r].max())),
            },
            schema=shape,
        )

    shape = pa.schema(
        [("tile", pa.int32()), ("leaf", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64()))]
        + [(c, pa.list_(pa.int32())) for c in ("v", "low", "high")]
        + [("label_low", pa.int64()), ("label_high", pa.int64())]
    )
    tiles = max(1, -(-rows.count() // tile))
    ranged = rows.withColumn("lead", F.col("v")[0]).repartitionByRange(tiles, "label", "lead", "id")
    return materialise(ranged.select("id", "label", "v").mapInArrow(pack, LEAVES), "leaves")


def _visit(leaves: DataFrame, asks: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
    """(anchor, slot, near, score): the first k rows of each tree in every window of the anchors that visit it.

    `asks` has (id, label, v, block, tile) and `windows`, an array of (slot, low, high) of score bounds; NONE is no lower bound.
    """

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        tree_rows, who = left.combine_chunks(), right.combine_chunks()
        if not tree_rows.num_rows or not who.num_rows:
            return shape.empty_table()
        tree_rows = tree_rows.sort_by("leaf")
        flat = lambda c: c.combine_chunks().flatten().to_numpy()
        ids, labels = flat(tree_rows.column("ids")), flat(tree_rows.column("labels"))
        anchors = components_of(who.column("v").combine_chunks())
        size = anchors.shape[1]
        rows = flat(tree_rows.column("v")).reshape(-1, size)
        kind = _product_type(size, anchors, rows)
        boxes = [components_of(tree_rows.column(c).combine_chunks()).astype(kind) for c in ("low", "high")]
        tree = Tree(*boxes, tree_rows.column("label_low").to_numpy(), tree_rows.column("label_high").to_numpy())
        starts = np.concatenate([[0], np.cumsum([len(x) for x in tree_rows.column("ids")])])
        windows = who.column("windows").to_pylist()
        width = max(len(w) for w in windows)
        floors, ceilings = np.zeros((len(windows), width), np.int64), np.full((len(windows), width), NONE)
        floors += -NONE  # a window that is not there: no score is at its floor
        for i, w in enumerate(windows):
            floors[i, : len(w)] = [x["low"] for x in w]
            ceilings[i, : len(w)] = [x["high"] for x in w]
        anchor_ids = who.column("id").to_numpy()
        at, window, near, score = best_first(
            tree, starts, ids, labels, rows.astype(kind), anchors.astype(kind), anchor_ids, who.column("label").to_numpy(), floors, ceilings, same, k
        )
        slots = np.array([[x["slot"] for x in w] + [0] * (width - len(w)) for w in windows])
        return pa.table([pa.array(anchor_ids[at]), pa.array(slots[at, window].astype(np.int32)), pa.array(near), pa.array(score)], schema=shape)

    shape = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("near", pa.int64()), ("score", pa.int64())])
    spread = leaves.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = spread.groupBy("tile", "block").cogroup(asks.groupBy("tile", "block"))
    return pairs.applyInArrow(search, "anchor bigint, slot int, near bigint, score bigint")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows per anchor and slot with their `rank`."""
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "near"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _search(leaves: DataFrame, asks: DataFrame, blocks: int, same: bool, k: int, name: str) -> DataFrame:
    """The first k rows of each anchor and slot over the trees `first` to `last` of the anchor, in two rounds."""
    trees = F.col("last") - F.col("first") + 1
    early = F.ceil(F.sqrt(trees)).cast("int")
    start = F.pmod(F.xxhash64("id"), trees).cast("int")
    visits = lambda low, high: F.explode(F.sequence(low, high))
    tile = (F.col("first") + F.pmod(start + F.col("turn"), trees)).cast("int")
    columns = ["id", "label", "v", "block", "tile", "windows"]

    once = asks.withColumn("turn", visits(F.lit(0), early - 1)).withColumn("tile", tile).select(columns)
    found = materialise(_first(_visit(leaves, once, blocks, same, k), k), f"{name}-early")
    rest = asks.filter(trees > early)
    if rest.isEmpty():
        return found
    kth = found.filter(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
    raised = F.transform("windows", lambda w: w.withField("low", F.greatest(w["low"], F.coalesce(F.try_element_at("kth", w["slot"]), w["low"]))))
    rest = rest.join(kth, F.col("id") == F.col("anchor"), "left").withColumn("windows", F.when(F.col("kth").isNull(), F.col("windows")).otherwise(raised))
    later = rest.withColumn("turn", visits(early, trees - 1)).withColumn("tile", tile).select(columns)
    both = found.drop("rank").unionByName(_visit(leaves, later, blocks, same, k))
    return materialise(_first(both, k), name)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    window: Sequence[int] = (30, 90),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    tile: int = TILE,
    block: int = ANCHORS,
    leaf: int = LEAF,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row where `anchors`, a condition on `id`, holds.

    Positives are the first rows of the same label by score. Negatives of an anchor and positive are the first rows of other
    labels whose score is between `window` percent of the positive's score.
    """
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("x")
    ).filter("id is not null and label is not null")
    rows = whole_vectors(rows, "x").select("id", "label", quantise(F.col("x"), scale).alias("v"))
    rows = materialise(rows, "quantised")
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        rows = materialise(first_per_key(rows, ["id"], ["label"]), "one-per-id")
    leaves = build_trees(rows, tile, leaf)

    asks = rows.filter(anchors)
    blocks = max(1, -(-asks.count() // block))
    asks = materialise(asks.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")), "anchors")
    last = leaves.agg(F.max("tile")).first()[0] or 0
    of_label = leaves.select("tile", F.explode(F.array_distinct("labels")).alias("_label")).groupBy("_label")
    ranges = materialise(of_label.agg(F.min("tile").alias("first"), F.max("tile").alias("last")), "ranges")

    any_score = F.array(F.struct(F.lit(0).alias("slot"), F.lit(NONE).cast("bigint").alias("low"), F.lit(-NONE).cast("bigint").alias("high")))
    own = asks.join(ranges, F.col("label") == F.col("_label")).drop("_label").withColumn("windows", any_score)
    pairs = _search(leaves, own, blocks, True, positives, "positives")

    low, high = window
    # Whole scores between the two shares of the positive's score: 100 * s from low * p to high * p.
    lowest = F.expr(f"(score * {int(low)} + pmod(-score * {int(low)}, 100)) div 100").alias("low")
    highest = F.expr(f"(score * {int(high)} - pmod(score * {int(high)}, 100)) div 100").alias("high")
    limits = pairs.select("anchor", F.struct(F.col("rank").alias("slot"), lowest, highest).alias("w"))
    windows = limits.filter("w.low <= w.high").groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    wide = asks.join(windows, F.col("id") == F.col("anchor")).drop("anchor").withColumns({"first": F.lit(0), "last": F.lit(int(last))})
    found = _search(leaves, wide, blocks, False, negatives, "negatives")

    told = pairs.select(F.col("anchor"), F.col("rank").alias("slot"), F.col("near").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(told, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"),
        "positive_id",
        "rank",
        F.col("near").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
