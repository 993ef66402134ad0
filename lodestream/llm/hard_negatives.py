"""Hard negatives by dual-tree search: trees over anchors and candidates, whole node pairs dropped by their inner products' interval.

Candidates lie in cells of a tree of hyperplanes, each cell in blocks of bounded size; anchors lie in groups of the same
cells. A node of either side knows the box and the ball around its vectors, and for two nodes these bound every inner
product from both sides. A group first visits its own cell, which shows how good a partner must be; then it descends the
tree of cells together with its own tree and visits only cells whose interval reaches a score still wanted. Inside a
block both trees go on down to leaf pairs, best bound first, and leaf pairs are scored exactly. The first search looks
for the anchor's positives (same label), the second for rows of other labels that score within a window below a positive.

The hyperplanes are fitted on a sample of SAMPLE rows (those of the smallest hash), which only shapes the cells: every row is
placed and every partner found. Boxes of cells, CELLS at most for each dimension, are known to all tasks; groups meet
blocks, the anchors of a block being a group, by a join on the block.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component, and
empty vectors, take no part; of rows that repeat a vec_id the smallest (label, vector) stands; vectors of different
dimension never meet; ties go to the smaller vec_id; an anchor without positives, and a positive without negatives, have no row; an empty table
gives an empty result; only vec_id, label and embedding are read. Components are integers; scores are exact while they stay below 2^53.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SAMPLE, CELLS, BLOCK_ROWS = 8192, 1024, 4096
LEAF, ANCHOR_LEAF = 128, 16
HIT = "anchor_id long, want long, vec_id long, score long"


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Direction between two far points of ``x``, and the places of all points along it."""
    p = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    way = x[((x - p) ** 2).sum(1).argmax()] - p
    return way, x @ way


class Tree:
    """Balanced tree over vectors, or over boxes; node i holds items order[start[i]:end[i]]."""

    def __init__(self, low: np.ndarray, high: np.ndarray, leaf: int) -> None:
        self.order, self.leaf = np.arange(len(low)), leaf
        self.start, self.end, self.down, ball, box = [], [], [], [], []
        mid = (low + high) / 2

        def make(s: int, e: int) -> int:
            at, me = self.order[s:e], len(self.start)
            self.start.append(s)
            self.end.append(e)
            self.down.append(())
            box.append((low[at].min(0), high[at].max(0)))
            center = mid[at].mean(0)
            ball.append((center, np.sqrt((np.maximum(high[at] - center, center - low[at]) ** 2).sum(1).max())))
            if e - s > leaf:
                k = (e - s) // 2
                self.order[s:e] = at[np.argpartition(halves(mid[at])[1], k)]
                self.down[me] = (make(s, s + k), make(s + k, e))
            return me

        make(0, len(low))
        self.low, self.high = (np.array(x) for x in zip(*box, strict=True))
        self.center, self.radius = (np.array(x) for x in zip(*ball, strict=True))
        self.norm = np.sqrt((self.center**2).sum(1))

    def items(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.end[node]]


def interval(a: Tree, i: int, b: Tree, j: int) -> tuple[float, float]:
    """Bounds of the inner products of all vectors below node i of ``a`` with all below node j of ``b``."""
    corners = np.array([a.low[i] * b.low[j], a.low[i] * b.high[j], a.high[i] * b.low[j], a.high[i] * b.high[j]])
    middle = a.center[i] @ b.center[j]
    reach = a.norm[i] * b.radius[j] + b.norm[j] * a.radius[i] + a.radius[i] * b.radius[j]
    slack = 1e-6 + 1e-9 * (abs(middle) + reach)
    return max(corners.min(0).sum(), middle - reach) - slack, min(corners.max(0).sum(), middle + reach) + slack


def leaf_pairs(a: Tree, b: Tree, wanted: Callable[[int, int, float, float], bool]) -> Iterator[tuple[int, int]]:
    """Pairs of leaves that ``wanted`` (nodes and the interval of their products) lets through, highest bound first; it is asked again when a pair's turn comes."""
    low, high = interval(a, 0, b, 0)
    heap = [(-high, 0, 0, low)]
    while heap:
        high, i, j, low = heapq.heappop(heap)
        if not wanted(i, j, low, -high):
            continue
        if not a.down[i] and not b.down[j]:
            yield i, j
        elif b.down[j] and (not a.down[i] or b.radius[j] >= a.radius[i]):
            for k in b.down[j]:
                low, high = interval(a, i, b, k)
                heapq.heappush(heap, (-high, i, k, low))
        else:
            for k in a.down[i]:
                low, high = interval(a, k, b, j)
                heapq.heappush(heap, (-high, k, j, low))


def first_of_each(of: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each ``of``: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, of))
    at = of[order]
    new = np.r_[True, at[1:] != at[:-1]][: len(at)]
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return order[place < k]


def matrix(vectors: pa.Array, n: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


class Group:
    """Anchors of one cell with what each wants: partners whose score lies in [least, most], and not below those already ``seen``."""

    def __init__(self, members: pa.StructArray, low: int, high: int) -> None:
        get = lambda name: members.field(name).to_numpy(zero_copy_only=False)
        self.anchor, self.want, self.label = get("anchor_id"), get("want"), get("label")
        bound = members.field("bound")
        self.open = bound.null_count > 0
        ps = bound.fill_null(0).to_numpy(zero_copy_only=False)
        self.least = np.full(len(ps), -np.inf) if self.open else (-(-low * ps // 100)).astype(float)
        self.most = np.full(len(ps), np.inf) if self.open else (high * ps // 100).astype(float)
        self.least = np.maximum(self.least, members.field("seen").fill_null(-np.inf).to_numpy(zero_copy_only=False))
        _, at, self.vector_of = np.unique(self.anchor, return_index=True, return_inverse=True)
        self.vectors = matrix(members.field("v"), len(ps))[at]
        self.tree = Tree(self.vectors, self.vectors, ANCHOR_LEAF)
        self.under = [np.flatnonzero(np.isin(self.vector_of, self.tree.items(i))) for i in range(len(self.tree.start))]

    def reached(self, node: int, low: float, high: float) -> bool:
        mine = self.under[node]
        return bool(((high >= self.least[mine]) & (low <= self.most[mine])).any())

    def search(self, tree: Tree, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """(member, score, id) of each member's first ``k`` partners in a block."""
        of, score, found = np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64)
        for i, j in leaf_pairs(self.tree, tree, lambda i, j, low, high: self.reached(i, low, high)):
            mine, theirs = self.under[i], tree.items(j)
            s = self.vectors[self.vector_of[mine]] @ vectors[theirs].T
            fits = (s >= self.least[mine, None]) & (s <= self.most[mine, None]) & ((labels[theirs] == self.label[mine, None]) == same) & (ids[theirs] != self.anchor[mine, None])
            m, c = np.nonzero(fits)
            if len(m):
                of, score, found = np.r_[of, mine[m]], np.r_[score, s[m, c]], np.r_[found, ids[theirs[c]]]
                keep = first_of_each(of, score, found, k)
                of, score, found = of[keep], score[keep], found[keep]
                full = np.flatnonzero(np.bincount(of, minlength=len(self.least)) == k)
                worst = np.full(len(self.least), np.inf)
                np.minimum.at(worst, of, score)
                self.least[full] = np.maximum(self.least[full], worst[full])
        return of, score, found


def split_planes(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and thresholds of a full tree of hyperplanes in heap order, each at the median of what reaches it."""
    way, at = np.zeros((2**depth - 1, x.shape[1])), np.zeros(2**depth - 1)
    held = {0: x}
    for i in range(2**depth - 1):
        part = held.pop(i)
        if len(part) > 1:
            way[i], place = halves(part)
            at[i] = np.median(place)
            held[2 * i + 1], held[2 * i + 2] = part[place <= at[i]], part[place > at[i]]
        else:
            held[2 * i + 1], held[2 * i + 2] = part, part[:0]
    return way, at


def _placing(planes: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Adds the cell of each row: its dimension and its leaf among the hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            size, cell = v.value_lengths().to_numpy(), np.zeros(b.num_rows, np.int64)
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                if dim and dim in planes:
                    way, at = planes[dim]
                    x, node = matrix(v.take(pa.array(rows)), len(rows)), np.zeros(len(rows), int)
                    while len(way) and node[0] < len(way):
                        node = 2 * node + 1 + (np.einsum("ij,ij->i", x, way[node]) > at[node])
                    cell[rows] = node - len(way)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int64) * CELLS + cell)], [*b.schema.names, "cell"])

    return run


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Box and labels of each block; a block is a row."""
    for b in batches:
        rows = []
        for cell, members in zip(b.column("cell").to_pylist(), b.column("members"), strict=True):
            x, labels = matrix(members.values.field("v"), len(members)), members.values.field("label").to_numpy()
            rows.append({"cell": cell, "low": x.min(0).tolist(), "high": x.max(0).tolist(), "label_low": int(labels.min()), "label_high": int(labels.max())})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("cell", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("label_low", pa.int64()), ("label_high", pa.int64())]))


def _visits(cells: dict[int, tuple], same: bool, low: int, high: int):
    """For each group the cells that its tree and the tree of cells could not rule out. ``cells``: by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {dim: (Tree(c[1], c[2], 1), *c) for dim, c in cells.items()}
        for b in batches:
            out = []
            for home, members in zip(b.column("home").to_pylist(), b.column("members"), strict=True):
                group = Group(members.values, low, high)
                tree, ids, _, _, first, last = trees[(home >> 32) // CELLS]

                def wanted(i: int, j: int, lo: float, hi: float, g=group, t=tree, first=first, last=last) -> bool:
                    if not g.reached(i, lo, hi):
                        return False
                    at, labels = t.items(j), g.label[g.under[i]]
                    if same:
                        return bool(((labels >= first[at].min()) & (labels <= last[at].max())).any())
                    return first[at].min() != last[at].max() or bool((labels != first[at].min()).any())

                out.append(sorted({int(ids[tree.items(j)[0]]) for _, j in leaf_pairs(group.tree, tree, wanted)}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], [*b.schema.names, "cells"])

    return run


def _scored(k: int, same: bool, low: int, high: int, again: bool):
    """First ``k`` partners of each member of a group in a block; a row holds a group and a block. ``again``: groups have been in their own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            for block, home, theirs, members in zip(b.column("block").to_pylist(), b.column("home").to_pylist(), b.column("theirs"), b.column("members"), strict=True):
                if again and block == home:
                    continue
                if block != last:  # rows of a block follow each other: its tree is built once
                    ids, labels = (theirs.values.field(c).to_numpy() for c in ("vec_id", "label"))
                    vectors = matrix(theirs.values.field("v"), len(ids))
                    last, held = block, (Tree(vectors, vectors, LEAF), ids, labels, vectors)
                group = Group(members.values, low, high)
                of, score, found = group.search(*held, k, same)
                yield pa.RecordBatch.from_arrays([pa.array(group.anchor[of]), pa.array(group.want[of]), pa.array(found), pa.array(score.astype(np.int64))], ["anchor_id", "want", "vec_id", "score"])

    return run


def first_k(hits: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("anchor_id", "want").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def nearest(demands: DataFrame, blocks: DataFrame, counts: DataFrame, cells: dict[int, tuple], k: int, same: bool, low: int, high: int) -> DataFrame:
    """anchor_id, want, vec_id, score and rank of the first ``k`` partners of each demand (anchor_id, want, label, bound, home, v)."""

    def groups(rows: DataFrame) -> DataFrame:
        """The anchors of a block are a group."""
        return rows.groupBy("home").agg(F.collect_list(F.struct("anchor_id", "want", "label", "bound", "seen", "v")).alias("members"))

    def visit(visits: DataFrame, again: bool) -> DataFrame:
        return written(visits.join(blocks, "block").select("block", "home", "theirs", "members").mapInArrow(_scored(k, same, low, high, again), HIT))

    at_home = visit(groups(demands.withColumn("seen", F.lit(None).cast("double"))).withColumn("block", F.col("home")), False)
    seen = first_k(at_home, k).where(F.col("rank") == k).select("anchor_id", "want", F.col("score").cast("double").alias("seen"))
    told = groups(demands.join(seen, ["anchor_id", "want"], "left"))
    kind = told.schema["members"].dataType.simpleString()
    reached = told.mapInArrow(_visits(cells, same, low, high), f"home long, members {kind}, cells array<long>").select("home", "members", F.explode("cells").alias("cell"))
    reached = reached.join(F.broadcast(counts), "cell").select("home", "members", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cell")
    return first_k(at_home.unionByName(visit(reached.select("home", "members", block_of("cell", "part")), True)), k)


def block_of(cell: str, part: str) -> Column:
    return (F.col(cell) * F.lit(2**32) + F.col(part)).alias("block")


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Negatives of each anchor and positive: rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score.

    ``vectors``: vec_id, label and embedding with integer components; ``anchors``: a condition on vec_id.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    base = base.where(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite, F.lit(False)))
    n, different, most = base.agg(F.count("*"), F.count_distinct("vec_id"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if different < n:
        base = base.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    if (most or 0) < 2**24:
        base = base.withColumn("v", F.col("v").cast("array<float>"))
    kind = dict(base.dtypes)["v"]
    # a bounded sample shapes the cells
    sample = base.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    depth = min(max(0, (max(1, n) // BLOCK_ROWS).bit_length()), CELLS.bit_length() - 1)
    planes = {}
    for dim in {len(r.v) for r in sample} - {0}:
        x = np.array([r.v for r in sample if len(r.v) == dim], float)
        planes[dim] = split_planes(x, min(depth, (len(x) // 4).bit_length()))
    placed = written(base.mapInArrow(_placing(planes), f"vec_id long, label long, v {kind}, cell long"))

    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))  # a row a cell: their number is bounded
    placed = placed.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).select("vec_id", "label", "v", "cell", block_of("cell", "part"))
    blocks = written(placed.groupBy("cell", "block").agg(F.collect_list(F.struct("vec_id", "label", "v")).alias("members")))
    boxes = blocks.mapInArrow(_boxes, "cell long, low array<double>, high array<double>, label_low long, label_high long")
    side = boxes.select("cell", "label_low", "label_high", F.posexplode(F.arrays_zip("low", "high")).alias("d", "x"))
    side = side.groupBy("cell", "d").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"))
    found = side.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("d", "low", "high"))).alias("x"), F.min("label_low").alias("first"), F.max("label_high").alias("last")).collect()  # CELLS at most a dimension
    cells = {}
    for dim in {r.cell // CELLS for r in found}:
        mine_ = [r for r in found if r.cell // CELLS == dim]
        cells[dim] = (np.array([r.cell for r in mine_]), np.array([[d.low for d in r.x] for r in mine_]), np.array([[d.high for d in r.x] for r in mine_]), np.array([r.first for r in mine_]), np.array([r.last for r in mine_]))

    blocks = blocks.select("block", F.col("members").alias("theirs"))
    chosen = placed.where(anchors).select(F.col("vec_id").alias("anchor_id"), "label", F.col("block").alias("home"), "v")
    open_ = chosen.select("anchor_id", F.col("anchor_id").alias("want"), "label", F.lit(None).cast("long").alias("bound"), "home", "v")
    best = written(nearest(open_, blocks, counts, cells, positives, True, low, high).select("anchor_id", F.col("vec_id").alias("want"), F.col("score").alias("bound")))
    windows = best.join(chosen, "anchor_id").select("anchor_id", "want", "label", "bound", "home", "v")
    got = nearest(windows, blocks, counts, cells, negatives, False, low, high)
    return got.join(best, ["anchor_id", "want"]).select("anchor_id", F.col("want").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("bound").alias("positive_score"), F.col("score").alias("negative_score"))
