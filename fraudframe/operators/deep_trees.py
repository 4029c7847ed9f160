"""Classification trees of full depth for two classes (survey H4, H6): one tree, or a forest of bootstrap samples.

The rules are Spark's (Gini impurity, at most 32 bins a feature, children without a gain or of one class
are leaves, siblings with the same prediction are joined; a forest's nodes try the root of the number of features, rounded up),
but a level of the whole tree is not summed at once: trees of full depth have about as many nodes as rows, and sums for all of them, from every
partition, would be shuffled.  Only nodes of more than SMALL rows are split by jobs over all rows, a level of all trees a job:
tasks sum class weights by (node, candidate, bin), the sums of a tree meet in one task, its splits reach the driver.
The rows of every smaller node then move once, to a task that grows what hangs below it.  Work follows rows x depth x trees.

Rows are binned once and stored in blocks, a byte a feature and row.  Bootstrap weights (Poisson with mean 1) and candidates come from seeded hashes
of the row and of the node's path, so results depend neither on the partitioning nor on lost executors.
Trees are finished in waves, so that only a wave's rows are moved at a time.  What hangs below the first levels is a piece, stored in the shared folder.
Models of up to HELD_NODES nodes are held by the driver, in arrays of 15 bytes a node.  Of larger ones the driver holds
the first levels only: to score, the different rows of codes go past shelves of SHELF_NODES nodes, a task each, and a row's share is the sum over the shelves.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudframe.operators.boost import Tree
from fraudframe.operators.forests import draws
from fraudframe.sources.replay import remove, scratch_dir, stored

BINS = 32
#: Rows (with their weights) of a node that a task grows alone.
SMALL = 1 << 16
#: Sums that a job or a step in a task holds at once.
JOB_CELLS, STEP_CELLS = 8_000_000, 1 << 20
#: Rows that are stored together, rows of a task of the first levels, and weighted rows of a task that finishes nodes.
BLOCK_ROWS, TASK_ROWS, GROW_ROWS = 1 << 15, 1 << 20, 1 << 20
#: Columns of at most about this many different values are binned by all of them, others by so many quantiles of all rows.
FEW_VALUES, QUANTILES, QUANTILE_ERROR = 10_000, 1_000, 1e-4
#: Rows times trees that are finished together.
WAVE_ROWS = 1 << 25
#: Nodes of a row of a saved model.
SAVED_NODES = 1 << 18
#: Nodes of a model that the driver holds, nodes that a task holds to score, and bytes of codes that are sent to shelves at once.
HELD_NODES, SHELF_NODES, SENT_BYTES = 1 << 22, 1 << 22, 1 << 29


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _child(ident: np.ndarray, side: int) -> np.ndarray:
    """Names of nodes by their path."""
    with np.errstate(over="ignore"):
        return _mix(ident * np.uint64(2) + np.uint64(side) + np.uint64(0x9E3779B97F4A7C15))


def root_ident(tree: int, seed: int) -> int:
    return int(_mix(np.array([(seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2 ** 64], np.uint64))[0])


def candidates(ident: np.ndarray, d: int, m: int) -> np.ndarray:
    """The features that each node may split on, in order."""
    if m >= d:
        return np.broadcast_to(np.arange(d), (len(ident), d))
    with np.errstate(over="ignore"):
        rank = _mix(ident[:, None] + (np.arange(1, d + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[None, :])
    return np.sort(np.argpartition(rank, m, axis=1)[:, :m], axis=1)


def thresholds(values: np.ndarray, counts: np.ndarray, splits: int) -> np.ndarray:
    """Spark's cuts of a column with these different values, in order, and numbers of rows."""
    if len(values) <= 1:
        return np.empty(0)
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) <= splits:
        return middle
    stride = counts.sum() / (splits + 1)
    seen, target, out = float(counts[0]), stride, []
    for i in range(1, len(values)):
        before, seen = seen, seen + float(counts[i])
        if abs(before - target) < abs(seen - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def encode(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins (features x rows) of a matrix of rows: the number of cuts below; NaN is in the last bin."""
    return np.array([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], np.uint8).reshape(len(edges), len(x))


def _gini(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    p, q = a / n, b / n
    return 1.0 - p * p - q * q


def best_splits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the class weights (node, candidate, bin, class): candidate (-1 for none), last bin on the left, weights of the left side and of the node.
    The arithmetic is Spark's, step by step, so that ties fall alike: to the lower feature and bin."""
    k, m, width, _ = counts.shape
    whole = counts[:, 0].sum(axis=1)
    left = counts.cumsum(axis=2)[:, :, :-1]
    a0, a1 = left[..., 0], left[..., 1]
    b0, b1 = whole[:, None, None, 0] - a0, whole[:, None, None, 1] - a1
    na, nb, n = a0 + a1, b0 + b1, whole.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _gini(whole[:, 0], whole[:, 1], n)[:, None, None] - na / n[:, None, None] * _gini(a0, a1, na) - nb / n[:, None, None] * _gini(b0, b1, nb)
    gain = np.where((na > 0) & (nb > 0), gain, -np.inf).reshape(k, -1)
    at = gain.argmax(axis=1)
    own = np.arange(k)
    f, b = np.divmod(at, width - 1)
    return np.where(gain[own, at] > 0, f, -1), b, left[own, f, b], whole


@dataclass
class Nodes:
    """Trees in arrays: a leaf has feature -1; the right child comes after the left."""
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    p: np.ndarray       #: share of class 1

    def ends(self, codes: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The leaf of every row, from the root or from a node for each row."""
        rows, at = np.arange(codes.shape[1]), np.zeros(codes.shape[1], np.int64) if start is None else start.astype(np.int64)
        while len(rows):
            f = self.feature.take(at[rows])
            inner = np.flatnonzero(f >= 0)
            rows, f = rows[inner], f[inner]
            node = at[rows]
            at[rows] = self.left.take(node) + (codes[f, rows] > self.bin.take(node))
        return at

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.p.take(self.ends(codes))

    def columns(self) -> list[np.ndarray]:
        return [self.feature, self.bin, self.left, self.p]


def _nodes(columns) -> Nodes:
    return Nodes(*[np.frombuffer(c, t) if isinstance(c, bytes) else np.asarray(c, t) for c, t in zip(columns, (np.int16, np.uint8, np.int32, np.float64))])


def grow_rows(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, root: np.ndarray, ident: np.ndarray, level: np.ndarray, depth: int, m: int) -> Nodes:
    """What hangs below some nodes, from their rows: ``root`` is a row's node, ``ident`` and ``level`` are the nodes' names
    and depths.  The first nodes of the result are the given ones, which have rows."""
    d, k = len(codes), len(ident)
    total = np.stack([np.bincount(root[y == c], weight[y == c], k) for c in (0, 1)], axis=1)
    made, levels = [[np.full(k, -1, np.int16), np.zeros(k, np.uint8), np.zeros(k, np.int32), total]], [np.arange(k)]
    open_nodes = np.flatnonzero((total > 0).all(axis=1) & (level < depth))
    ident, level, size = ident[open_nodes], level[open_nodes], k
    slot = np.full(k, -1)
    slot[open_nodes] = np.arange(len(open_nodes))
    at = slot[root]
    rows = np.flatnonzero(at >= 0)
    at, where = at[rows], [open_nodes]
    while len(ident):
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        n = len(ident)
        feats = candidates(ident, d, m)
        feature, cut, child = np.full(n, -1), np.zeros(n, np.int64), np.zeros((n, 2, 2))
        step = max(1, STEP_CELLS // (feats.shape[1] * BINS * 2))
        bounds = np.searchsorted(at, np.arange(0, n + step, step))
        for i, lo in enumerate(range(0, n, step)):
            part, own = rows[bounds[i]:bounds[i + 1]], at[bounds[i]:bounds[i + 1]] - lo
            some = feats[lo:lo + step]
            label, w, base = y[part].astype(np.int64), weight[part], own * (BINS * 2)
            counts = np.empty((len(some), some.shape[1], BINS, 2))
            for j in range(some.shape[1]):
                cell = base + codes[some[own, j], part].astype(np.int64) * 2 + label
                counts[:, j] = np.bincount(cell, w, len(some) * BINS * 2).reshape(len(some), BINS, 2)
            f, b, left, whole = best_splits(counts)
            here = np.arange(lo, lo + len(some))
            feature[here] = np.where(f >= 0, some[np.arange(len(some)), f], -1)
            cut[here], child[here, 0], child[here, 1] = b, left, whole - left
        split = np.flatnonzero(feature >= 0)
        first = np.zeros(n, np.int64)
        first[split] = size + 2 * np.arange(len(split))
        # the nodes split are in the arrays of the level before
        before, places = made[-1], where[-1]
        before[0][places], before[1][places], before[2][places] = feature, np.where(feature >= 0, cut, 0), first
        if not len(split):
            break
        counts = child[split].reshape(-1, 2)
        made.append([np.full(len(counts), -1, np.int16), np.zeros(len(counts), np.uint8), np.zeros(len(counts), np.int32), counts])
        levels.append(size + np.arange(len(counts)))
        names = np.stack([_child(ident[split], 0), _child(ident[split], 1)], axis=1).ravel()
        deep = np.repeat(level[split] + 1, 2)
        is_open = (counts > 0).all(axis=1) & (deep < depth)
        slot = np.where(is_open, np.cumsum(is_open) - 1, -1)
        keep = np.flatnonzero(feature[at] >= 0)
        rows, at = rows[keep], at[keep]
        goes = slot[first[at] - size + (codes[feature[at], rows] > cut[at])]
        keep = np.flatnonzero(goes >= 0)
        rows, at = rows[keep], goes[keep]
        where.append(np.flatnonzero(is_open))
        ident, level = names[is_open], deep[is_open]
        size += len(counts)
    feature, cut, left, counts = (np.concatenate([c[i] for c in made]) for i in range(4))
    return _pruned(feature, cut, left, counts, levels)


def _pruned(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, counts: np.ndarray, levels: list[np.ndarray]) -> Nodes:
    """Siblings that are leaves with the same prediction are joined, from below."""
    one = counts[:, 1] > counts[:, 0]
    for ids in reversed(levels):
        inner = ids[feature[ids] >= 0]
        a = left[inner]
        same = inner[(feature[a] < 0) & (feature[a + 1] < 0) & (one[a] == one[a + 1])]
        feature[same], cut[same], left[same] = -1, 0, 0
    there = np.zeros(len(feature), bool)
    there[levels[0]] = True
    for ids in levels:
        inner = ids[there[ids] & (feature[ids] >= 0)]
        there[left[inner]] = there[left[inner] + 1] = True
    new = np.cumsum(there) - 1
    left = np.where(feature >= 0, new[left], 0)[there]
    return _nodes([feature[there], cut[there], left, counts[there, 1] / counts[there].sum(axis=1)])


def _arrays(batches):
    """codes, label and hash of all rows of a task."""
    held = [(np.frombuffer(y, np.int8), c, h) for b in batches for c, y, h in zip(*(b.column(i).to_pylist() for i in range(3)))]
    if not held:
        return None
    y = np.concatenate([h[0] for h in held])
    codes = np.concatenate([np.frombuffer(c, np.uint8).reshape(-1, len(own)) for own, c, _ in held], axis=1)
    return codes, y, np.concatenate([np.frombuffer(h, np.int64) for _, _, h in held])


def _counts(work: list, bagged: bool, seed: int):
    """Class weights by (node, candidate, bin) of trees at work: (number, tree, nodes, candidates)."""
    def run(batches):
        found = _arrays(batches)
        if found is None:
            return
        codes, y, keys = found
        n = len(y)
        for item, (number, tree, nodes, feats) in enumerate(work):
            slot = np.full(len(tree.feature), -1)
            slot[nodes] = np.arange(len(nodes))
            at = slot[tree.nodes(codes)]
            weight = draws(keys, number, seed) if bagged else np.ones(n)
            rows = np.flatnonzero((at >= 0) & (weight > 0))
            if not len(rows):
                continue
            at, weight, label = at[rows], weight[rows], y[rows].astype(np.int64)
            total = np.empty((len(nodes), feats.shape[1], BINS, 2))
            for j in range(feats.shape[1]):
                cell = (at * BINS + codes[feats[at, j], rows]) * 2 + label
                total[:, j] = np.bincount(cell, weight, len(nodes) * BINS * 2).reshape(len(nodes), BINS, 2)
            yield pa.RecordBatch.from_arrays([pa.array([item], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["item", "counts"])

    return run


SPLITS = "item int, slot int, candidate int, bin int, weights array<double>"


def _choose(shapes: list):
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for item, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[item] = sums.get(item, 0.0) + np.frombuffer(counts, np.float64)
        for item, total in sums.items():
            f, b, left, whole = best_splits(total.reshape(*shapes[item], BINS, 2))
            n = len(f)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, item), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(f, pa.int32()), pa.array(b, pa.int32()),
                 pa.array(np.concatenate([left, whole - left], axis=1).tolist(), pa.list_(pa.float64()))], [c.split()[0] for c in SPLITS.split(", ")])

    return run


def _rows_of(work: list, bagged: bool, seed: int):
    """The rows of the small nodes of trees at work (number, tree, small nodes), a record for each node."""
    def run(batches):
        found = _arrays(batches)
        if found is None:
            return
        codes, y, keys = found
        for number, tree, nodes in work:
            if not nodes:
                continue
            wanted = np.zeros(len(tree.feature), bool)
            wanted[list(nodes)] = True
            at = tree.nodes(codes)
            weight = draws(keys, number, seed) if bagged else np.ones(len(y))
            rows = np.flatnonzero(wanted[at] & (weight > 0))
            rows = rows[np.argsort(at[rows], kind="stable")]
            if len(rows):
                ids, starts = np.unique(at[rows], return_index=True)
                cuts = np.split(rows, starts[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), number), pa.int32()), pa.array(ids, pa.int32()),
                     *[pa.array([a.tobytes() for a in part], pa.binary()) for part in (
                         [codes[:, c] for c in cuts], [y[c] for c in cuts], [weight[c].astype(np.uint8) for c in cuts])]],
                    ["tree", "node", "codes", "label", "weight"])

    return run


#: A piece: nodes grown together below ``roots`` of a tree, the first of them ``node``; inner nodes in order have their children
#: next to one another in the same order, so only their cuts and the leaves' shares are stored.
PIECE = "tree int, node int, nodes int, roots binary, feature binary, bin binary, p binary"


def _piece(tree: int, roots: np.ndarray, nodes: Nodes) -> pa.RecordBatch:
    inner = nodes.feature >= 0
    return pa.RecordBatch.from_arrays(
        [pa.array([v], pa.int32()) for v in (tree, roots[0], len(inner))] +
        [pa.array([a.tobytes()], pa.binary()) for a in (roots.astype(np.int32), nodes.feature, nodes.bin[inner], nodes.p[~inner])], [c.split()[0] for c in PIECE.split(", ")])


def _of_piece(roots: bytes, feature: bytes, cut: bytes, p: bytes) -> tuple[np.ndarray, Nodes]:
    roots, feature = np.frombuffer(roots, np.int32), np.frombuffer(feature, np.int16)
    inner, n = feature >= 0, len(feature)
    out = Nodes(feature, np.zeros(n, np.uint8), np.zeros(n, np.int32), np.zeros(n))
    out.bin[inner], out.p[~inner] = np.frombuffer(cut, np.uint8), np.frombuffer(p, np.float64)
    out.left[inner] = len(roots) + 2 * np.arange(inner.sum())
    return roots, out


def _finish(small: dict, depth: int, m: int):
    """Grows nodes of one tree together, about SMALL rows at a time."""
    def grown(tree, held):
        nodes = sorted({h[0] for h in held})
        place = {n: i for i, n in enumerate(nodes)}
        parts = [(np.frombuffer(y, np.int8), np.frombuffer(w, np.uint8), c, place[n]) for n, c, y, w in held]
        codes = np.concatenate([np.frombuffer(c, np.uint8).reshape(-1, len(y)) for y, _, c, _ in parts], axis=1)
        y, weight = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        root = np.concatenate([np.full(len(p[0]), p[3]) for p in parts])
        ident, level = np.array([small[tree][n][0] for n in nodes], np.uint64), np.array([small[tree][n][1] for n in nodes])
        return _piece(tree, np.array(nodes), grow_rows(codes, y, weight.astype(np.float64), root, ident, level, depth, m))

    def run(batches):
        held, now, size = [], None, 0
        for batch in batches:
            for tree, node, *rest in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and (tree != now or (size >= SMALL and node != held[-1][0])):
                    yield grown(now, held)
                    held, size = [], 0
                now = tree
                held.append((node, *rest))
                size += len(rest[1])
        if held:
            yield grown(now, held)

    return run


@dataclass
class _Top:
    """The first levels of a tree: the nodes that jobs split and what is known of the others."""
    tree: Tree = field(default_factory=Tree)
    weights: dict = field(default_factory=dict)     #: node -> class weights
    open: dict = field(default_factory=dict)        #: large node -> (name, depth)
    small: dict = field(default_factory=dict)


#: Marks a node of the first levels whose tree goes on in a piece.
GOES_ON = -2


def _first_levels(top: _Top) -> Nodes:
    feature = np.array(top.tree.feature, np.int16)
    feature[list(top.small)] = GOES_ON
    p = [top.weights[i][1] / sum(top.weights[i]) if i in top.weights else 0.0 for i in range(len(feature))]
    return _nodes([feature, top.tree.bin, top.tree.left, p])


def _join(columns: list[np.ndarray], first: np.ndarray) -> None:
    """Siblings of the first levels that are leaves with the same prediction are joined, from below; ``first`` has the features of these levels."""
    feature, cut, left, p = columns
    for i in range(len(first) - 1, -1, -1):
        a = left[i]
        if first[i] >= 0 and feature[a] == -1 and feature[a + 1] == -1 and (p[a] > 0.5) == (p[a + 1] > 0.5):
            feature[i], cut[i], left[i] = -1, 0, 0


def _whole(top: Nodes, parts: list) -> Nodes:
    """The whole tree: first levels and what tasks grew below them."""
    n = len(top.feature)
    feature, cut, left, p = (c.copy() for c in top.columns())
    feature[feature == GOES_ON] = -1
    columns = [[feature, cut, left, p]]
    size = n
    for roots, own in sorted(parts, key=lambda x: x[0][0]):
        k = len(roots)
        moved = np.where(own.feature >= 0, own.left - k + size, 0).astype(np.int32)
        feature[roots], cut[roots], left[roots], p[roots] = own.feature[:k], own.bin[:k], moved[:k], own.p[:k]
        columns.append([own.feature[k:], own.bin[k:], moved[k:], own.p[k:]])
        size += len(own.feature) - k
    _join(columns[0], top.feature)
    feature, cut, left, p = (np.concatenate([c[i] for c in columns]) for i in range(4))
    there, ids = np.zeros(size, bool), np.zeros(1, np.int64)
    while len(ids):
        there[ids] = True
        a = left[ids[feature[ids] >= 0]]
        ids = np.concatenate([a, a + 1])
    return _nodes([feature[there], cut[there], np.where(feature >= 0, (np.cumsum(there) - 1)[left], 0)[there], p[there]])


class DeepTrees:
    """``fit`` on a table with a vector of features and a 0/1 label.  With one tree all rows and features are used."""

    def __init__(self, trees: int, depth: int, seed: int = 0, label: str = "label", features: str = "features", key: str | None = None):
        self.trees, self.depth, self.seed, self.label, self.features, self.key = trees, depth, seed, label, features, key

    def fit(self, df: DataFrame) -> DeepTreesModel:
        spark, bagged = df.sparkSession, self.trees > 1
        rows = df.select(vector_to_array(F.col(self.features)).alias("x"), F.col(self.label).cast("int").alias("y"),
                         *([F.col(self.key).alias("key")] if bagged and self.key else []))
        if bagged:  # rows that repeat a key are drawn on their own
            same = ["key"] if self.key else ["x", "y"]
            number = F.row_number().over(Window.partitionBy(*same).orderBy("x", "y"))
            rows = rows.select("x", "y", F.xxhash64(*same, number).alias("hash"))
        else:
            rows = rows.select("x", "y", F.lit(0).cast("long").alias("hash"))
        path = scratch_dir(spark, "deep-trees")
        rows.write.parquet(f"{path}/rows")
        rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
        n, d, least, most, ones = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.min("y"), F.max("y"), F.sum("y")).first()
        if not n or least < 0 or most != 1:
            raise ValueError(f"classes 0 and 1 expected, got labels {least} to {most} in {n} rows")
        edges = _edges(rows, n, d)
        _blocks(rows, edges).write.parquet(f"{path}/blocks")
        cores = spark.sparkContext.defaultParallelism
        tasks = max(min(cores, -(-n // BLOCK_ROWS)), -(-n // TASK_ROWS))
        blocks = spark.read.schema("codes binary, label binary, hash binary").parquet(f"{path}/blocks").repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            m = d if not bagged else math.ceil(math.sqrt(d))
            tops = self._top(blocks, n, n - ones, d, m)
            at_once = max(1, WAVE_ROWS // n)
            for lo in range(0, self.trees, at_once):
                work = [(t, tops[t].tree, tops[t].small) for t in range(lo, min(self.trees, lo + at_once))]
                spread = max(cores, -(-n * len(work) // GROW_ROWS))
                stored(blocks.mapInArrow(_rows_of(work, bagged, self.seed), "tree int, node int, codes binary, label binary, weight binary")
                       .repartition(spread, "tree", "node").sortWithinPartitions("tree", "node")
                       .mapInArrow(_finish({t: nodes for t, _, nodes in work}, self.depth, m), PIECE), f"{path}/pieces", "append", "zstd")
        finally:
            blocks.unpersist()
        for name in ("rows", "blocks"):
            remove(spark, f"{path}/{name}")
        model = DeepTreesModel([_first_levels(t) for t in tops], edges, self.features, f"{path}/pieces")
        return model.held(spark) if model.size(spark) <= HELD_NODES else model.joined(spark)

    def _top(self, blocks: DataFrame, n: int, zeros: int, d: int, m: int) -> list[_Top]:
        bagged = self.trees > 1
        tops = [_Top() for _ in range(self.trees)]
        for t, top in enumerate(tops):
            place = top.open if n > SMALL and self.depth > 0 else top.small
            place[0] = (root_ident(t, self.seed), 0)
            top.weights[0] = (float(zeros), float(n - zeros))
        for _ in range(self.depth):
            todo, work, cells = [], [], 0
            for t, top in enumerate(tops):
                if top.open:
                    nodes = sorted(top.open)
                    feats = candidates(np.array([top.open[i][0] for i in nodes], np.uint64), d, m)
                    if work and cells + feats.size * BINS * 2 > JOB_CELLS:
                        todo.append(work)
                        work, cells = [], 0
                    work.append((t, top.tree, nodes, np.ascontiguousarray(feats)))
                    cells += feats.size * BINS * 2
            todo += [work] if work else []
            for work in todo:
                opened = [tops[w[0]].open for w in work]
                for w in work:
                    tops[w[0]].open = {}
                found = (blocks.mapInArrow(_counts(work, bagged, self.seed), "item int, counts binary").repartition("item")
                         .mapInArrow(_choose([w[3].shape for w in work]), SPLITS).collect())
                for r in sorted(found, key=lambda r: (r["item"], r["slot"])):
                    t, tree, nodes, feats = work[r["item"]]
                    node, top = nodes[r["slot"]], tops[t]
                    ident, level = opened[r["item"]][node]
                    a0, a1, b0, b1 = r["weights"]
                    top.weights[node] = (a0 + b0, a1 + b1)
                    if r["candidate"] < 0:
                        continue
                    children = tree.split(node, int(feats[r["slot"], r["candidate"]]), r["bin"], True)
                    for side, (child, w) in enumerate(zip(children, ((a0, a1), (b0, b1)))):
                        top.weights[child] = w
                        if min(w) > 0 and level + 1 < self.depth:
                            name = int(_child(np.array([ident], np.uint64), side)[0])
                            (top.open if sum(w) > SMALL else top.small)[child] = (name, level + 1)
        return tops


def _edges(rows: DataFrame, n: int, d: int) -> list[np.ndarray]:
    """Spark's rule for all rows: columns of few different values by the exact counts of these, others by QUANTILES of their quantiles."""
    splits = min(BINS, n) - 1
    x = [F.col("x")[j] for j in range(d)]
    many = [] if n <= FEW_VALUES else [
        j for j, v in enumerate(rows.agg(*[F.approx_count_distinct(c).alias(f"n{j}") for j, c in enumerate(x)]).first()) if v > FEW_VALUES]
    few = [j for j in range(d) if j not in many]
    found: dict[int, tuple] = {}
    if many:
        names = [f"e{j}" for j in many]
        cuts = [i / QUANTILES for i in range(1, QUANTILES + 1)]
        for j, values in zip(many, rows.select(*[x[j].alias(c) for j, c in zip(many, names)]).approxQuantile(names, cuts, QUANTILE_ERROR)):
            found[j] = np.unique(values, return_counts=True)
    if few:
        counted = rows.select(F.posexplode(F.array(*[x[j] for j in few]))).filter(~F.isnan("col")).groupBy("pos", "col").count().orderBy("pos", "col").collect()
        for at, j in enumerate(few):
            own = [r for r in counted if r["pos"] == at]
            found[j] = np.array([r["col"] for r in own], float), np.array([r["count"] for r in own], float)
    return [thresholds(*found[j], splits) for j in range(d)]


def _blocks(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x = part.column(0).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(part), len(edges))
                y, keys = (part.column(i).to_numpy(zero_copy_only=False).astype(t) for i, t in ((1, np.int8), (2, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (encode(x, edges), y, keys)], ["codes", "label", "hash"])

    return rows.mapInArrow(run, "codes binary, label binary, hash binary")


def _shelf(rows: list, tops: list[Nodes], owned: list[int]):
    """Sums of the shares of class 1 over the parts of trees that a task holds: its pieces, and the leaves of the first levels of ``owned`` trees."""
    pieces: dict[int, list] = {}
    for tree, *piece in rows:
        pieces.setdefault(tree, []).append(_of_piece(*piece))
    held = []
    for tree in sorted({*pieces, *owned}):
        start, columns, size = np.full(len(tops[tree].feature), -1), [], 0
        for roots, own in pieces.get(tree, ()):
            start[roots] = size + np.arange(len(roots))
            columns.append([own.feature, own.bin, own.left + np.int32(size), own.p])
            size += len(own.feature)
        pieces[tree] = []
        held.append((tops[tree], tree in owned, start, Nodes(*(np.concatenate([c[i] for c in columns]) for i in range(4))) if columns else None))

    def score(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(codes.shape[1])
        for top, own, start, below in held:
            ends = top.ends(codes)
            if own:
                out += np.where(top.feature.take(ends) == -1, top.p.take(ends), 0.0)
            if below is not None:
                at = np.where(top.feature.take(ends) == GOES_ON, start.take(ends), -1)
                rows = np.flatnonzero(at >= 0)
                out[rows] += below.p.take(below.ends(np.ascontiguousarray(codes[:, rows]), at[rows]))
        return out

    return score


TILE = "shelf int, kind int, tree int, node int, roots binary, feature binary, bin binary, p binary, block binary, codes binary"
SUMS = "block binary, shelf int, sums binary"


def _tile(tops, owned: dict, d: int):
    """The blocks of codes go past the pieces of their shelf."""
    def run(batches):
        now, rows, score = None, [], None
        for batch in batches:
            shelves, kinds, *rest = (batch.column(i) for i in range(10))
            for i, (shelf, kind) in enumerate(zip(shelves.to_pylist(), kinds.to_pylist())):
                if shelf != now:
                    now, rows, score = shelf, [], None
                if kind == 0:
                    rows.append([c[i].as_py() for c in (rest[0], *rest[2:6])])
                    continue
                if score is None:
                    score, rows = _shelf(rows, tops.value, owned.get(shelf, [])), []
                block, codes = rest[6][i].as_py(), rest[7][i].as_py()
                sums = score(np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(-1, d).T))
                yield _sums(block, shelf, sums)

    return run


def _sums(block: bytes, shelf: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array([shelf], pa.int32()), pa.array([sums.tobytes()], pa.binary())], [c.split()[0] for c in SUMS.split(", ")])


def _folded(batches):
    """The sums of a block over its shelves, in their order."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for block, own in groupby(rows, key=lambda r: r[0]):
        total = 0.0
        for _, shelf, sums in own:
            total = total + np.frombuffer(sums, np.float64)
        yield _sums(block, shelf, total)


def _packed(batches):
    """Different codes in blocks, named by their first."""
    for batch in batches:
        codes = batch.column(0).to_pylist()
        for lo in range(0, len(codes), BLOCK_ROWS):
            part = codes[lo:lo + BLOCK_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([part[0]], pa.binary()), pa.array([b"".join(part)], pa.binary())], ["block", "codes"])


@dataclass
class DeepTreesModel:
    """``trees`` are whole, or the first levels of trees that go on in ``pieces``, a folder."""
    trees: list[Nodes]
    edges: list[np.ndarray]
    features: str = "features"
    pieces: str | None = None

    def _stored(self, spark) -> DataFrame:
        return spark.read.schema(PIECE).parquet(self.pieces)

    def size(self, spark) -> int:
        return sum(len(t.feature) for t in self.trees) + (self._stored(spark).agg(F.sum("nodes")).first()[0] or 0)

    def held(self, spark) -> DeepTreesModel:
        """The same model without a folder."""
        parts: list[list] = [[] for _ in self.trees]
        for r in self._stored(spark).collect():
            parts[r["tree"]].append(_of_piece(*(bytes(r[c]) for c in ("roots", "feature", "bin", "p"))))
        return DeepTreesModel([_whole(t, p) for t, p in zip(self.trees, parts)], self.edges, self.features)

    def joined(self, spark) -> DeepTreesModel:
        """Pieces' roots that are leaves become leaves of the first levels."""
        def roots(batches):
            for batch in batches:
                for tree, own, feature, p in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tree", "roots", "feature", "p"))):
                    own = np.frombuffer(own, np.int32)
                    leaf, share = np.frombuffer(feature, np.int16)[:len(own)] < 0, np.zeros(len(own))
                    share[leaf] = np.frombuffer(p, np.float64)[:leaf.sum()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), tree), pa.int32()), pa.array(own), pa.array(leaf), pa.array(share)], ["tree", "node", "leaf", "p"])

        trees = [Nodes(*(c.copy() for c in t.columns())) for t in self.trees]
        for t in trees:
            t.feature[t.feature == GOES_ON] = -1
        for r in self._stored(spark).mapInArrow(roots, "tree int, node int, leaf boolean, p double").collect():
            own, node = trees[r["tree"]], r["node"]
            if r["leaf"]:
                own.p[node] = r["p"]
            else:
                own.feature[node] = GOES_ON
        for t, before in zip(trees, self.trees):
            _join(t.columns(), before.feature)
        return DeepTreesModel(trees, self.edges, self.features, self.pieces)

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Mean share of class 1 in the leaves of a matrix of rows."""
        if self.pieces:
            raise ValueError("the trees are stored; use transform")
        codes = encode(x, self.edges)
        return sum((t.scores(codes) for t in self.trees), np.zeros(len(x))) / len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        p1 = F.col("__share")
        if self.pieces:
            edges = self.edges

            @F.pandas_udf("binary")
            def coded(x: pd.Series) -> pd.Series:
                return pd.Series([c.tobytes() for c in encode(np.stack(x.to_numpy()), edges).T] if len(x) else [], dtype=object)

            rows = df.withColumn("__codes", coded(vector_to_array(F.col(self.features))))
            scored = rows.join(self._shares(rows.select("__codes").distinct()), "__codes").drop("__codes")
        else:
            model = df.sparkSession.sparkContext.broadcast(self)

            @F.pandas_udf("double")
            def share(x: pd.Series) -> pd.Series:
                return pd.Series(model.value.shares(np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype=float)

            scored = df.withColumn("__share", share(vector_to_array(F.col(self.features))))
        return (scored.withColumn("prediction", (p1 > 0.5).cast("double"))
                .withColumn("probability", array_to_vector(F.array(1.0 - p1, p1))).drop("__share"))

    def _shares(self, codes: DataFrame) -> DataFrame:
        """(__codes, __share) of different rows of codes, whose blocks are sent to the shelves in waves."""
        spark, d, folder = codes.sparkSession, len(self.edges), scratch_dir(codes.sparkSession, "deep-trees-scores")
        blocks = stored(codes.mapInArrow(_packed, "block binary, codes binary"), f"{folder}/blocks")
        sent = (blocks.agg(F.sum(F.length("codes"))).first()[0] or 0) * (d + 8) // d      # with their sums
        sizes = sorted(self._stored(spark).select("tree", "node", "nodes").collect())
        at, shelf, room = [], 0, SHELF_NODES
        for tree, node, nodes in sizes:
            if room < nodes and room < SHELF_NODES:
                shelf, room = shelf + 1, SHELF_NODES
            at.append((tree, node, shelf))
            room -= nodes
        first = {}
        for tree, _, s in at:
            first.setdefault(tree, s)
        owned: dict[int, list] = {}
        for tree in range(len(self.trees)):
            owned.setdefault(first.get(tree, 0), []).append(tree)
        tops = spark.sparkContext.broadcast(self.trees)
        cores = spark.sparkContext.defaultParallelism
        wave = max(cores, SENT_BYTES // max(1, sent))
        empty = lambda kind: F.lit(None).cast(kind)
        for lo in range(0, shelf + 1, wave):
            hi = min(shelf + 1, lo + wave)
            chosen = spark.createDataFrame([a for a in at if lo <= a[2] < hi], "tree int, node int, shelf int")
            pieces = self._stored(spark).join(F.broadcast(chosen), ["tree", "node"]).select(
                "shelf", F.lit(0).alias("kind"), "tree", "node", "roots", "feature", "bin", "p", empty("binary").alias("block"), empty("binary").alias("codes"))
            rows = blocks.withColumn("shelf", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))).select(
                "shelf", F.lit(1).alias("kind"), empty("int").alias("tree"), empty("int").alias("node"),
                *[empty("binary").alias(c) for c in ("roots", "feature", "bin", "p")], "block", "codes")
            sums = (pieces.unionByName(rows).repartitionById(hi - lo, F.col("shelf") - F.lit(lo)).sortWithinPartitions("shelf", "kind", "tree", "node")
                    .mapInArrow(_tile(tops, {s: t for s, t in owned.items() if lo <= s < hi}, d), SUMS))
            stored(sums.repartition("block").sortWithinPartitions("block", "shelf").mapInArrow(_folded, SUMS), f"{folder}/sums", "append")
        trees = len(self.trees)

        def shares(batches):
            for batch in batches:
                for codes, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array([codes[i:i + d] for i in range(0, len(codes), d)], pa.binary()), pa.array(np.frombuffer(sums, np.float64) / trees)],
                                                     ["__codes", "__share"])

        sums = spark.read.schema(SUMS).parquet(f"{folder}/sums").repartition("block").sortWithinPartitions("block", "shelf").mapInArrow(_folded, SUMS)
        out = stored(sums.join(blocks, "block").select("codes", "sums").mapInArrow(shares, "__codes binary, __share double"), f"{folder}/shares")
        for name in ("blocks", "sums"):
            remove(spark, f"{folder}/{name}")
        return out

    def save(self, spark, path: str) -> None:
        rows = [(t, lo, *[bytearray(c[lo:lo + SAVED_NODES].tobytes()) for c in tree.columns()])
                for t, tree in enumerate(self.trees) for lo in range(0, len(tree.feature), SAVED_NODES)]
        spark.createDataFrame(rows, "tree int, start long, feature binary, bin binary, left binary, p binary").write.mode("overwrite").parquet(path if self.pieces is None else f"{path}/first")
        if self.pieces is not None:
            self._stored(spark).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/pieces")

    @staticmethod
    def load(spark, path: str, edges: list, features: str, pieces: bool = False) -> DeepTreesModel:
        held: dict[int, list] = {}
        for r in sorted(spark.read.parquet(f"{path}/first" if pieces else path).collect(), key=lambda r: (r["tree"], r["start"])):
            held.setdefault(r["tree"], []).append([bytes(r[c]) for c in ("feature", "bin", "left", "p")])
        return DeepTreesModel([_nodes([b"".join(c) for c in zip(*held[t])]) for t in sorted(held)], [np.array(e, float) for e in edges], features,
                              f"{path}/pieces" if pieces else None)
