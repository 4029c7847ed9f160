"""Random forests of many training sets, grown in the same jobs (survey G1).

Rows are binned once and stored in blocks: a byte a feature and row, label, fold and a hash of the
key.  A ``Fit`` is a forest on the rows outside one fold (or on all rows) that may use some of the
features.  All fits grow together, a level of all their trees a job: tasks sum the weight of each
class by (node, candidate feature, bin), the sums of one tree meet in one task, and that
task chooses the tree's splits; only the splits reach the driver.  Jobs therefore follow the
depth, not the number of fits; a job whose tasks would hold more than CELLS sums is cut.

Bootstrap weights (Poisson with mean 1) and the candidate features of a node (the root of their
number, rounded up) come from seeded hashes of the row's key, the tree and the node, so results
don't depend on the partitioning and survive lost executors.  A split is the largest drop of Gini
impurity, ties to the lower feature and bin; missing values (NaN) lie below all others.  Labels are 0 and 1.
A fit without training rows predicts 0.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudframe.operators.boost import Tree, _edges, encode_bins
from fraudframe.sources.replay import scratch_dir

BINS, CELLS = 32, 8_000_000
#: Rows of a block, and blocks of a task (a million rows) where there are more than the session has cores.
BLOCK_ROWS, TASK_BLOCKS = 1 << 11, 512
#: Rows that are counted together.
PIECE = 1 << 14
ALL_ROWS = -1
WIDTH = BINS + 1
#: Chance of at most 0, 1, 2, ... draws of a row in a bootstrap sample.
_DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


@dataclass
class Fit:
    kept: list[int]
    fold: int = ALL_ROWS        #: rows of this fold are left out
    trees: list[Tree] = field(default_factory=list)
    importances: np.ndarray | None = None


def draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Times that each row is in a tree's sample."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_DRAWS, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0 ** 53, side="right")


def candidates(fit: Fit, tree: int, node: int, trees: int, seed: int) -> list[int]:
    """Features that a node may split on."""
    m = len(fit.kept) if trees == 1 else math.ceil(math.sqrt(len(fit.kept)))
    rng = np.random.default_rng([seed, fit.fold + 1, len(fit.kept), tree, node])
    return sorted(int(f) for f in rng.choice(fit.kept, m, replace=False))


def blocks_of(df: DataFrame, key: str, label: str, features: str, folds: int, seed: int) -> tuple[DataFrame, int]:
    """Blocks (codes, label, fold, hash) and the number of features.  Rows without a label are left out.
    The blocks are stored, spread over tasks of a bounded number and kept; the caller gives them back."""
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")
    rows = df.filter(F.col(label).isNotNull()).select(
        vector_to_array(features).alias("x"), F.col(label).cast("byte").alias("y"), fold.alias("fold"), F.xxhash64(F.col(key)).alias("hash"))
    d = rows.select(F.max(F.size("x"))).first()[0] or 0
    edges = _edges(rows, d, BINS) if d else []

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x = part.column(0).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(part), d)
                rest = [part.column(i).to_numpy(zero_copy_only=False).astype(t) for i, t in ((1, np.int8), (2, np.int32), (3, np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]) for a in (encode_bins(x, edges), *rest)], ["codes", "label", "fold", "hash"])

    path = scratch_dir(df.sparkSession, "forests")
    rows.mapInArrow(run, "codes binary, label binary, fold binary, hash binary").write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    n = stored.count()
    tasks = max(1, min(n, df.sparkSession.sparkContext.defaultParallelism), n // TASK_BLOCKS)
    return stored.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK), d


def _arrays(batches):
    for batch in batches:
        for codes, label, fold, keys in zip(*(batch.column(i).to_pylist() for i in range(4))):
            y = np.frombuffer(label, np.int8)
            yield np.frombuffer(codes, np.uint8).reshape(-1, len(y)), y, np.frombuffer(fold, np.int32), np.frombuffer(keys, np.int64)


def _add(total: np.ndarray, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, tree: Tree, nodes: list, features: np.ndarray) -> None:
    """Adds the weights by (node, candidate, bin, class); rows in other nodes go to a slot of their own, the last."""
    slot = np.full(len(tree.feature), len(nodes))
    slot[nodes] = np.arange(len(nodes))
    at = slot.take(tree.nodes(codes))
    n, m = codes.shape[1], features.shape[1]
    flat, rows, size = codes.ravel(), np.arange(n), total.size
    for j in range(m):
        start = np.r_[features[:, j], 0] * n
        cell = ((at * m + j) * WIDTH + flat.take(start.take(at) + rows)) * 2 + y
        total += np.bincount(cell, weight, size + m * WIDTH * 2)[:size]


def _counts(work: list, seed: int):
    """Class weights by (node, candidate, bin) of every tree at work: (fold, number, tree, nodes, candidates).

    Trees that use few features see few different rows: where a task has at least twice as many rows as
    there can be (bins, label), each of these is counted once, with its rows' weights added up."""
    shapes = [np.array(w[4]) for w in work]

    def run(batches):
        sums = [np.zeros(f.size * WIDTH * 2) for f in shapes]
        held = list(_arrays(batches))
        if not held:
            return
        codes, y, fold, keys = (np.concatenate([h[i] for h in held], axis=-1) for i in range(4))
        by_fold: dict[int, list[int]] = {}
        for item, w in enumerate(work):
            by_fold.setdefault(w[0], []).append(item)
        merged, single = {}, []
        for left_out, items in by_fold.items():
            used = sorted({f for i in items for f in (*work[i][2].feature, *shapes[i].ravel().tolist()) if f >= 0})
            rows = np.flatnonzero(fold != left_out)
            size = 2 * WIDTH ** len(used)
            if 2 * size > len(rows):
                single.append(left_out)
                continue
            cell = y[rows].astype(np.int64)
            for f in used:
                cell = cell * WIDTH + codes[f, rows]
            there = np.flatnonzero(np.bincount(cell, minlength=size))
            place = np.zeros(size, np.int64)
            place[there] = np.arange(len(there))
            own, rest = np.zeros((len(codes), len(there)), np.uint8), there
            for f in reversed(used):
                rest, own[f] = np.divmod(rest, WIDTH)
            merged[left_out] = rows, place[cell], own, rest
        if merged:
            for number in sorted({w[1] for w in work}):
                drawn = draws(keys, number, seed)
                for left_out, (rows, place, own, label) in merged.items():
                    mine = [i for i in by_fold[left_out] if work[i][1] == number]
                    if mine:
                        weight = np.bincount(place, drawn[rows], own.shape[1])
                        for i in mine:
                            _add(sums[i], own, label, weight, *work[i][2:4], shapes[i])
        for lo in range(0, len(y) if single else 0, PIECE):
            weights: dict[int, np.ndarray] = {}
            part = slice(lo, lo + PIECE)
            for left_out in single:
                rows = lo + np.flatnonzero(fold[part] != left_out)
                own, label = codes[:, rows], y[rows]
                for i in by_fold[left_out]:
                    number = work[i][1]
                    if number not in weights:
                        weights[number] = draws(keys[part], number, seed).astype(np.float64)
                    _add(sums[i], own, label, weights[number][rows - lo], *work[i][2:4], shapes[i])
        for item, total in enumerate(sums):
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array([item], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["item", "counts"])

    return run


SPLITS = "item int, slot int, candidate int, bin int, gain double, zeros array<double>, ones array<double>"


def best_split(counts: np.ndarray) -> tuple[int, int, float, list, list]:
    """Of a node's (candidate, bin, class) weights: candidate (-1 for none), last bin on the left, drop of
    impurity times weight, and the weights of class 0 and of class 1 in the node, left and right."""
    whole = counts[0].sum(axis=0)
    left = counts.cumsum(axis=1)[:, :-1]
    right = whole - left

    def impurity(c):
        n = c.sum(axis=-1)
        return n - (c ** 2).sum(axis=-1) / np.where(n > 0, n, 1)

    gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), impurity(whole) - impurity(left) - impurity(right), 0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[f, b] <= 1e-9:
        return -1, 0, 0.0, [whole[0]], [whole[1]]
    return int(f), int(b), float(gain[f, b]), [whole[0], left[f, b, 0], right[f, b, 0]], [whole[1], left[f, b, 1], right[f, b, 1]]


def _choose(shapes: list):
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for item, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[item] = sums.get(item, 0.0) + np.frombuffer(counts, np.float64)
        rows = [(item, slot, *best_split(node)) for item, total in sums.items()
                for slot, node in enumerate(total.reshape(*shapes[item], WIDTH, 2)) if node.any()]
        names = [f.split()[0] for f in SPLITS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    return run


def _level(blocks: DataFrame, work: list, seed: int) -> list:
    """The splits of the nodes at work, in one job."""
    shapes = [np.array(w[4]).shape for w in work]
    return blocks.mapInArrow(_counts(work, seed), "item int, counts binary").repartition("item").mapInArrow(_choose(shapes), SPLITS).collect()


def grow(blocks: DataFrame, fits: list[Fit], trees: int, depth: int, seed: int) -> None:
    """Grows every fit's forest and takes its importances: drops of impurity by feature, each tree's summing to 1."""
    d = 1 + max(f for fit in fits for f in fit.kept)
    gains = {(i, t): np.zeros(d) for i in range(len(fits)) for t in range(trees)}
    for fit in fits:
        fit.trees = [Tree() for _ in range(trees)]
    open_nodes = {k: [0] for k in gains}
    for _ in range(depth):
        work, cells, todo = [], 0, []
        for (i, t), nodes in open_nodes.items():
            if nodes:
                chosen = [candidates(fits[i], t, n, trees, seed) for n in nodes]
                size = len(nodes) * len(chosen[0]) * WIDTH * 2
                if work and cells + size > CELLS:
                    todo.append(work)
                    work, cells = [], 0
                work.append(((i, t), (fits[i].fold, t, fits[i].trees[t], nodes, chosen)))
                cells += size
        todo += [work] if work else []
        open_nodes = {k: [] for k in gains}
        for work in todo:
            for r in sorted(_level(blocks, [w for _, w in work], seed), key=lambda r: (r["item"], r["slot"])):
                place, (_, _, tree, nodes, chosen) = work[r["item"]]
                node, zeros, ones = nodes[r["slot"]], r["zeros"], r["ones"]
                tree.value[node] = ones[0] / (zeros[0] + ones[0])
                if r["candidate"] < 0:
                    continue
                feature = chosen[r["slot"]][r["candidate"]]
                gains[place][feature] += r["gain"]
                for child, a, b in zip(tree.split(node, feature, r["bin"], True), zeros[1:], ones[1:]):
                    tree.value[child] = b / (a + b)
                    if a and b:
                        open_nodes[place].append(child)
    for i, fit in enumerate(fits):
        each = [gains[i, t] / gains[i, t].sum() for t in range(trees) if gains[i, t].sum() > 0]
        total = np.sum(each, axis=0) if each else np.zeros(d)
        fit.importances = total / total.sum() if each else total


def accuracy(blocks: DataFrame, fits: list[Fit]) -> list[float]:
    """Share of the left-out rows that each fit predicts right, all in one job; 0 without such rows."""
    def run(batches):
        right, n = np.zeros(len(fits), np.int64), np.zeros(len(fits), np.int64)
        for codes, y, fold, _ in _arrays(batches):
            for i, fit in enumerate(fits):
                own = np.flatnonzero(fold == fit.fold)
                if len(own):
                    p = np.mean([t.scores(codes[:, own]) for t in fit.trees], axis=0)
                    right[i] += int(((p > 0.5) == (y[own] == 1)).sum())
                    n[i] += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fits), dtype=np.int32)), pa.array(right), pa.array(n)], ["fit", "right", "n"])

    found = {r["fit"]: r["share"] for r in blocks.mapInArrow(run, "fit int, right long, n long").groupBy("fit").agg(
        (F.sum("right") / F.when(F.sum("n") > 0, F.sum("n"))).alias("share")).collect()}
    return [found.get(i) or 0.0 for i in range(len(fits))]


def eliminate(blocks: DataFrame, d: int, folds: int, step: int, trees: int, depth: int, seed: int,
              least: int) -> tuple[list[int], dict[int, float]]:
    """The kept features and the mean accuracy by number of features.  The folds and the whole table
    drop their own least important feature (ties: the lower one) after every size; the whole table's
    features at the most accurate size are kept (ties: the smaller size)."""
    kept = {f: list(range(d)) for f in [*range(folds), ALL_ROWS]}
    scores, path = {}, {}
    while True:
        size = len(kept[ALL_ROWS])
        path[size] = kept[ALL_ROWS]
        fits = [Fit(kept[f], f) for f in kept]
        grow(blocks, fits, trees, depth, seed)
        scores[size] = float(np.mean(accuracy(blocks, [f for f in fits if f.fold != ALL_ROWS])))
        if size <= least:
            break
        drop = min(step, size - least)
        for fit in fits:
            weakest = sorted(fit.kept, key=lambda c: (fit.importances[c] if c < len(fit.importances) else 0.0, c))[:drop]
            kept[fit.fold] = [c for c in fit.kept if c not in weakest]
    return path[max(sorted(scores), key=lambda n: scores[n])], scores
