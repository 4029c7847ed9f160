"""Gradient boosting of binned trees for two classes (survey H7, H8).

Rows are binned once: estimated quantiles cut every feature into at most 254 bins, bin 0 holds
missing values (NaN).  Blocks of rows are stored in the shared folder as one byte a feature
and row, with labels and scores.  A job then sums, for the nodes it is asked for, gradient,
hessian and row count by (node, feature, bin): numpy in the tasks, merged as a tree across
them (``treeReduce``: a fit takes hundreds of these jobs, and planning a query for each would
take most of the time); the driver chooses splits from the sums.  What reaches the driver is
bounded by nodes x features x bins, whatever the number of rows.

A split's gain is ``GL^2/(HL + l2) + GR^2/(HR + l2) - G^2/(H + l2)``, halved, less
``min_gain``; missing values are tried on both sides and go where the gain is larger.  A
leaf's value is ``-G/(H + l2)`` times the step.

* growth ``leaf``: the leaf with the largest gain is split next, up to ``leaves`` leaves.  A job
  also counts the children that other leaves would get, so a tree needs about as many jobs
  as it is deep.
* growth ``level``: all leaves of a level are split, down to ``depth``.

Of two siblings only the left is counted; the right is the parent less the left.  The blocks that
are held get their new scores after every tree, so a job walks no tree but the growing one; they are stored
every ``FLUSH`` trees, which bounds what a lost executor costs.
Ties between splits go to the lower feature and bin.  All steps but the sums' rounding are
functions of the data, so lost executors change nothing.
"""
from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudframe.sources.replay import scratch_dir

MOST_BINS, BLOCK_ROWS, FLUSH = 254, 1 << 15, 10
#: Trees of more nodes are walked without a table of (node, code).
TABLE_NODES = 4096
#: Cells (node, feature, bin) that a task sums together, 24 bytes each; more take further jobs.
CELLS = 4_000_000
TASK_ROWS = 1 << 18, 1 << 24


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 100
    step: float = 0.1
    growth: str = "leaf"
    leaves: int = 31            #: of a tree grown by leaf
    depth: int = 6              #: of a tree grown by level
    l2: float = 0.0
    min_gain: float = 0.0
    min_rows: int = 20          #: rows and sum of hessians that a leaf has at least
    min_hessian: float = 1e-3
    bins: int = MOST_BINS

    def __post_init__(self):
        if self.growth not in ("leaf", "level") or not 2 <= self.bins <= MOST_BINS or self.rounds < 1:
            raise ValueError(f"unusable {self}")


#: The settings of the two boosted models of the catalog.
LEAF_WISE = BoostParams()
REGULARISED = BoostParams(step=0.3, growth="level", l2=1.0, min_rows=1, min_hessian=1.0)


@dataclass
class Tree:
    """Node 0 is the root; a leaf has feature -1.  A row goes left if its bin is at most
    ``bin``; one without a value goes left if ``missing_left``."""
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int, missing_left: bool) -> tuple[int, int]:
        a = len(self.feature)
        for column, new in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.extend([new, new])
        self.feature[node], self.bin[node], self.missing_left[node], self.left[node], self.right[node] = feature, bin, missing_left, a, a + 1
        return a, a + 1

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of every row; codes has a row for each feature."""
        n = codes.shape[1]
        feature, bins, missing, left, right = map(np.array, (self.feature, self.bin, self.missing_left, self.left, self.right))
        at, leaf = np.zeros(n, np.int64), feature < 0
        if leaf[0] or not n:
            return at
        if len(feature) > TABLE_NODES:
            rows = np.arange(n)
            while len(rows):
                rows = rows[~leaf[at[rows]]]
                node = at[rows]
                code = codes[feature[node], rows]
                at[rows] = np.where(np.where(code == 0, missing[node], code <= bins[node]), left[node], right[node])
            return at
        # the next node by (node, code); a leaf leads to itself
        goes_left = np.arange(256)[None, :] <= bins[:, None]
        goes_left[:, 0] = missing
        following = np.where(goes_left, left[:, None], right[:, None])
        following[leaf] = np.flatnonzero(leaf)[:, None]
        following, start, codes = following.ravel(), np.where(leaf, 0, feature) * n, np.ascontiguousarray(codes).ravel()
        rows, own = np.arange(n), at
        while True:
            for _ in range(3):
                own = following.take((own << 8) + codes.take(start.take(own) + rows))
            at[rows] = own
            rows = rows[~leaf.take(own)]
            if not len(rows):
                return at
            own = at[rows]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(codes)]

    def pruned(self, leaves: set[int]) -> Tree:
        """The tree cut at ``leaves``."""
        out, todo = Tree(), [(0, 0)]
        while todo:
            old, new = todo.pop()
            if old in leaves:
                out.value[new] = self.value[old]
                continue
            a, b = out.split(new, self.feature[old], self.bin[old], self.missing_left[old])
            todo += [(self.left[old], a), (self.right[old], b)]
        return out


def encode_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins (features x rows) of a matrix of rows: 0 for NaN, else 1 + the number of edges below."""
    out = np.empty((len(edges), len(x)), np.uint8)
    for j, e in enumerate(edges):
        out[j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j], side="left"))
    return out


def _edges(rows: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    cuts = [i / bins for i in range(1, bins)]
    x = [F.when(~F.isnan(F.col("x")[j]), F.col("x")[j]) for j in range(d)]
    found = rows.agg(*[F.percentile_approx(c, cuts, 10_000).alias(f"e{j}") for j, c in enumerate(x)]).first()
    return [np.unique(np.array(found[j] or [], float)) for j in range(d)]


def _blocks(rows: DataFrame, edges: list[np.ndarray], base: float) -> DataFrame:
    """(n, codes, label, score): blocks of rows, features after one another."""
    def run(batches):
        def block(x, y):
            codes = encode_bins(np.concatenate(x).reshape(-1, len(edges)), edges)
            y = np.concatenate(y).astype(np.int8)
            return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), pa.array([codes.tobytes()]), pa.array([y.tobytes()]),
                                               pa.array([np.full(len(y), base).tobytes()])], ["n", "codes", "label", "score"])

        x, y, size = [], [], 0
        for batch in batches:
            for lo in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x.append(part.column(0).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False))
                y.append(part.column(1).to_numpy(zero_copy_only=False))
                size += len(part)
                if size >= BLOCK_ROWS:
                    yield block(x, y)
                    x, y, size = [], [], 0
        if size:
            yield block(x, y)

    return rows.select("x", "y").mapInArrow(run, "n int, codes binary, label binary, score binary")


def _arrays(rows, d: int, trees: list[Tree]):
    """codes, label and up-to-date score of every block."""
    for n, codes, label, score in rows:
        codes = np.frombuffer(codes, np.uint8).reshape(d, n)
        score = np.frombuffer(score, np.float64)
        for t in trees:
            score = score + t.scores(codes)
        yield codes, np.frombuffer(label, np.int8), score


def _sums(blocks: RDD, d: int, width: int, tree: Tree, wanted: list[int]) -> dict[int, np.ndarray]:
    """node -> (features, bins, [gradient, hessian, rows]) of the wanted leaves of a growing tree."""
    at_once = max(1, CELLS // (d * width))
    if len(wanted) > at_once:
        return {n: s for lo in range(0, len(wanted), at_once) for n, s in _sums(blocks, d, width, tree, wanted[lo:lo + at_once]).items()}
    shape = (3, len(wanted), d, width)

    def run(rows):
        slot = np.full(len(tree.feature), -1)
        slot[wanted] = np.arange(len(wanted))
        total = np.zeros(shape)
        for codes, label, score in _arrays(rows, d, []):
            at = slot[tree.nodes(codes)]
            own = np.flatnonzero(at >= 0)
            p = 1 / (1 + np.exp(-score[own]))
            g, h, start = p - label[own], p * (1 - p), at[own] * width
            whole = len(own) == len(label)
            for j in range(d):
                key = start + (codes[j] if whole else codes[j].take(own))
                for k, weight in enumerate((g, h, None)):
                    total[k, :, j] += np.bincount(key, weight, len(wanted) * width).reshape(len(wanted), width)
        yield total

    total = blocks.mapPartitions(run).treeReduce(np.add)
    return {node: np.moveaxis(total[:, k], 0, -1) for k, node in enumerate(wanted)}


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: np.ndarray        #: gradient, hessian, rows
    right: np.ndarray


def best_split(sums: np.ndarray, p: BoostParams) -> Split | None:
    """The split with the largest gain of a leaf's sums, None if none gains."""
    missing, known = sums[:, :1], sums[:, 1:]
    total = sums[0].sum(0)
    below = np.cumsum(known, 1)
    best = None
    for to_left in (False, True):
        if to_left and not missing[:, 0, 2].any():
            continue
        left = below + missing if to_left else below
        right = total - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left[..., 0] ** 2 / (left[..., 1] + p.l2) + right[..., 0] ** 2 / (right[..., 1] + p.l2) - total[0] ** 2 / (total[1] + p.l2)) / 2 - p.min_gain
        ok = (left[..., 2] >= max(p.min_rows, 1)) & (right[..., 2] >= max(p.min_rows, 1)) & (left[..., 1] >= p.min_hessian) & (right[..., 1] >= p.min_hessian)
        gain = np.where(ok & np.isfinite(gain), gain, -np.inf)
        # gains within rounding are ties
        top = gain.max(initial=-np.inf)
        if top > 1e-12 and (best is None or top > best.gain * (1 + 1e-12)):
            j, b = np.unravel_index(np.argmax(gain >= top * (1 - 1e-12)), gain.shape)
            best = Split(float(top), int(j), int(b) + 1, to_left, left[j, b], right[j, b])
    return best


def _grow(sums_of, p: BoostParams) -> Tree:
    """``sums_of(tree, nodes)`` gives the sums of leaves of a growing tree."""
    tree, sums, splits, totals, depth = Tree(), {}, {}, {}, {0: 0}
    parents: dict[int, int] = {}

    def learn(nodes: list[int]) -> None:
        """Sums and best splits of these leaves; the leaves get the children they would have."""
        nodes = [n for n in nodes if n not in sums]
        ask = [n for n in nodes if n == 0 or n == tree.left[parents[n]] or tree.left[parents[n]] not in nodes]
        if not ask:
            return
        sums.update(sums_of(tree, ask))
        for n in nodes:
            if n not in ask:
                sums[n] = sums[parents[n]] - sums[tree.left[parents[n]]]
        for n in nodes:
            totals.setdefault(n, sums[n][0].sum(0))
            s = best_split(sums[n], p) if p.growth == "leaf" or depth[n] < p.depth else None
            if s is not None:
                splits[n] = s
                for child, total in zip(tree.split(n, s.feature, s.bin, s.missing_left), (s.left, s.right)):
                    parents[child], depth[child], totals[child] = n, depth[n] + 1, total

    learn([0])
    leaves = {0}
    while True:
        able = [n for n in leaves if n in splits]
        if not able or (p.growth == "leaf" and len(leaves) >= p.leaves):
            break
        chosen = able if p.growth == "level" else [max(able, key=lambda n: (splits[n].gain, -n))]
        for n in chosen:
            leaves.remove(n)
            leaves |= {tree.left[n], tree.right[n]}
        open_leaves = sorted(n for n in leaves if n not in sums and (p.growth == "leaf" or depth[n] < p.depth))
        if open_leaves and (p.growth == "level" or len(leaves) < p.leaves):
            ahead = [c for n in leaves if n in splits for c in (tree.left[n], tree.right[n])] if p.growth == "leaf" else []
            learn(sorted({*open_leaves, *ahead}))
    for n in leaves:
        g, h, _ = totals[n]
        tree.value[n] = -g / (h + p.l2) * p.step if h + p.l2 > 0 else 0.0
    return tree.pruned(leaves)


class BoostedTrees:
    """``fit`` on a table with a vector of features and a 0/1 label."""

    def __init__(self, params: BoostParams, label: str = "label", features: str = "features"):
        self.params, self.label, self.features = params, label, features

    def fit(self, df: DataFrame) -> BoostedTreesModel:
        p, spark = self.params, df.sparkSession
        rows = df.select(vector_to_array(F.col(self.features)).alias("x"), F.col(self.label).cast("int").alias("y"))
        d, n, ones = rows.agg(F.max(F.size("x")), F.count(F.lit(1)), F.sum("y")).first()
        if not n or not 0 < ones < n:
            raise ValueError(f"classes 0 and 1 expected, got {ones or 0} ones in {n} rows")
        edges = _edges(rows, d, p.bins)
        base = float(np.log(ones / (n - ones)))
        folder = scratch_dir(spark, "boost")

        def keep(blocks: DataFrame, at: int) -> DataFrame:
            blocks.write.parquet(f"{folder}/{at}")
            return spark.read.schema(blocks.schema).parquet(f"{folder}/{at}")

        # tasks of a quarter million rows; of more where that would make very many tasks
        tasks = max(-(-n // TASK_ROWS[1]), min(-(-n // TASK_ROWS[0]), 4 * spark.sparkContext.defaultParallelism))
        blocks = keep(_blocks(rows.repartition(tasks), edges, base), 0)
        held = blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        width = 2 + max(map(len, edges), default=0)
        trees: list[Tree] = []
        since: list[Tree] = []
        past = None     # what the held blocks come from, given back when they are there
        for turn in range(p.rounds):
            tree = _grow(lambda tree, nodes: _sums(held, d, width, tree, nodes), p)
            if past is not None:
                past.unpersist()
            trees.append(tree)
            since.append(tree)
            if turn + 1 == p.rounds:
                break
            past = held
            if len(since) == FLUSH:
                blocks, since = keep(_with_scores(blocks, d, since), turn + 1), []
                held = blocks.rdd.map(tuple)
            else:
                held = held.mapPartitions(_advance(d, tree))
            held = held.persist(StorageLevel.MEMORY_AND_DISK)
        held.unpersist()
        return BoostedTreesModel(trees, edges, base, self.features)


def _advance(d: int, tree: Tree):
    """Blocks whose scores take in one more tree."""
    def run(rows):
        for n, codes, label, score in rows:
            new = np.frombuffer(score, np.float64) + tree.scores(np.frombuffer(codes, np.uint8).reshape(d, n))
            yield n, codes, label, new.tobytes()

    return run


def _with_scores(blocks: DataFrame, d: int, trees: list[Tree]) -> DataFrame:
    def run(batches):
        for batch in batches:
            scores = [s.tobytes() for _, _, s in _arrays(zip(*[c.to_pylist() for c in batch.columns]), d, trees)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.binary())], ["n", "codes", "label", "score"])

    return blocks.mapInArrow(run, blocks.schema)


@dataclass
class BoostedTreesModel:
    trees: list[Tree]
    edges: list[np.ndarray]
    base: float
    features: str = "features"

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for a matrix of rows."""
        codes = encode_bins(x, self.edges)
        return self.base + sum((t.scores(codes) for t in self.trees), np.zeros(len(x)))

    def transform(self, df: DataFrame) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def odds(x: pd.Series) -> pd.Series:
            return pd.Series(model.value.margins(np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype=float)

        p1 = 1.0 / (1.0 + F.exp(-F.col("__odds")))
        return (df.withColumn("__odds", odds(vector_to_array(F.col(self.features)))).withColumn("prediction", (F.col("__odds") > 0).cast("double"))
                .withColumn("probability", array_to_vector(F.array(1.0 - p1, p1))).drop("__odds"))

    def to_json(self) -> str:
        return json.dumps({"trees": [asdict(t) for t in self.trees], "edges": [e.tolist() for e in self.edges], "base": self.base, "features": self.features})

    @staticmethod
    def from_json(text: str) -> BoostedTreesModel:
        m = json.loads(text)
        return BoostedTreesModel([Tree(**t) for t in m["trees"]], [np.array(e, float) for e in m["edges"]], m["base"], m["features"])
