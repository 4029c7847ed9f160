"""Whitening of integer vectors: eigenvectors found in float32, corrected in float64.

The fit list holds each distinct vector once; it is written to the shared folder and read
three times: for its exact sums, for its covariance, for the check of the result.  Tasks
reduce their vectors to d sums or d rows of products; rows of one index are merged in two
rounds, so no task reads more than a share of the partial sums.  Only the d x d
covariance reaches the driver (32 KB for 64 dimensions, 128 MB for 4096).

``eigen`` takes float32 eigenvectors and improves all of them at once with matrix
products in float64 (Ogita and Aishima): with R = I - X'X and S = X'AX the correction of
column j along column i is (S_ij + l_j R_ij) / (l_j - l_i), or R_ij / 2 where the two
eigenvalues are too close to be told apart.  Such a cluster is a smaller problem of its
own: A less the cluster's mean eigenvalue, projected on the cluster and scaled up, is
solved by the same function and turns the cluster's columns.

Rows: a vector that is null, empty or holds a null or non-finite entry gives no row; rows
that repeat a vector count once in the fit and are all returned, as are null ids; vectors
of different lengths are fitted apart, each length with its own n; an empty table gives
an empty table.  An entry is held at +-2^52.  ``deviation`` is null where it needs more
than 64 bits.  A component without variance (fewer distinct vectors than dimensions, a
constant dimension) has explained 0 and whitened null, as has every component if n is 1.
Equal eigenvalues leave their eigenvectors free inside the common space; any
orthonormal choice is right, and all rows use the same one.
"""
from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch

COMPONENTS = 16
#: Entries are held inside this bound, where doubles are exact integers.
LIMIT = 1 << 52
#: Vectors in a matrix product, and partial rows merged by one task in the first round.
BLOCK, FAN_IN = 4096, 64


def quantise(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * c) + offset of every entry, null unless all entries are finite."""
    x = F.transform(vector, lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.transform(x, lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))) + offset,
                                                       F.lit(LIMIT)), F.lit(-LIMIT)))
    return F.when(usable & (F.size(x) > 0), held)


def eigen(a: np.ndarray, rounds: int = 12, noise: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and unit eigenvectors (columns) of a symmetric float64 matrix.

    ``noise`` is the size below which entries are rounding errors of a larger problem."""
    d = len(a)
    a = (a + a.T) / 2
    scale = np.abs(a).max(initial=0.0)
    if d == 1 or scale <= noise:
        return np.diag(a).copy(), np.eye(d)
    noise = max(noise, d * np.finfo(np.float64).eps * scale)
    _, x = np.linalg.eigh((a / scale).astype(np.float32))
    x = x.astype(np.float64)
    last, solved = np.inf, 0
    for turn in range(rounds):
        r = np.eye(d) - x.T @ x
        s = x.T @ (a @ x)
        lam = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(lam, kind="stable")
        lam, x, r, s = lam[order], x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        close = max(2 * (np.linalg.norm(s - np.diag(lam)) + np.linalg.norm(lam) * np.linalg.norm(r)), noise)
        gap = lam[None, :] - lam[:, None]
        near = np.abs(gap) <= close
        e = np.where(near, r / 2, (s + lam[None, :] * r) / np.where(near, 1.0, gap))
        x = x + x @ e
        size = np.abs(e).max()
        still = size < 1e-15 or (size < 1e-12 and size >= last / 2)
        if still and solved:
            break
        if solved < 2 and (still or size < 1e-6 or turn >= 3):
            x = _clusters(a, x, lam, close, noise)
            solved += 1
        last = size
    for _ in range(2):      # corrections over small gaps leave columns slightly oblique
        x = x + x @ ((np.eye(d) - x.T @ x) / 2)
    x = x / np.linalg.norm(x, axis=0)
    lam = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(lam, kind="stable")
    return lam[order], x[:, order]


def _clusters(a: np.ndarray, x: np.ndarray, lam: np.ndarray, close: float, noise: float) -> np.ndarray:
    """x with the columns of each run of close eigenvalues turned by a solve of their own."""
    edges = np.flatnonzero(np.diff(lam) > close) + 1
    x = x.copy()
    for lo, hi in zip([0, *edges], [*edges, len(lam)]):
        # a cluster that holds all columns is smaller only after its mean is taken off
        if hi - lo > 1 and (hi - lo < len(lam) or lam[-1] - lam[0] < np.abs(lam).max() / 4):
            q, _ = np.linalg.qr(x[:, lo:hi])
            mid = lam[lo:hi].mean()
            _, turn = eigen(q.T @ (a @ q - mid * q), noise=noise)
            x[:, lo:hi] = q @ turn
    return x


@dataclass
class Whitening:
    """A fit: n distinct vectors, their exact sums, and the leading components."""
    n: int
    sums: list[int]
    values: np.ndarray        #: eigenvalues of the covariance, falling
    vectors: np.ndarray       #: their unit eigenvectors, one in each column
    trace: float
    identity_error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        """Components whose variance is more than rounding."""
        return self.values > len(self.sums) * np.finfo(np.float64).eps * max(self.trace, 0.0)

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and the rest, below 1, as doubles."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([float(Fraction(s, self.n) - w) for s, w in zip(self.sums, whole)])

    def matrix(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.usable, self.vectors / np.sqrt(np.where(self.usable, self.values, 1.0)), 0.0)


def _blocks(column, d: int):
    """Vectors of an Arrow list column as int64 matrices of at most BLOCK rows."""
    for lo in range(0, len(column), BLOCK):
        yield column.slice(lo, BLOCK).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, centre) -> np.ndarray:
    return (x - centre[0]).astype(np.float64) - centre[1]


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and the exact sum of every dimension."""
    def run(batches):
        total, n = [0] * d, 0
        for batch in batches:
            for x in _blocks(batch.column(0), d):
                n += len(x)
                high, low = x >> 26, x & ((1 << 26) - 1)      # neither half's sum can overflow
                total = [t + (int(h) << 26) + int(v) for t, h, v in zip(total, high.sum(0), low.sum(0))]
        if n:
            from decimal import Decimal
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array(map(Decimal, [n, *total]), pa.decimal128(38, 0))], ["i", "s"])

    parts = fit.select("x").mapInArrow(run, "i int, s decimal(38,0)")
    found = {r.i: int(r.s) for r in parts.groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def _products(fit: DataFrame, d: int, centre, matrix: np.ndarray | None = None) -> np.ndarray:
    """Sum over the fit list of c c' for the centred vectors c, projected by ``matrix`` if given.

    The last column holds the sum of c."""
    shared = fit.sparkSession.sparkContext.broadcast((centre, matrix))
    k = d if matrix is None else matrix.shape[1]

    def run(batches):
        centre, matrix = shared.value
        total, found = np.zeros((k, k + 1)), False
        for batch in batches:
            for x in _blocks(batch.column(0), d):
                c = _centred(x, centre)
                c = c if matrix is None else c @ matrix
                total[:, :k] += c.T @ c
                total[:, k] += c.sum(0)
                found |= len(c) > 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(k + 1)
        for row in table.column("row"):
            total += np.frombuffer(row.as_buffer())
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([total.tobytes()], pa.binary())}, schema=pa.schema([("i", pa.int32()), ("row", pa.binary())]))

    rows = fit.select("x").mapInArrow(run, "i int, row binary")
    rows = rows.groupBy("i", (F.spark_partition_id() % FAN_IN).alias("share")).applyInArrow(lambda _, t: merge(t), "i int, row binary")
    rows = rows.groupBy("i").applyInArrow(merge, "i int, row binary")
    out = np.zeros((k, k + 1))
    for r in rows.collect():
        out[r.i] = np.frombuffer(bytes(r.row))
    return out


def fit_distinct(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Fits the distinct vectors of length d in the column x of a stored table."""
    n, sums = _sums(fit, d)
    model = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    centre = model.centre()
    v = _products(fit, d, centre)[:, :d] / n
    values, vectors = eigen(v)
    keep = slice(None, -min(components, d) - 1, -1)
    model.values, model.vectors, model.trace = np.maximum(values[keep], 0.0), vectors[:, keep], float(np.trace(v))
    flip = np.sign(model.vectors[np.abs(model.vectors).argmax(0), range(model.vectors.shape[1])])
    model.vectors = model.vectors * np.where(flip == 0, 1, flip)
    use = model.usable
    if use.any():
        p = _products(fit, d, centre, model.matrix()[:, use])
        mean = p[:, -1] / n
        model.identity_error = float(np.abs(p[:, :-1] / n - np.outer(mean, mean) - np.eye(use.sum())).max())
    return model


SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
    T.StructField("identity_error", T.DoubleType())])


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    centre = model.centre()[0]
    rest = np.array([s - model.n * int(w) for s, w in zip(model.sums, centre)], object)
    c = x - centre
    most = model.n * (int(np.abs(c).max(initial=0)) + 1)
    if most * most * x.shape[1] < 1 << 62:
        y = c * model.n - rest.astype(np.int64)
        return (y * y).sum(1).tolist()
    y = c.astype(object) * model.n - rest
    return [s if s < 1 << 63 else None for s in (y * y).sum(1)]


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row for each vector (columns vec_id and x) and component."""
    d, k = model.vectors.shape
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        centre, matrix, use = model.centre(), model.matrix(), model.usable
        explained = np.where(use, model.values / model.trace if model.trace > 0 else 0.0, 0.0)
        for batch in batches:
            ids = batch.column(0)
            for at, x in enumerate(_blocks(batch.column(1), d)):
                m = len(x)
                w = _centred(x, centre) @ matrix
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at * BLOCK, m).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(_deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w.ravel(), mask=np.tile(~use, m)),
                    pa.array(np.tile(explained, m)),
                    pa.array([model.identity_error] * (m * k), pa.float64())], SCHEMA.names)

    return rows.select(F.col("vec_id"), F.col("x")).mapInArrow(run, SCHEMA)


def whiten(vectors: DataFrame, x: Column, components: int = COMPONENTS, vec_id: str = "vec_id") -> DataFrame:
    """Fits and transforms the integer vectors ``x`` of all rows; columns as in SCHEMA."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x")).filter("x is not null")
    fit = Scratch(spark, "whitening").keep(rows.select("x").distinct(), "distinct")
    out = None
    for (d,) in sorted(fit.select(F.size("x")).distinct().collect()):
        model = fit_distinct(fit.filter(F.size("x") == d), d, components)
        part = transform(rows.filter(F.size("x") == d), model)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def digests(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings, quantise(F.col("embedding"), 64, 1_000_000))
