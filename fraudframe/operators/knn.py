"""Exact k nearest neighbours: own cell first, then groups of queries against the cells they need (survey H3, E5).

1. Copies: of equal vectors only the ``k + 1`` lowest ids can be among anyone's nearest, the others are left out.
2. Pivots: the reference rows with the smallest seeded hash, one for about ``BLOCK`` rows, at
   most ``MAX_PIVOTS`` of them (they go to every task; with more rows cells grow).  Every reference
   row goes to its nearest pivot's cell.
3. Every query is compared with the cell of its nearest pivot; its k-th distance there is a limit.
4. A row x of another cell j is at least ``max(d - far, near - d, (d^2 - e^2) / 2f)`` away, with d and e the
   query's distances to the pivots of j and of its own cell, f the distance of these two, near and far
   the least and largest distance of the cell's rows to its pivot.  Cells with a bound above the
   query's limit hold none of its nearest rows, so the result is exact.
5. Queries of neighbouring cells form groups of up to ``GROUP``.  A group gets every cell that one of its queries
   needs once, nearest first, cut into parts of up to ``PART`` rows for as many tasks.  What is moved
   follows groups x rows, not queries x cells.  A task holds the group's vectors and best rows and streams
   the rows past them: one matrix product (in floats, less what rounding can do) finds the
   pairs that may be near enough, whose distances are then computed exactly.
6. The lists of a query's cells are merged by a window.

Steps 3, 5 and 6 are done for batches of groups, and step 5 in waves, so that about ``MOVED`` bytes (or an eighth of the rows, if
that is more, or what one group needs) are shuffled at a time; their files go when the wave or batch is done.  On disk are
the rows once, the queries once where they are not the same table, a batch and the results.

Ties go to the lower reference id.  Queries need unique ids.  Rows, limits and results are
stored in the shared folder, so lost executors cost the tasks of one step at most.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fraudframe.sources.replay import remove, scratch_dir, setting, stored

BLOCK = 2048
#: Queries that one cell's tasks hold together.
QBLOCK = 16384
MAX_PIVOTS = 4096
#: Queries of a group, fewer where their neighbours' vectors are held too; reference rows of one of its parts.
GROUP, PART = 65536, 1 << 19
#: Bytes of rows that are shuffled at once, groups of a wave, and vectors that many rows share whose number is sent to all tasks.
MOVED, WAVE_GROUPS, MOST_SHARED = 1 << 30, 256, 1 << 20
#: Rows whose distances to all pivots are held together; pairs of one matrix product; pairs compared exactly at once.
SLICE, PAIRS, EXACT = 1024, 1 << 21, 1 << 15
MOST_TASKS = 8192
#: Off while vectors are made of many computed columns: a condition on a vector would be inferred for every way to name its columns.
CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def _vec(df: DataFrame, cols: list[str] | str) -> DataFrame:
    if isinstance(cols, str):
        return df.withColumn("__vec", F.col(cols).cast("array<double>"))
    return df.withColumn("__vec", F.array(*[F.col(c).cast("double") for c in cols]))


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow column of lists, all of one length; missing components are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("a vector is missing")
    lengths = np.diff(column.offsets.to_numpy())
    if lengths.min() != lengths.max():
        raise ValueError("vectors differ in length")
    return column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(column), lengths[0])


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows by one matrix product; ``ROUNDING`` times the squared norms bounds its error."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0.0)


ROUNDING = 1e-12


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(1))


def _spatial_order(points: np.ndarray) -> np.ndarray:
    """An order in which neighbours are mostly near one another: halves by the widest component."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        spread = points[rows].max(0) - points[rows].min(0) if len(rows) > 1 else np.zeros(1)
        if not len(spread) or not spread.max() > 0:
            out.extend(rows)
            continue
        rows = rows[np.argsort(points[rows, spread.argmax()], kind="stable")]
        todo += [rows[len(rows) // 2:], rows[:len(rows) // 2]]
    return np.array(out, np.int64)


class _Cells:
    """Pivots of the cells that have rows, and what bounds the distances of these rows."""

    def __init__(self, pivots, cells, near, far, largest):
        self.number, self.near, self.far = cells, near, far
        self.pivots = pivots[cells]
        self.centre = self.pivots.mean(0)
        self.centred = self.pivots - self.centre
        self.norms, self.largest = (self.centred ** 2).sum(1), largest

    def least(self, x: np.ndarray, own: np.ndarray, some=slice(None)) -> np.ndarray:
        """Lower bounds (queries x cells) of the distances to the rows of cells, for queries in the cells ``own``."""
        x = x - self.centre
        size = (x * x).sum(1)[:, None]
        norms = self.norms[some][None, :]
        sq = _squares(x, self.centred[some])
        slack = ROUNDING * (size + norms)
        d = np.sqrt(sq)
        d_slack = slack / np.maximum(d, np.sqrt(slack) + 1e-300)
        out = np.maximum(d - self.far[some], self.near[some] - d) - d_slack
        # rows of cell j are not nearer to the query's own pivot than to theirs
        at, back = np.unique(own, return_inverse=True)
        mine = (((x - self.centred[own]) ** 2).sum(1))[:, None]
        between = np.sqrt(_squares(self.centred[at], self.centred[some]))[back]
        loose = slack + ROUNDING * (size + 2 * self.largest[some][None, :] + norms + self.norms[own][:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            side = (sq - mine - loose) / (2 * between + 2 * ROUNDING * between + np.sqrt(ROUNDING * (norms + self.norms[own][:, None])))
        out = np.maximum(out, np.where(np.isfinite(side), side, 0.0))
        return np.maximum(out, 0.0) * (1 - 1e-9)


def _finite(c: str) -> Column:
    """Vectors with a component that is no number are nobody's neighbours (missing vectors raise later)."""
    return F.coalesce(F.forall(c, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.col(c).isNull())


class _Tile:
    """Queries and their k nearest of the rows that have been streamed past them."""

    def __init__(self, k: int, exclude: bool, cells: _Cells, payload: list[str], first: bool):
        self.k, self.exclude, self.cells, self.payload, self.first = k, exclude, cells, payload, first
        self.parts, self.ready, self.pending, self.cell, self.stored, self.rows = [], False, [], None, [], 0

    def add(self, kind: int, cell: int, part: pa.RecordBatch) -> None:
        if kind == 0:
            self.parts.append(part)
            return
        if not self.ready:
            self.start()
        if self.cell != cell or sum(map(len, self.pending)) >= 2 * BLOCK:
            self.flush()
        self.cell = cell
        self.pending.append(part)

    def start(self) -> None:
        self.ready = True
        self.queries = pa.Table.from_batches(self.parts).combine_chunks() if self.parts else None
        self.parts = []
        if self.queries is None:
            return
        self.x = _matrix(self.queries.column("__vec"))
        self.own = self.queries.column("__cell").to_numpy()
        self.ids = self.queries.column("__qid").to_numpy()
        self.limit = self.queries.column("__far").to_numpy().copy()
        n = len(self.x)
        self.dist, self.at = np.full((n, self.k), np.inf), np.full((n, self.k), -1, np.int64)
        self.best_ids = None

    def flush(self) -> None:
        """Compares the pending rows of one cell with the queries that need it."""
        rows, self.pending = self.pending, []
        if not rows or self.queries is None:
            return
        rows = pa.Table.from_batches(rows)
        y, names = _matrix(rows.column("__vec")), rows.column("__rid").to_numpy()
        if self.first:
            chosen = np.arange(len(self.x))
        else:
            place = int(np.searchsorted(self.cells.number, self.cell))
            chosen = np.flatnonzero((self.own != place) & (self.cells.least(self.x, self.own, [place])[:, 0] <= self.limit))
        step = max(1, PAIRS // len(y))
        pivot = y.mean(0)
        y_near = y - pivot
        for lo in range(0, len(chosen), step):
            self.compare(chosen[lo:lo + step], y, y_near, pivot, names)
        used = self.at >= self.rows
        if used.any():
            # of this piece only rows that are among the best so far are held
            places, self.at[used] = np.unique(self.at[used] - self.rows, return_inverse=True)
            self.at[used] += self.rows
            self.stored.append(rows.select(self.payload).take(places))
            self.rows += len(places)
            if self.rows > 4 * self.at.size + (1 << 14):
                self.compact()

    def compact(self) -> None:
        live = self.at >= 0
        places, self.at[live] = np.unique(self.at[live], return_inverse=True)
        self.stored = [pa.concat_tables(self.stored).combine_chunks().take(places)] if self.stored else []
        self.rows = len(places)

    def compare(self, q: np.ndarray, y, y_near, pivot, names) -> None:
        x = self.x[q] - pivot
        xx, yy = (x * x).sum(1), (y_near * y_near).sum(1)
        d = x.shape[1]
        small = max(xx.max(initial=0), yy.max(initial=0)) < 1e30
        kind, unit = (np.float32, 2e-7) if small else (np.float64, 4e-16)
        loose = unit * (d + 6)
        a, b = np.empty((len(x), d + 2), kind), np.empty((len(y), d + 2), kind)
        a[:, :d], a[:, d], a[:, d + 1] = -2 * x, 1, (1 - loose) * xx
        b[:, :d], b[:, d], b[:, d + 1] = y_near, (1 - loose) * yy, 1
        low = a @ b.T       # squared distances less their possible error
        limit = self.limit[q]
        most = limit * limit * (1 + 1e-6) + 1e-36
        without = np.flatnonzero(np.isinf(limit))
        if len(without) and len(y) > self.k:
            part = low[without]
            if self.exclude:
                part = np.where(self.ids[q[without]][:, None] == names[None, :], np.inf, part)
            high = np.partition(part + (2 * loose * yy).astype(kind), self.k - 1, axis=1)[:, self.k - 1].astype(float)
            most[without] = (high + 2 * loose * xx[without]) * (1 + 1e-6) + 1e-36
        with np.errstate(over="ignore"):
            hits = np.flatnonzero(low <= np.nextafter(most.astype(kind), kind(np.inf))[:, None])
        for lo in range(0, len(hits), EXACT):
            self.merge(q, *np.divmod(hits[lo:lo + EXACT], len(y)), y, names)

    def merge(self, q, i, j, y, names) -> None:
        dist = _exact(self.x[q[i]], y[j])
        keep = dist <= self.limit[q[i]]
        if self.exclude:
            keep &= self.ids[q[i]] != names[j]
        who, j, dist = q[i][keep], j[keep], dist[keep]
        if not len(who):
            return
        if self.best_ids is None:
            self.best_ids = np.zeros(self.at.shape, names.dtype) if names.dtype != object else np.full(self.at.shape, "", object)
        # a query's rows lie together: they are ordered by query
        rank_ids, held = names[j], self.best_ids
        if names.dtype == object:
            found, codes = np.unique(np.concatenate([rank_ids.astype(str), held[np.unique(who)].ravel().astype(str)]), return_inverse=True)
            rank_ids = codes[:len(j)]
        order = np.lexsort((rank_ids, dist, who))
        who, j, dist = who[order], j[order], dist[order]
        new = np.r_[True, who[1:] != who[:-1]]
        begin, row = np.flatnonzero(new), np.cumsum(new) - 1
        rank = np.arange(len(who)) - begin[row]
        ok = rank < self.k
        some, row, rank, j, dist = who[begin], row[ok], rank[ok], j[ok], dist[ok]
        shape = (len(some), 2 * self.k)
        d, at, ids = np.full(shape, np.inf), np.full(shape, -1, np.int64), np.full(shape, "", object) if names.dtype == object else np.zeros(shape, names.dtype)
        d[row, rank], at[row, rank], ids[row, rank] = dist, self.rows + j, names[j]
        d[:, self.k:], at[:, self.k:], ids[:, self.k:] = self.dist[some], self.at[some], held[some]
        by = np.unique(ids.astype(str), return_inverse=True)[1].reshape(shape) if names.dtype == object else ids
        best = np.lexsort((by, d), axis=1)[:, :self.k]
        self.dist[some], self.at[some], held[some] = (np.take_along_axis(v, best, 1) for v in (d, at, ids))
        self.limit[some] = np.minimum(self.limit[some], self.dist[some, -1])

    def results(self, schema: pa.Schema):
        if not self.ready:
            self.start()
        self.flush()
        if self.queries is None:
            return
        if self.first:      # the queries with their limits, for the next step
            limited = self.queries.set_column(self.queries.column_names.index("__far"), "__far", pa.array(self.limit))
            yield from _fitted(limited, schema)
        self.compact()
        if self.stored:
            i, rank = np.nonzero(self.at >= 0)
            out = self.stored[0].take(self.at[i, rank])
            out = out.append_column("__qid", self.queries.column("__qid").take(pa.array(i))).append_column("dist", pa.array(self.dist[i, rank]))
            yield from _fitted(out, schema)


def _fitted(table: pa.Table, schema: pa.Schema):
    """The table's batches with the schema's columns, those it has not as nulls."""
    columns = [table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(len(table), f.type) for f in schema]
    yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=1 << 14)


def _tiles(rows: DataFrame, tasks: int, k: int, exclude: bool, cells, payload: list[str], first: bool) -> DataFrame:
    """Every tile's best rows.  ``rows``: __tile, __kind (0 for queries, 1 for reference rows), __ord, __cell, __qid, __rid, __vec, __far, __h, carried columns."""
    keep = [c for c in rows.columns if c not in ("__kind", "__ord", "__tile")]
    fields = [rows.schema[c] for c in keep] + [T.StructField("dist", T.DoubleType())]
    fields = [T.StructField(f.name, f.dataType, True) for f in fields]
    out = to_arrow_schema(T.StructType(fields))
    # all tasks get a share of the tiles
    rows = rows.repartitionById(tasks, F.pmod("__tile", F.lit(tasks)).cast("int")).sortWithinPartitions("__tile", "__kind", "__ord", "__cell")

    def run(batches):
        tile = held = None
        for batch in batches:
            of, kind, cell = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("__tile", "__kind", "__cell"))
            cut = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]) | ((kind[1:] == 1) & (cell[1:] != cell[:-1]))]) if len(of) else []
            for lo, hi in zip(cut, [*cut[1:], len(of)]):
                if held is None or of[lo] != tile:
                    if held is not None:
                        yield from held.results(out)
                    tile, held = of[lo], _Tile(k, exclude, cells.value, payload, first)
                held.add(int(kind[lo]), int(cell[lo]), batch.slice(lo, hi - lo))
        if held is not None:
            yield from held.results(out)

    return rows.mapInArrow(run, T.StructType(fields))


def _marked(rows: DataFrame, k: int, rest: list[str], keep) -> DataFrame:
    """``__ref`` for the rows that can be among anyone's nearest: of equal vectors the lowest k + 1 ids, and k rows of one id.
    Only vectors that more than k rows share are compared."""
    same = rows.withColumn("__same", F.xxhash64("__vec"))
    shared = keep(same.groupBy("__same").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k).select("__same"), "shared")
    n = shared.count()
    few = F.broadcast(shared)
    compared = same if n > MOST_SHARED else same.join(few, "__same", "left_semi")
    compared = (compared.withColumn("__a", F.dense_rank().over(Window.partitionBy("__same", "__vec").orderBy("__rid")))
                .withColumn("__b", F.row_number().over(Window.partitionBy("__same", "__vec", "__rid").orderBy(F.xxhash64("__rid", *rest))))
                .withColumn("__ref", (F.col("__a") <= k + 1) & (F.col("__b") <= k)).select(*rows.columns, "__ref"))
    if n > MOST_SHARED:
        return keep(compared, "marked")
    others = same if not n else same.join(few, "__same", "left_anti")
    others = others.withColumn("__ref", F.lit(True)).select(*rows.columns, "__ref")
    return others if not n else others.unionByName(compared)


def _runs(costs: list[int], most: int, longest: int) -> list[tuple[int, int]]:
    """Runs [lo, hi) of consecutive items, of about ``most`` cost and at most ``longest`` items each."""
    out, lo, total = [], 0, 0
    for i, cost in enumerate(costs):
        if i > lo and (total + cost > most or i - lo >= longest):
            out.append((lo, i))
            lo, total = i, 0
        total += cost
    return [*out, (lo, len(costs))]


def knn(queries: DataFrame, refs: DataFrame, k: int, q_id: str, r_id: str, vec: list[str] | str,
        exclude_same_id: bool = False, seed: int = 0, carry: list[str] = (), report: dict | None = None) -> DataFrame:
    """(q_id, r_id, dist, nn_rank, *carry) of the k nearest reference rows of
    every query row (Euclidean).  ``carry`` columns come from ``refs``.  ``report`` takes the number
    of ``rounds``, the ``visited`` share of all (query, reference row) pairs, the ``waves`` and the ``folder`` of the result."""
    with setting(refs.sparkSession, CONSTRAINTS, "false"):
        return _knn(queries, refs, k, q_id, r_id, vec, exclude_same_id, seed, list(carry), {} if report is None else report)


def _knn(queries: DataFrame, refs: DataFrame, k: int, q_id: str, r_id: str, vec: list[str] | str, exclude_same_id: bool, seed: int, carry: list[str], report: dict) -> DataFrame:
    spark = refs.sparkSession
    folder = scratch_dir(spark, "knn")

    def keep(df: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        return stored(df, f"{folder}/{name}", mode)

    rest = [c for c in carry if c != "__vec"]
    one_table = queries is refs and q_id == r_id
    R = _vec(refs, vec).select(F.col(r_id).alias("__rid"), "__vec", *rest).filter(_finite("__vec"))
    R = _marked(R, k, rest, keep)
    n_r = R.filter("__ref").count()
    if n_r == 0:
        raise ValueError("no reference rows")
    n_piv = max(1, min(MAX_PIVOTS, math.ceil(n_r / BLOCK)))
    piv_rows = (R.filter("__ref").withColumn("__h", F.xxhash64("__rid", F.lit(seed))).orderBy("__h", "__rid")
                .limit(n_piv).select("__vec").collect())
    points = np.unique(np.array([r[0] for r in piv_rows], dtype=float), axis=0)
    points = points[_spatial_order(points)]
    centre = points.mean(0)
    pivots = spark.sparkContext.broadcast((points, centre, points - centre))

    def assign(batches):
        P, middle, centred = pivots.value
        for batch in batches:
            X = _matrix(batch.column(batch.schema.get_field_index("__vec")))
            near = X - middle if len(X) else X
            cell = np.concatenate([_squares(near[i:i + SLICE], centred).argmin(1) for i in range(0, len(X), SLICE)] or [np.zeros(0, np.int64)])
            out = pa.Table.from_batches([batch]).append_column("__cell", pa.array(cell.astype(np.int64)))
            out = out.append_column("__dp", pa.array(_exact(X, P[cell]) if len(X) else np.zeros(0)))
            yield from out.append_column("__big", pa.array((near * near).sum(1) if len(X) else np.zeros(0))).to_batches()

    extra = [T.StructField("__cell", T.LongType()), T.StructField("__dp", T.DoubleType()), T.StructField("__big", T.DoubleType())]
    placed = keep((R if one_table else R.filter("__ref")).mapInArrow(assign, T.StructType(R.schema.fields + extra)), "refs")
    assigned = placed.filter("__ref").drop("__ref")
    # one row for each pivot
    found = assigned.groupBy("__cell").agg(F.count(F.lit(1)).alias("n"), F.min("__dp").alias("near"), F.max("__dp").alias("far"), F.max("__big").alias("big")).orderBy("__cell").collect()
    numbers, sizes = np.array([r["__cell"] for r in found]), np.array([r["n"] for r in found])
    cells = spark.sparkContext.broadcast(_Cells(points, numbers, *(np.array([r[c] for r in found], float) for c in ("near", "far", "big"))))

    def place(batches):
        """The queries' cells, as places among the cells that have rows."""
        C = cells.value
        for batch in batches:
            X = _matrix(batch.column(batch.schema.get_field_index("__vec")))
            near = X - C.centre if len(X) else X
            cell = np.concatenate([_squares(near[i:i + SLICE], C.centred).argmin(1) for i in range(0, len(X), SLICE)] or [np.zeros(0, np.int64)])
            yield from pa.Table.from_batches([batch]).append_column("__cell", pa.array(cell.astype(np.int64))).to_batches()

    hashed = F.xxhash64("__qid", F.lit(seed + 2)).alias("__h")
    if one_table:       # the stored rows are the queries, too
        places = F.broadcast(spark.createDataFrame([(int(c), at) for at, c in enumerate(numbers)], "__number long, __place long"))
        asked = placed.join(places, F.col("__cell") == F.col("__number")).select(F.col("__rid").alias("__qid"), "__vec", F.col("__place").alias("__cell")).select("__qid", "__vec", hashed, "__cell")
    else:
        Q = _vec(queries, vec).select(F.col(q_id).alias("__qid"), "__vec").filter(_finite("__vec")).select("__qid", "__vec", hashed)
        asked = keep(Q.mapInArrow(place, T.StructType(Q.schema.fields + [extra[0]])), "queries")
    counts = {r["__cell"]: r["n"] for r in asked.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_q = sum(counts.values())
    cores = max(1, spark.sparkContext.defaultParallelism)
    typed = {"__rid": R.schema["__rid"].dataType, "__qid": asked.schema["__qid"].dataType, "__far": T.DoubleType(), "__h": T.LongType()}
    payload = ["__rid", *carry]

    def tiled(queries: DataFrame, rows: DataFrame) -> DataFrame:
        q = queries.select("__tile", F.lit(0).alias("__kind"), F.lit(0.0).alias("__ord"), "__cell", "__qid", F.lit(None).cast(typed["__rid"]).alias("__rid"), "__vec",
                           "__far", "__h", *[F.lit(None).cast(R.schema[c].dataType).alias(c) for c in rest])
        r = rows.select("__tile", F.lit(1).alias("__kind"), "__ord", "__cell", F.lit(None).cast(typed["__qid"]).alias("__qid"), "__rid", "__vec",
                        F.lit(None).cast("double").alias("__far"), F.lit(None).cast("long").alias("__h"), *rest)
        return q.unionByName(r)

    def spread(n: int) -> int:
        return max(1, min(MOST_TASKS, n))

    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    # groups of queries in neighbouring cells; a large cell's queries are dealt to several
    most = GROUP if "__vec" not in carry else GROUP // 4
    most = max(1, min(most, max(2 * QBLOCK // 8, -(-n_q // 16))))
    begin, share, group, room = np.zeros(len(found), np.int64), np.ones(len(found), np.int64), -1, 0
    for at in range(len(found)):
        n = counts.get(at, 0)
        if n > most:
            share[at] = -(-n // most)
            begin[at], group, room = group + 1, group + int(share[at]), 0
        else:
            if n > room:
                group, room = group + 1, most
            begin[at], room = max(group, 0), room - n
    groups = spark.sparkContext.broadcast((begin, share))
    of_cell = F.broadcast(spark.createDataFrame([(i, int(b), int(s)) for i, (b, s) in enumerate(zip(begin, share))], "__cell long, __begin long, __share long"))

    def grouped(queries: DataFrame) -> DataFrame:
        return queries.join(of_cell, "__cell").withColumn("__group", F.col("__begin") + F.pmod("__h", F.col("__share"))).drop("__begin", "__share")

    def needs(batches):
        """(group, cell, least bound, queries) of the cells that a group's queries still need."""
        C, (first_group, shares) = cells.value, groups.value
        for batch in batches:
            own, h, far = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("__cell", "__h", "__far"))
            X = _matrix(batch.column(batch.schema.get_field_index("__vec")))
            group = first_group[own] + h % shares[own]
            order = np.argsort(group, kind="stable")
            for i in range(0, len(X), SLICE):
                rows = order[i:i + SLICE]
                least = C.least(X[rows], own[rows])
                wanted = least <= far[rows][:, None]
                wanted[np.arange(len(rows)), own[rows]] = False
                cut = np.flatnonzero(np.r_[True, np.diff(group[rows]) != 0])
                n = np.add.reduceat(wanted.astype(np.int64), cut, axis=0)
                bound = np.minimum.reduceat(np.where(wanted, least, np.inf), cut, axis=0)
                g, c = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(group[rows][cut][g]), pa.array(C.number[c].astype(np.int64)), pa.array(bound[g, c]), pa.array(n[g, c])],
                                                 ["__group", "__cell", "__ord", "n"])

    n_of = F.broadcast(spark.createDataFrame([(int(c), int(n)) for c, n in zip(numbers, sizes)], "__cell long, __rows long"))
    w = Window.partitionBy("__qid").orderBy("dist", "__rid")
    best = lambda df: df.withColumn("nn_rank", F.row_number().over(w)).filter(F.col("nn_rank") <= k)

    # the queries of a group in a cell, and what their own step moves
    units = [(at, int(begin[at]) + i, -(-n // int(share[at])), -(-int(sizes[at]) // PART)) for at, n in sorted(counts.items()) for i in range(int(share[at]))]
    moved, asking = np.zeros(group + 1, np.int64), np.zeros(group + 1, np.int64)
    for at, g, n, parts in units:
        moved[g] += int(sizes[at]) * -(-n // QBLOCK) + n * parts
        asking[g] += n
    at_once = max(MOVED // (8 * points.shape[1] + 64), (n_r + n_q) // 8)
    pairs = sum(n * int(sizes[at]) for at, n in counts.items())
    waves = 0

    for batch, (lo, hi) in enumerate(_runs(moved.tolist(), at_once, len(moved))):
        # the own cells: tiles of queries x rows; one row a cell and group that has queries
        plan, tiles = [], 0
        for at, g, n, parts in units:
            if lo <= g < hi:
                plan.append((at, g, int(numbers[at]), tiles, -(-n // QBLOCK), parts))
                tiles += plan[-1][4] * parts
        plan_df = F.broadcast(spark.createDataFrame(plan, "__cell long, __group long, __number long, __base long, __chunks long, __parts long"))
        q_tiles = (grouped(asked).withColumn("__far", F.lit(float("inf"))).join(plan_df, ["__cell", "__group"]).withColumn("__p", steps("__parts"))
                   .withColumn("__tile", F.col("__base") + F.pmod(F.shiftright("__h", 24), F.col("__chunks")) * F.col("__parts") + F.col("__p")))
        r_tiles = (assigned.withColumnRenamed("__cell", "__number").join(plan_df, "__number").withColumn("__c", steps("__chunks")).withColumn("__ord", F.lit(0.0))
                   .withColumn("__tile", F.col("__base") + F.col("__c") * F.col("__parts") + F.pmod(F.xxhash64("__rid", F.lit(seed + 1)), F.col("__parts")))
                   .withColumn("__cell", F.col("__number")))
        tasks = spread(min(tiles, max(2 * cores, int(moved[lo:hi].sum()) // 20_000)))
        first = keep(_tiles(tiled(q_tiles, r_tiles), tasks, k, exclude_same_id, cells, payload, True), f"own-{batch}")
        top = first.filter(F.col("dist").isNotNull()).select("__qid", "__rid", "dist", *carry)
        # a query of a cell in several parts comes with a limit from each
        limits = first.filter(F.col("dist").isNull()).select("__qid", "__vec", "__h", "__cell", "__far")
        several = sorted({(p[0], p[5]) for p in plan if p[5] > 1})
        if several:
            several = F.broadcast(spark.createDataFrame(several, "__cell long, __parts long"))
            one = limits.join(several, "__cell", "left_semi").groupBy("__qid", "__vec", "__h", "__cell").agg(
                F.min("__far").alias("__far"), F.count(F.lit(1)).alias("__n")).join(several, "__cell")
            one = one.withColumn("__copy", F.explode(F.sequence(F.lit(1), (F.col("__n") / F.col("__parts")).cast("int")))).select(*limits.columns)
            limits = limits.join(several, "__cell", "left_anti").select(*limits.columns).unionByName(one)
        needed = keep(limits.mapInArrow(needs, "__group long, __cell long, __ord double, n long").groupBy("__group", "__cell")
                      .agg(F.min("__ord").alias("__ord"), F.sum("n").alias("n")), f"needed-{batch}")
        # one row a group
        per = needed.join(n_of, "__cell").groupBy("__group").agg(F.sum("__rows").alias("rows"), F.sum(F.col("n") * F.col("__rows")).alias("pairs")).orderBy("__group").collect()
        pairs += sum(r["pairs"] for r in per)
        runs = _runs([r["rows"] + int(asking[r["__group"]]) * -(-r["rows"] // PART) for r in per], at_once, WAVE_GROUPS) if per else []
        for start, end in runs:
            own = per[start:end]
            part = max(2 * BLOCK, min(PART, sum(r["rows"] for r in own) // (4 * cores)))
            plan, tiles = [], 0
            for r in own:
                parts = -(-r["rows"] // part)
                plan.append((r["__group"], tiles, parts))
                tiles += parts
            plan_df = F.broadcast(spark.createDataFrame(plan, "__group long, __base long, __parts long"))
            q_tiles = grouped(limits).join(plan_df, "__group").withColumn("__p", steps("__parts")).withColumn("__tile", F.col("__base") + F.col("__p"))
            # a cell's rows go to a part in blocks, so that each is compared in few matrix products
            block = F.pmod(F.xxhash64("__rid", F.lit(seed + 1)), F.ceil(F.col("__rows") / F.lit(BLOCK)).cast("long"))
            wanted = F.broadcast(needed.drop("n").join(plan_df, "__group"))     # at most WAVE_GROUPS x MAX_PIVOTS rows
            r_tiles = (assigned.join(n_of, "__cell").withColumn("__block", block).join(wanted, "__cell")
                       .withColumn("__tile", F.col("__base") + F.pmod(F.xxhash64("__cell", "__block"), F.col("__parts"))))
            others = _tiles(tiled(q_tiles, r_tiles), spread(tiles), k, exclude_same_id, cells, payload, False).select(*top.columns)
            if len(runs) > 1:
                others = keep(best(others).drop("nn_rank"), f"near-{batch}", "append")
            waves += 1
        if runs:
            top = top.unionByName(others)
        result = keep(best(top), "top", "append")
        for name in ("own", "needed", "near"):
            remove(spark, f"{folder}/{name}-{batch}")
    for name in ("shared", "marked", "refs", "queries"):
        remove(spark, f"{folder}/{name}")
    report.update(rounds=1 + bool(waves), visited=pairs / max(1, n_r * n_q), waves=waves, folder=folder)
    return (result.withColumnRenamed("__qid", q_id if q_id != r_id else "q_" + q_id)
            .withColumnRenamed("__rid", r_id if q_id != r_id else "r_" + r_id))


# ---------------------------------------------------------------------------
# k-nearest-neighbour classifier (uniform votes)
# ---------------------------------------------------------------------------

class KNNModel:
    def __init__(self, train: DataFrame, k: int, label: str, features: str, key: str | None = None):
        self.train, self.k, self.label, self.features, self.key = train, k, label, features, key

    def transform(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """Scores rows identified by a unique ``key`` column (the model's key
        by default): the rows are read twice, so the id must be stable."""
        from pyspark.ml.functions import array_to_vector, vector_to_array
        key = key or self.key
        if key is None or key not in df.columns:
            raise ValueError("kNN scoring needs a unique key column in the rows")
        q = df
        q = q.withColumn("__f", vector_to_array(F.col(self.features)))
        nn = knn(q, self.train, self.k, key, "__tid", "__f", carry=["__y"])
        qk = key if key != "__tid" else "q_" + key
        votes = nn.groupBy(qk).agg(F.avg(F.col("__y").cast("double")).alias("__p1"))
        # ties go to class 0, as an argmax over (class 0, class 1) does
        out = q.join(votes, q[key] == votes[qk] if qk != key else key).drop("__f")
        if qk != key:
            out = out.drop(qk)
        return (out.withColumn("prediction", (F.col("__p1") > 0.5).cast("double"))
                .withColumn("probability", array_to_vector(F.array(1 - F.col("__p1"), F.col("__p1"))))
                .drop("__p1"))


class KNNClassifier:
    """Neighbours at equal distance are taken by ``key``, without one by a hash of the row's content
    (rows that share it are alike), never by the partition they are in."""

    def __init__(self, k: int = 5, label: str = "label", features: str = "features", key: str | None = None):
        self.k, self.label, self.features, self.key = k, label, features, key

    def fit(self, df: DataFrame) -> KNNModel:
        from pyspark.ml.functions import vector_to_array
        order = F.col(self.key) if self.key else F.xxhash64(vector_to_array(F.col(self.features)), F.col(self.label))
        train = stored(df.select(order.alias("__tid"),
                                 vector_to_array(F.col(self.features)).alias("__f"),
                                 F.col(self.label).alias("__y")), scratch_dir(df.sparkSession, "knn-train"))
        return KNNModel(train, self.k, self.label, self.features, self.key)


# ---------------------------------------------------------------------------
# SMOTE + edited nearest neighbours
# ---------------------------------------------------------------------------

def smote(df: DataFrame, key: str, label: str, cols: list[str], ratio: float = 0.5, k: int = 5,
          seed: int = 0) -> DataFrame:
    """Adds ``int(ratio * n_maj) - n_min`` synthetic minority rows, each
    ``x + u * (nb - x)`` for a minority row x, one of its k nearest minority
    rows nb and u in [0, 1), all chosen by seeded hashes of the draw number."""
    new_rows = _synthetic(df, key, label, cols, ratio, k, seed)
    return df if new_rows is None else df.select(key, *cols, label).unionByName(new_rows)


def _synthetic(df: DataFrame, key: str, label: str, cols: list[str], ratio: float, k: int, seed: int, report: dict | None = None) -> DataFrame | None:
    from fraudframe.functions.ranking import index_sorted
    from fraudframe.operators.resample import RatioAlreadyReached, _minority_majority, class_counts
    counts = class_counts(df, label)
    mino, majo = _minority_majority(counts)
    if counts[mino] / counts[majo] > ratio:
        raise RatioAlreadyReached("minority/majority already above the target ratio")
    n_min = counts[mino]
    extra = int(ratio * counts[majo]) - n_min
    if extra <= 0:
        return None
    # neighbours are named by key and vector; the vectors are fetched for the drawn pairs only
    minority = _vec(df.filter(F.col(label) == mino), cols).withColumn("__vh", F.xxhash64("__vec"))
    nn = knn(minority, minority, k, key, key, cols, exclude_same_id=True, seed=seed, carry=["__vh"], report=report)
    near = nn.select(F.col("q_" + key).alias("__x"), "nn_rank", F.col("r_" + key).alias("__r"), F.col("__vh").alias("__rh"))
    idx = index_sorted(minority.select(F.xxhash64(F.col(key), F.lit(seed)).alias("__h"), key, "__vh"), ["__h", key], "__i").select(
        "__i", F.col(key).alias("__x"), F.col("__vh").alias("__xh"))
    vectors = minority.groupBy(F.col(key).alias("__k"), "__vh").agg(F.first("__vec").alias("__vec"))
    of = lambda k, h, name: vectors.select(F.col("__k").alias(k), F.col("__vh").alias(h), F.col("__vec").alias(name))
    spark = df.sparkSession
    u_bits = F.shiftright(F.xxhash64(F.col("id"), F.lit(seed + 7)), 11).cast("double")
    draws = spark.range(extra).select(
        F.col("id").alias("__draw"),
        F.pmod(F.xxhash64(F.col("id"), F.lit(seed + 5)), F.lit(n_min)).alias("__i"),
        (F.pmod(F.xxhash64(F.col("id"), F.lit(seed + 6)), F.lit(min(k, n_min - 1))) + 1).alias("nn_rank"),
        (F.pmod(u_bits, F.lit(float(1 << 53))) / F.lit(float(1 << 53))).alias("__u"))
    syn = (draws.join(idx, "__i").join(near, ["__x", "nn_rank"]).join(of("__x", "__xh", "__vec"), ["__x", "__xh"]).join(of("__r", "__rh", "__nb"), ["__r", "__rh"])
           .withColumn("__new", F.zip_with("__vec", "__nb", lambda a, b: a + F.col("__u") * (b - a))))
    key_type = df.schema[key].dataType.simpleString()
    return syn.select(
        # synthetic keys: negative, so they never collide with real ones
        (-(F.col("__draw") + 1)).cast(key_type).alias(key),
        *[F.col("__new")[i].alias(c) for i, c in enumerate(cols)],
        F.lit(mino).cast(df.schema[label].dataType).alias(label))


def edited_nearest_neighbours(df: DataFrame, key: str, label: str, cols: list[str], k: int = 3,
                              seed: int = 0) -> DataFrame:
    """Drops every row whose k nearest other rows do not all share its class."""
    base = df.withColumn("__y", F.col(label))
    nn = knn(base, base, k, key, key, cols, exclude_same_id=True, seed=seed, carry=["__y"])
    return _unanimous(base, nn, key)


def _unanimous(base: DataFrame, nn: DataFrame, key: str) -> DataFrame:
    votes = nn.groupBy(F.col("q_" + key).alias(key)).agg(F.collect_set("__y").alias("__classes"))
    keep = (base.join(votes, key, "left")
            .filter(F.coalesce(F.size("__classes") == 1, F.lit(True)) &
                    F.coalesce(F.element_at("__classes", 1) == F.col("__y"), F.lit(True))))
    return keep.drop("__classes", "__y")


def smote_enn(df: DataFrame, key: str, label: str, cols: list[str], ratio: float = 0.5, seed: int = 0) -> DataFrame:
    """The cleaned rows, stored.  ``df`` is read several times; of its rows only the result is written."""
    with setting(df.sparkSession, CONSTRAINTS, "false"):
        return _smote_enn(df, key, label, cols, ratio, seed)


def _smote_enn(df: DataFrame, key: str, label: str, cols: list[str], ratio: float, seed: int) -> DataFrame:
    spark, folder, found = df.sparkSession, scratch_dir(df.sparkSession, "smote-enn"), {}
    over = df
    new_rows = _synthetic(df, key, label, cols, ratio, 5, seed, found)
    if new_rows is not None:
        over = df.select(key, *cols, label).unionByName(stored(new_rows, f"{folder}/new"))
        remove(spark, found["folder"])
    base = over.withColumn("__y", F.col(label))
    nn = knn(base, base, 3, key, key, cols, exclude_same_id=True, seed=seed, carry=["__y"], report=found)
    # rows meet their votes in slices of about MOVED bytes
    slices = max(1, -(-base.count() * 8 * (len(over.columns) + 1) // MOVED))
    own = lambda c, i: F.pmod(F.xxhash64(F.col(c), F.lit(seed + 9)), F.lit(slices)) == i
    for i in range(slices):
        out = stored(_unanimous(base.filter(own(key, i)), nn.filter(own("q_" + key, i)), key), f"{folder}/rows", "append")
    for path in (found["folder"], f"{folder}/new"):
        remove(spark, path)
    return out
