"""Exact top-k inner-product search of a query set against all rows.

Vectors are quantised to floor(scale * x).  Rows are dealt by vec_id to shards of
about ``shard_rows`` rows; every shard also receives the queries.  A task holds one
shard's matrix at a time and streams the queries past it in blocks: each tile is one
matrix product, from which the k best per query are selected.  Per-query lists are
then merged as a tree, ``fan_in`` lists at a time, so no task sees more than
``fan_in * k`` rows of a query.

Vectors that are null, empty or hold a null, NaN or infinite component take no part;
rows with a null vec_id neither.  Vectors are compared with vectors of the same length.
A row is known by its vec_id: the rows of one vec_id count as one vector (the
smallest), and a query is not matched with its own vec_id.  Ties go to the smaller
vec_id.  Scores are exact: tiles whose sums stay below 2^53 use the float unit,
others integers; a score outside the 64-bit range is held at its end.  An empty
table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, SCALE, SHARD_ROWS, MIN_SHARDS, FAN_IN, BLOCK = 10, 1024, 16384, 24, 32, 512
SCHEMA = "query_id long, vec_id long, score long, shard long"


def valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector"))
            .filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite))


def _quantise(column, dim: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat.reshape(-1, dim))


def _scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * q.shape[1]
    if bound < 2 ** 53:
        return (q @ m.T).astype(np.int64)
    if bound < 2 ** 62:
        return q.astype(np.int64) @ m.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    s = whole(q) @ whole(m).T
    return np.clip(s, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def tile_best(q_ids, q, ids, m, k: int):
    """Arrays (query, vec_id, score) of each query's k best rows; ids ascend."""
    s = _scores(q, m)
    own = np.searchsorted(ids, q_ids)
    mine = (own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == q_ids)
    n = len(ids)
    if float(np.abs(s).max(initial=0)) * n < 2 ** 62:
        # one number holds the score and, for ties, the place
        key = s * n + (n - 1 - np.arange(n))
        key[np.flatnonzero(mine), own[mine]] = -2 ** 63
        top = np.argpartition(-key, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), (len(q), n))
    else:
        top = np.array([np.lexsort((ids, -r.astype(object)))[:k + 1] for r in s]) if n else np.empty((len(q), 0), int)
    who = np.repeat(np.arange(len(q)), top.shape[1])
    at = top.ravel()
    keep = ~(mine[who] & (own[who] == at))
    who, at = who[keep], at[keep]
    return q_ids[who], ids[at], s[who, at]


def _tiles(k: int, scale: int, block: int):
    def run(batches):
        shard = dim = None
        ids, rows, queries, q_ids = [], [], [], []
        matrix = None

        def close():
            nonlocal matrix, ids
            if matrix is None:
                ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
                matrix = np.concatenate(rows) if rows else np.empty((0, dim or 1))
                order = np.lexsort((*matrix.T[::-1], ids)) if len(ids) and len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
                ids, matrix = ids[order], matrix[order]
                first = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.empty(0, bool)
                ids, matrix = ids[first], matrix[first]

        def tiles():
            nonlocal queries, q_ids
            if not q_ids:
                return
            close()
            q, names = np.concatenate(queries), np.concatenate(q_ids)
            queries, q_ids = [], []
            step = max(1, min(block, (1 << 22) // max(1, len(ids))))
            for lo in range(0, len(q) if len(ids) else 0, step):
                a, b, c = tile_best(names[lo:lo + step], q[lo:lo + step], ids, matrix, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(c), pa.array(np.full(len(a), shard, np.int64))],
                    ["query_id", "vec_id", "score", "shard"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            dims, kinds = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (dims[1:] != dims[:-1]) | (kinds[1:] != kinds[:-1])))
            for lo, hi in zip(cut, np.append(cut[1:], len(keys))):
                if (shard, dim) != (int(keys[lo]), int(dims[lo])):
                    yield from tiles()
                    shard, dim = int(keys[lo]), int(dims[lo])
                    ids, rows, matrix = [], [], None
                part = batch.slice(lo, hi - lo)
                names, values = part.column(3).to_numpy(), _quantise(part.column(4), dim, scale)
                if kinds[lo] == 0:
                    ids.append(names)
                    rows.append(values)
                else:
                    q_ids.append(names)
                    queries.append(values)
                    if sum(map(len, q_ids)) >= block:
                        yield from tiles()
        yield from tiles()

    return run


def top_k(df: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
          shard_rows: int = SHARD_ROWS, min_shards: int = MIN_SHARDS, fan_in: int = FAN_IN) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of every query's k best rows.

    ``is_query`` is a condition on the column vec_id.  Only the row count reaches the
    driver; it sets the number of shards.
    """
    rows = valid(df, vec_id, vector)
    shards = max(min_shards, -(-df.count() // shard_rows))
    data = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.size("vector").alias("dim"),
                       F.lit(0).alias("kind"), "vec_id", "vector")
    # a query whose vec_id has several rows is their smallest vector, as for the rows
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min(F.struct(F.size("vector").alias("n"), "vector")).alias("v"))
    queries = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                           F.col("v.n").alias("dim"), F.lit(1).alias("kind"), "vec_id", F.col("v.vector").alias("vector"))
    tagged = data.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "kind")
    best = tagged.mapInArrow(_tiles(k, scale, BLOCK), SCHEMA)
    order = [F.col("score").desc(), F.col("vec_id").asc()]
    lists = shards
    while lists > 1:  # merge the lists of fan_in neighbours
        best = best.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("long"))
        w = Window.partitionBy("query_id", "shard").orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        lists = -(-lists // fan_in)
    if shards == 1:
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return best.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
