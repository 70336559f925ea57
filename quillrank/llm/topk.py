"""Exact top-k search in a pivot-distance index: the ``k`` nearest others of every query by Euclidean distance.

Index: vectors are keyed by (nearest pivot, distance to it) and sorted by that key into blocks of at most some ``block_rows``. A block is a
stretch of annuli around its pivots. Search: each query is first searched for in its own block, which bounds the
distance of its k-th neighbour. By the triangle inequality a vector x with pivot p at distance r is no nearer to q than
|d(q, p) - r|, and no nearer than (d(q, p) - d(q, p')) / 2 for any other pivot p'. A query goes on to those blocks alone whose bound
can beat its own. In a block the annuli of ``RING`` vectors are expanded in the order of those bounds, and the search stops when
no query can gain from the rest. All of this skips work only, so the result is exact whatever the pivots are.

A distance is the root of the squared differences added up in the order of the dimensions, in double precision, and ranks are by that
number, unrounded: the same bits come out wherever it is computed, at any scale. Faster products with an error bound only choose candidates.

What is broadcast are the pivots, ``max_pivots`` vectors whatever the table's size, and three numbers a block. A task holds one block and the
queries of another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import spread
from ._shared import cut, table

K = 10
MAX_PIVOTS = 128
BLOCK_ROWS = 40_000
RING = 1024
_BATCH = 1024
#: Queries are the rows whose id is divisible by this.
EVERY = 20
#: Numbers from this on have squares that don't fit in a double.
_LARGEST = 1e140
_LOOSE = 1 + 1e-9

_KEYED = "dim int, pivot int, dist double, vec_id long, embedding array<double>"


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([_matrix(c, dim) for c in column.chunks]) if column.num_chunks else np.zeros((0, dim))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, added up in the order of the dimensions; equal rows are at 0."""
    d = q - x
    d *= d
    total = np.zeros(len(d))
    for j in range(d.shape[1]):
        total += d[:, j]
    return np.sqrt(total)


def _doubt(q: np.ndarray, x: np.ndarray) -> float:
    """How far a square of ``_squares`` can be off."""
    return 1e-12 * (float((q * q).sum(1).max(initial=0)) + float((x * x).sum(1).max(initial=0)) + 1e-300)


class Best:
    """The ``k`` least (distance, id) so far for each query."""

    def __init__(self, n: int, k: int, limit: np.ndarray | None) -> None:
        self.d = np.full((n, k), np.inf)
        self.i = np.full((n, k), np.iinfo(np.int64).max)
        self.limit = np.full(n, np.inf) if limit is None else limit.copy()

    def take(self, rows: np.ndarray, query: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (rows[query], dist, ids), in any order."""
        k = self.d.shape[1]
        touched, code = np.unique(query, return_inverse=True)
        at = rows[touched]
        owner = np.concatenate([np.repeat(np.arange(len(touched)), k), code])
        d = np.concatenate([self.d[at].ravel(), dist])
        i = np.concatenate([self.i[at].ravel(), ids])
        order = np.lexsort((i, d, owner))
        first = np.searchsorted(owner[order], np.arange(len(touched)))
        pick = order[first[:, None] + np.arange(k)[None, :]]
        self.d[at], self.i[at] = d[pick], i[pick]
        self.limit[at] = np.minimum(self.limit[at], self.d[at, k - 1])


def search_block(queries: np.ndarray, query_ids: np.ndarray, limit: np.ndarray | None, x: np.ndarray, ids: np.ndarray, pivot: np.ndarray, dist: np.ndarray, pivots: np.ndarray, k: int, ring: int = RING) -> Best:
    """The nearest of the block's vectors (sorted by pivot and distance) for each query, of those within ``limit``; not a query's own id."""
    best = Best(len(queries), k, limit)
    cuts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]]) if len(x) else np.zeros(0, int)
    begins = np.concatenate([np.arange(a, b, ring) for a, b in zip(cuts, np.append(cuts[1:], len(x)))]) if len(x) else np.zeros(0, int)
    ends = np.minimum(np.append(begins[1:], len(x)), begins + ring)
    low, high, center = dist[begins], dist[ends - 1], pivot[begins]
    doubt = max(_doubt(queries, x), _doubt(queries, pivots))
    for a in range(0, len(queries), _BATCH):
        q, qid = queries[a : a + _BATCH], query_ids[a : a + _BATCH]
        to = np.sqrt(_squares(q, pivots))
        near = to.min(axis=1)
        bound = np.maximum(np.maximum(to[:, center] - high, low - to[:, center]), (to[:, center] - near[:, None]) / 2) / _LOOSE - 2 * np.sqrt(doubt)
        for r in np.argsort(bound.mean(axis=0), kind="stable"):
            rows = np.flatnonzero(bound[:, r] <= best.limit[a : a + len(q)])
            if not len(rows):
                continue
            part, part_ids = x[begins[r] : ends[r]], ids[begins[r] : ends[r]]
            square = _squares(q[rows], part)
            square[qid[rows][:, None] == part_ids[None, :]] = np.inf
            most = np.square(best.limit[a + rows]) * _LOOSE + doubt
            if len(part) > k:
                most = np.minimum(most, np.partition(square, k - 1, axis=1)[:, k - 1] * _LOOSE + 2 * doubt)
            near_q, near_x = np.nonzero(square <= most[:, None])
            finite = np.isfinite(square[near_q, near_x])
            near_q, near_x = near_q[finite], near_x[finite]
            if len(near_q):
                best.take(a + rows, near_q, _distances(q[rows[near_q]], part[near_x]), part_ids[near_x])
    return best


def _answer(best: Best, query_ids: np.ndarray) -> pa.Table:
    row, col = np.nonzero(np.isfinite(best.d))
    return pa.table({"vec_id": query_ids[row], "neighbour_id": best.i[row, col], "distance": best.d[row, col]})


def _block(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = t.sort_by([("pivot", "ascending"), ("dist", "ascending"), ("vec_id", "ascending")])
    asked = t.column("asked").to_numpy() if "asked" in t.column_names else np.zeros(len(t), bool)
    return _matrix(t.column("embedding"), t.column("dim")[0].as_py()), t.column("vec_id").to_numpy(), t.column("pivot").to_numpy(), t.column("dist").to_numpy(), asked


def top_k(vectors: DataFrame, k: int = K, queries: DataFrame | None = None, max_pivots: int = MAX_PIVOTS, block_rows: int = BLOCK_ROWS, ring: int = RING) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): for every query its ``k`` nearest others among all of ``vectors``, rank 1 first.

    ``vectors`` needs vec_id and embedding; other columns are ignored, whatever their names. ``queries`` (vec_id) names the rows that are searched
    for; without it, all are. Equal distances rank by id. Rows with a null id or
    embedding, and vectors that are empty or hold a null, NaN or a number of 1e140 or more are neither searched for nor found. Vectors
    of other lengths aren't compared. Rows that share a vec_id are one vector, the least as arrays compare. Fewer than k others give fewer rows,
    an empty table none. Ids of ``queries`` that ``vectors`` lacks give none; repeated ones count once.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    numbers = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"))
    good = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < _LARGEST), F.lit(False)))
    rows = rows.filter((F.size("embedding") > 0) & good).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    if queries is None:
        rows = rows.withColumn("asked", F.lit(True))
    else:
        asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct().withColumn("hit", F.lit(True))
        rows = rows.join(asked, "vec_id", "left").select("vec_id", "embedding", "dim", F.coalesce("hit", F.lit(False)).alias("asked"))
    rows = cut(rows, "vectors")
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    first = rows.select("dim", "vec_id", "embedding", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")).alias("r")).filter(F.col("r") <= max_pivots)
    held: dict[int, list] = {}
    for r in first.orderBy("dim", "r").collect():
        held.setdefault(r["dim"], []).append(r["embedding"])
    # no more than some sqrt(n) pivots: fewer vectors than pivots would leave empty annuli
    pivots = {d: np.array(v[: max(1, int(sizes[d] ** 0.5))]) for d, v in held.items()}
    shared = spark.sparkContext.broadcast(pivots)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                some = pa.table(batch).filter(pa.array(dims == d)).combine_chunks()
                x, p = _matrix(some.column("embedding"), int(d)), shared.value[int(d)]
                at = np.concatenate([_squares(x[a : a + 4096], p).argmin(axis=1) for a in range(0, len(x), 4096)])
                t = pa.table({"dim": some.column("dim"), "pivot": at.astype(np.int32), "dist": _distances(x, p[at]), "vec_id": some.column("vec_id"), "embedding": some.column("embedding"), "asked": some.column("asked")})
                yield from t.to_batches()

    # as many blocks as there are cores, where there are vectors enough for each
    total = sum(sizes.values())
    parts = max(sum(max(1, -(-n // block_rows)) for n in sizes.values()), min(spark.sparkContext.defaultParallelism, total // 4096), 1)
    index = rows.select("vec_id", "embedding", "dim", "asked").mapInArrow(keyed, _KEYED + ", asked boolean").repartitionByRange(parts, "dim", "pivot", "dist").withColumn("block", F.spark_partition_id())
    index = cut(index, "pivot-index")
    edges = index.groupBy("dim", "block", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high")).collect()
    bounds: dict[int, dict[int, list]] = {}
    for e in edges:
        bounds.setdefault(e["dim"], {}).setdefault(e["pivot"], []).append((e["low"], e["high"], e["block"]))
    # a pivot's blocks by distance: the ranges follow each other, so both ends ascend
    shared_bounds = spark.sparkContext.broadcast({d: {p: tuple(map(np.array, zip(*sorted(v)))) for p, v in own.items()} for d, own in bounds.items()})

    def own(key: tuple, t: pa.Table) -> pa.Table:
        x, ids, pivot, dist, asked = _block(t)
        return _answer(search_block(x[asked], ids[asked], None, x, ids, pivot, dist, shared.value[key[0].as_py()], k, ring), ids[asked])

    found = "vec_id long, neighbour_id long, distance double"
    near = cut(index.groupBy("dim", "block").applyInArrow(own, found), "own-block")
    limits = near.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("distance").alias("limit")).filter(F.col("n") == k).select("vec_id", "limit")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.table(batch)
            dims, home = t.column("dim").to_numpy(), t.column("block").to_numpy()
            limit = np.where(t.column("limit").is_null().to_numpy(), np.inf, t.column("limit").to_numpy())
            for d in np.unique(dims):
                some = np.flatnonzero(dims == d)
                mine = t.take(pa.array(some)).combine_chunks()
                q, p = _matrix(mine.column("embedding"), int(d)), shared.value[int(d)]
                to = np.sqrt(_squares(q, p))
                reach = limit[some] * _LOOSE + 2 * np.sqrt(_doubt(q, p))
                near_pivot = to.min(axis=1)
                goes: list[np.ndarray] = []
                for pivot, (low, high, block) in shared_bounds.value[int(d)].items():
                    open_rows = np.flatnonzero((to[:, pivot] - near_pivot) / 2 <= reach)
                    # blocks from the first whose far end is near enough to the last whose near end is
                    a = np.searchsorted(high, to[open_rows, pivot] - reach[open_rows], side="left")
                    b = np.searchsorted(low, to[open_rows, pivot] + reach[open_rows], side="right")
                    n = np.maximum(b - a, 0)
                    goes.append(np.stack([np.repeat(open_rows, n), block[spread(a, n)]]))
                pairs = np.unique(np.concatenate(goes, axis=1), axis=1)
                pairs = pairs[:, home[some][pairs[0]] != pairs[1]]
                if pairs.shape[1]:
                    yield from mine.take(pa.array(pairs[0])).append_column("target", pa.array(pairs[1].astype(np.int32))).select(["dim", "block", "target", "vec_id", "embedding", "limit"]).combine_chunks().to_batches()

    asking = index.filter("asked").join(limits, "vec_id", "left").select("dim", "block", "vec_id", "embedding", "limit")
    routes = cut(asking.mapInArrow(routed, "dim int, block int, target int, vec_id long, embedding array<double>, limit double"), "routed")
    meet = cut(routes.select("dim", "block", "target").distinct(), "meetings")
    held_in = index.drop("asked").withColumnRenamed("block", "target").join(meet, ["dim", "target"])

    def other(key: tuple, q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        d = key[0].as_py()
        x, ids, pivot, dist, _ = _block(t)
        limit = q.column("limit").to_numpy()
        limit = np.where(np.isnan(limit), np.inf, limit)
        qid = q.column("vec_id").to_numpy()
        return _answer(search_block(_matrix(q.column("embedding"), d), qid, limit, x, ids, pivot, dist, shared.value[d], k, ring), qid)

    far = routes.groupBy("dim", "block", "target").cogroup(held_in.groupBy("dim", "block", "target")).applyInArrow(other, found)
    by = Window.partitionBy("vec_id").orderBy("distance", "neighbour_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("vec_id", F.col("rank").cast("long").alias("rank"), "neighbour_id", "distance")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every row of ``embeddings`` whose id is divisible by ``EVERY``, among all rows; see ``top_k`` for nulls, ties and repeated rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, K, vectors.filter(F.col("vec_id") % EVERY == 0))


OP4_SQL = f"""
WITH pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id,
    sqrt(list_reduce(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)), lambda x, y: x + y)) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0
)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank, neighbour_id, distance
FROM pairs QUALIFY rank <= {K}
"""
