"""Nearest neighbours by a block matrix join with int8 tiles (operator 5).

Candidates are gathered into tiles, tiles dealt in turn into groups of bounded
size, and each tile is shipped once, to its group.  Blocks of queries are copied to
every group and follow its tiles, which the task holds: the bytes moved are those of the
vectors plus those of the queries times the number of groups, and a block meets one tile
after the other with the distances found so far.  Vectors are quantised
to int8 with a scale of their own; the norm of what is lost bounds the error of every
distance.  A tile product gives all quantised distances at once; a candidate survives
if its lower bound does not exceed the k-th smallest distance of the query so far (its
k-th smallest upper bound in the tile, as long as there are fewer than k).
Survivors are computed in double precision from the original vectors, which the tile
holds as well: copies of one vector tie within any bound, and only the exact distance
and id tell, inside the task, which of them to drop.  They are merged in heaps in the
task, then per query.  The result is exact.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows with a null id; vectors of other lengths
are never compared; rows with the query's own id are not its neighbours; repeated
rows are candidates each, and a repeated query is asked once (with its smallest vector);
distances whose squares overflow are computed after scaling; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wayline.llm.common import table

#: Candidates of a tile and queries of a block at most (fewer if vectors are long): what a task holds at a time.
TILE, BLOCK, NUMBERS = 1024, 1024, 1 << 17
#: Candidates of a group: as many as keep all tasks busy, within these bounds (and so many numbers: a task holds them).
SMALL_GROUP, LARGE_GROUP, GROUP_NUMBERS = 2048, 131072, 1 << 23
#: Pairs whose exact distances are computed at a time, in numbers.
EXACT_NUMBERS = 1 << 20
#: Squared norms within which products are computed in single precision.
PLAIN = 1e-20, 1e20
#: Queries whose heaps a task holds before it hands them on.
HELD = 16384


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scales, norms of the quantisation errors) of rows of doubles."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(float).tiny)
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` from ``y``; scaled first where squares overflow."""
    diff = x - y
    out = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])
    for i in np.flatnonzero(~np.isfinite(out)):
        most = np.abs(diff[i]).max()
        if np.isfinite(most):
            out[i] = most * np.sqrt(np.cumsum((diff[i] / most) ** 2)[-1])
    return out


def _tiles(rows: DataFrame, groups: int, stored: str) -> DataFrame:
    """Rows (id, v, dim) gathered into tiles (g, dim, ids, raw), dealt in turn to the groups."""
    def run(batches):
        n = TaskContext.get().partitionId()
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                size = max(1, min(TILE, NUMBERS // int(d)))
                for at in range(0, own.num_rows, size):
                    part = own.slice(at, size)
                    raw = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(stored)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n % groups], type=pa.int32()), pa.array([int(d)], type=pa.int32()),
                         pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], type=pa.binary()),
                         pa.array([raw.tobytes()], type=pa.binary())], names=["g", "dim", "ids", "raw"])
                    n += 1
    return rows.select("id", "v", "dim").mapInArrow(run, "g int, dim int, ids binary, raw binary")


class Tile:
    """Ids and vectors with their int8 values, scales and errors; ``q``, ``scale`` and ``error`` as of :func:`quantise`."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        with np.errstate(over="ignore", invalid="ignore"):
            self.q, self.scale, self.error = quantise(x)
            short = self.q * self.scale[:, None]
            self.norm = (short ** 2).sum(axis=1)
            self.most = self.norm.max()
            self.plain = PLAIN[0] < self.most < PLAIN[1]
            self.short = short.astype(np.float32)


def _first(best: list[list], rows: np.ndarray, tile: Tile, block: Tile, k: int) -> None:
    """Merge a tile into the heaps of some queries by the bounds of every pair."""
    with np.errstate(over="ignore", invalid="ignore"):
        ids, x, qids = tile.ids, tile.x, block.ids[rows]
        exact = np.float32 if x.shape[1] <= 1024 else np.float64  # integer sums stay exact
        dot = (block.q[rows].astype(exact) @ tile.q.astype(exact).T).astype(np.float64) * (block.scale[rows, None] * tile.scale[None, :])
        nx, ny = tile.norm, block.norm[rows]
        near = np.sqrt(np.maximum(ny[:, None] + nx[None, :] - 2 * dot, 0))
        error = block.error[rows, None] + tile.error[None, :] + 1e-6 * np.sqrt(ny[:, None] + nx[None, :]) + 1e-150  # and rounding
        upper, lower = near + error, near - error
        # bounds that overflow say nothing
        vague = ~(np.isfinite(upper) & np.isfinite(lower))
        upper[vague], lower[vague] = np.inf, -np.inf
        upper[qids[:, None] == ids[None, :]] = np.inf
        limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(qids), np.inf)
        for i, (row, q) in enumerate(zip(rows.tolist(), qids.tolist())):
            heap = best[row]
            most = min(limit[i], -heap[0][0] * (1 + 1e-12)) if len(heap) == k else limit[i]
            pick = np.flatnonzero((lower[i] <= most) & (ids != q))
            if not len(pick):
                continue
            for d, v in zip(distances(x[pick], block.x[row]).tolist(), ids[pick].tolist()):
                item = (-d, -v)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)


def _join_tile(best: dict, tile: Tile, block: Tile, k: int) -> None:
    """Merge the k nearest of one tile into the heaps (of negated distance and id) of one block's queries."""
    heaps = [best.setdefault(q, []) for q in block.ids.tolist()]
    full = np.array([len(h) == k for h in heaps])
    if not (tile.plain and block.plain):
        full[:] = False
    if not full.all():
        _first(heaps, np.flatnonzero(~full), tile, block, k)
    rows = np.flatnonzero(full)
    if not len(rows):
        return
    with np.errstate(over="ignore", invalid="ignore"):
        kth = -np.array([heaps[i][0][0] for i in rows.tolist()])
        norm, dim = block.norm[rows], block.x.shape[1]
        # one bound a query: the largest error and norm of the tile, and the rounding of sums in single precision
        far = kth * (1 + 1e-12) + block.error[rows] + tile.error.max() + 1e-6 * np.sqrt(norm + tile.most) + 1e-150
        least = (norm - far * far) / 2 - (dim + 8) * 1.2e-7 * (norm + tile.most)
        product = block.short[rows] @ tile.short.T
        product -= (tile.norm / 2).astype(np.float32)
        hit = product >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]
    i, j = np.divmod(np.flatnonzero(hit), hit.shape[1])
    other = tile.ids[j] != block.ids[rows[i]]
    i, j = i[other], j[other]
    step = max(1, EXACT_NUMBERS // dim)
    for at in range(0, len(i), step):
        a, b = i[at:at + step], j[at:at + step]
        with np.errstate(over="ignore", invalid="ignore"):
            d = distances(tile.x[b], block.x[rows[a]])
        keep = np.flatnonzero(d <= kth[a])
        for row, e, v in zip(rows[a[keep]].tolist(), d[keep].tolist(), tile.ids[b[keep]].tolist()):
            if (-e, -v) > heaps[row][0]:
                heapq.heapreplace(heaps[row], (-e, -v))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every row for which ``is_query`` holds."""
    v = F.col(vec).cast("array<double>")
    good = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q"))
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    n, asked, longest = rows.agg(F.count("*"), F.count_if("q"), F.max("dim")).first()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = max(1, min(LARGE_GROUP, GROUP_NUMBERS // (longest or 1)))
    groups = max(1, math.ceil(n / large), min(tasks, math.ceil(n / SMALL_GROUP)))
    blocks = max(1, math.ceil(asked / max(1, min(BLOCK, NUMBERS // (longest or 1)))))
    single = isinstance(vectors.schema[vec].dataType.elementType, T.FloatType)  # such numbers are moved as they are
    number, stored = ("float", "<f4") if single else ("double", "<f8")
    gathered = (queries.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("dim"), "id", "v")
                .groupBy("block", "dim").agg(F.collect_list(F.struct("id", F.col("v").cast(f"array<{number}>").alias("v"))).alias("rows"))  # about BLOCK rows each
                .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    none = {"qids": "array<bigint>", "qv": f"array<array<{number}>>"}
    tiles = _tiles(rows, groups, stored).select("g", "dim", F.lit(-1).alias("block"), "ids", "raw", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    paired = (tiles.union(gathered.select("g", "dim", "block", F.lit(None).cast("binary"), F.lit(None).cast("binary"), "rows.id", "rows.v"))
              .repartition(max(tasks, groups), "g", "dim").sortWithinPartitions("g", "dim", "block"))  # a group's tiles come first

    def handed(best):
        q, v, d = zip(*[(q, -v, -d) for q, heap in best.items() for d, v in heap])
        return pa.RecordBatch.from_arrays([pa.array(q, type=pa.int64()), pa.array(v, type=pa.int64()), pa.array(d, type=pa.float64())],
                                          names=["query_id", "vec_id", "score"])

    def run(batches):
        best: dict[int, list] = {}
        own, tiles = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                g, dim, block = (batch.column(c)[i].as_py() for c in range(3))
                if own != (g, dim):
                    own, tiles = (g, dim), []
                if block < 0:
                    tiles.append(Tile(np.frombuffer(batch.column(3)[i].as_buffer(), dtype="<i8").copy(),
                                      np.frombuffer(batch.column(4)[i].as_buffer(), dtype=stored).reshape(-1, dim).astype("<f8")))
                    continue
                asked = Tile(batch.column(5)[i].values.to_numpy(zero_copy_only=False),
                             batch.column(6)[i].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("<f8"))
                for tile in tiles:
                    _join_tile(best, tile, asked, k)
                if len(best) > HELD and any(best.values()):
                    yield handed(best)
                    best = {}
        if any(best.values()):
            yield handed(best)

    found = paired.mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")  # k rows from each task
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_block_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every vector whose id is divisible by 100, among all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
             sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))) AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
