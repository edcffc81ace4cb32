"""Exact top-k inner products: a ball tree per shard, best bound first, with a shared k-th score.

Rows are dealt to shards of about `SHARD` vectors by a hash of their id, so equal vectors spread. Queries come in blocks
of about `QUERY_BLOCK`; a block is the only thing that is broadcast. The first shard of a block gives every query a k-th
score that no better result can fall below; all shards start from it and stop where a node's bound is under the
k-th score seen so far. Scores are exact integers, ties go to the smaller id.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id. Vectors of
different lengths don't meet. A row with the query's id and vector is the query's own, and the same id and vector asks once; rows
with its id and another vector are candidates, as are all repeats of other rows. Scores beyond a long wrap around. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARD = 4096
QUERY_BLOCK = 8192
LEAF = 64


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v array<long>: floor(scale * component) of every vector that takes part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


class Tree:
    """A ball tree over the rows of an integer matrix; nodes are slices of `order`."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.centers, self.radii, self.span, self.kids = [], [], [], []
        self._grow(0, len(points))
        self.centers, self.radii = np.array(self.centers), np.array(self.radii)

    def _grow(self, a: int, b: int) -> int:
        own = self.points[self.order[a:b]]
        center = own.mean(axis=0)
        k = len(self.span)
        self.centers.append(center)
        self.radii.append(np.sqrt(((own - center) ** 2).sum(axis=1).max()) * (1 + 1e-9) + 1e-9)
        self.span.append((a, b))
        self.kids.append(None)
        spread = own.max(axis=0) - own.min(axis=0)
        axis = int(spread.argmax())
        if b - a > LEAF and spread[axis] > 0:
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], half)]
            self.kids[k] = (self._grow(a, a + half), self._grow(a + half, b))
        return k

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product, query by node, with room for rounding."""
        size = np.sqrt((queries**2).sum(axis=1))
        out = queries @ self.centers.T + size[:, None] * self.radii[None, :]
        return out + 1e-9 * np.abs(out) + 1e-3


def search(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
    """For each query, (query row, ids, scores) of the best k of this shard that are not under its floor."""
    tree = Tree(points)
    exact = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * points.shape[1] < 2**52
    near = tree.points[tree.order] if exact else points[tree.order]
    names = ids[tree.order]
    asked = queries.astype(np.float64)
    for low in range(0, len(queries), 512):
        bounds = tree.bounds(asked[low : low + 512])
        for r in range(len(bounds)):
            q = low + r
            bound, vector = bounds[r], asked[q] if exact else queries[q]
            best_s, best_i = np.empty(0, np.int64), np.empty(0, np.int64)
            least = floors[q]
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if -top < least:
                    break
                if tree.kids[node]:
                    for kid in tree.kids[node]:
                        if bound[kid] >= least:
                            heapq.heappush(heap, (-bound[kid], kid))
                    continue
                a, b = tree.span[node]
                scores = (near[a:b] @ vector).astype(np.int64)
                keep = scores >= least
                for i in np.flatnonzero(keep & (names[a:b] == query_ids[q])).tolist():
                    keep[i] = not np.array_equal(points[tree.order[a + i]], queries[q])
                if not keep.any():
                    continue
                best_s, best_i = np.concatenate([best_s, scores[keep]]), np.concatenate([best_i, names[a:b][keep]])
                if len(best_s) > k:
                    first = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[first], best_i[first]
                if len(best_s) == k:
                    least = max(least, int(best_s.min()))
            if len(best_s):
                yield q, best_i, best_s


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: both inputs as (vec_id, v array<long>)."""
    spark = vectors.sparkSession
    n = vectors.count()
    shards = max(1, -(-n // SHARD))
    dealt = vectors.withColumns({"shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)), "dim": F.size("v")})
    asked = cut(queries.dropDuplicates(["vec_id", "v"]))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = [one_block(dealt, asked.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)) == b), k) for b in range(blocks)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def one_block(dealt: DataFrame, queries: DataFrame, k: int) -> DataFrame | None:
    spark = dealt.sparkSession
    rows = sorted((r.vec_id, tuple(r.v)) for r in queries.collect())  # a block
    if not rows:
        return None
    by_dim = {}
    for at, (i, v) in enumerate(rows):
        by_dim.setdefault(len(v), []).append((at, i, v))
    packed = {d: (np.array([x[0] for x in own]), np.array([x[1] for x in own], np.int64), np.array([x[2] for x in own], np.int64)) for d, own in by_dim.items()}

    def searcher(shared):
        def run(group: pa.Table) -> pa.Table:
            blocks, floors = shared.value
            ids = group.column("vec_id").to_numpy()
            flat = group.column("v").combine_chunks().flatten().to_numpy()
            points = flat.reshape(len(ids), -1)
            out: list[list[np.ndarray]] = [[], [], [], []]
            if points.shape[1] in blocks:
                at, query_ids, asked = blocks[points.shape[1]]
                for q, names, scores in search(ids, points, query_ids, asked, floors[at], k):
                    for col, x in zip(out, (np.full(len(names), query_ids[q]), np.full(len(names), at[q]), names, scores), strict=True):
                        col.append(x)
            cols = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out]
            return pa.Table.from_arrays(cols, names=["query_id", "asked", "vec_id", "score"])

        return run

    schema = "query_id long, asked long, vec_id long, score long"
    lowest = np.full(len(rows), np.iinfo(np.int64).min)
    first = spark.sparkContext.broadcast((packed, lowest))
    seed = dealt.where("shard = 0").groupBy("shard", "dim").applyInArrow(searcher(first), schema)
    kth = seed.groupBy("asked").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
    floors = lowest.copy()
    for r in kth.collect():  # at most one row for each query of the block
        floors[r.asked] = r.score
    shared = spark.sparkContext.broadcast((packed, floors))
    return dealt.groupBy("shard", "dim").applyInArrow(searcher(shared), schema)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
