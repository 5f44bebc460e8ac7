"""Exact top-k search by inner product with a KD-tree for each shard of the vectors."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, written
from .vectors import usable


class KDTree:
    """Median splits of the widest dimension down to small leaves; every node has the tight box of its points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 64):
        self.order = np.arange(len(points))
        self.points, self.ids = points, ids
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.range: list[tuple[int, int]] = []
        todo = [(0, len(points), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            part = points[self.order[lo:hi]]
            node = len(self.range)
            self.low.append(part.min(axis=0))
            self.high.append(part.max(axis=0))
            self.range.append((lo, hi))
            self.children.append(None)
            if parent >= 0:
                known = self.children[parent]
                self.children[parent] = (node, -1) if known is None else (known[0], node)
            widest = int(np.argmax(self.high[-1] - self.low[-1]))
            if hi - lo > leaf and self.high[-1][widest] > self.low[-1][widest]:
                mid = (lo + hi) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(part[:, widest], mid - lo)]
                todo += [(mid, hi, node), (lo, mid, node)]
        self.points, self.ids = points[self.order], ids[self.order]
        self.low_m, self.high_m = np.stack(self.low), np.stack(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): the largest inner product that a point in the node's box can have."""
        return np.maximum(queries, 0) @ self.high_m.T + np.minimum(queries, 0) @ self.low_m.T

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, kth: float, own: int) -> list[tuple[int, int]]:
        """The best k (score, -id) at least as good as ``kth``, by descent into the box with the highest bound first."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            children = self.children[node]
            if children is not None:
                for child in children:
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            lo, hi = self.range[node]
            scores = self.points[lo:hi] @ query
            for i in np.flatnonzero(scores >= kth).tolist():
                item = (int(scores[i]), -int(self.ids[lo + i]))
                if -item[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return best


def quantized(column: str, scale: int) -> Column:
    """floor(scale * x) of every component, with x as double."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def top_k(vectors: DataFrame, *, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int | None = None, query_rows: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): the ``k`` best other rows of each query row, by inner product of the quantized vectors.

    Equal scores go to smaller ids; a query with fewer than k others gets all. Vectors that are null, empty, or hold null or
    non-finite components take no part. Of equal vectors only the k + 1 smallest ids can be among the best, so the
    others are left out first, which keeps a vector of many copies from filling a shard. Repeated rows are candidates each, so that one id
    may fill several ranks (k copies at most are looked at), and one query; rows of the query's id are never its candidates. Vectors of different lengths have no score with each other. Scores of 2**53 or more, which a
    double can't hold exactly, fail. An empty table gives none.

    Candidates are dealt to shards by a hash, each with a KD-tree, and queries to blocks: first each query meets one shard,
    then, with the kth score found there, all others, where boxes whose bound is under the kth score are passed over. Shards and blocks
    both grow with the root of the number of rows (unless ``shard_rows`` and ``query_rows`` are given), so vectors are copied about
    as often as the root of that number, and a task holds as many. No shard's or query's share depends on how values are spread.
    """
    spark = vectors.sparkSession
    given = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantized(vector_col, scale).alias("v"), F.size(vector_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q"))
    vectors_table = given = written(given.groupBy("id", "v", "dim", "q").agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("v")), "vectors")
    first = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    few = given.withColumn("n", first).where(F.col("n") <= k + 1)
    n = given.count()
    if n == 0:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    shard_rows = shard_rows or max(4096, 4 * math.isqrt(n))
    shards = max(1, -(-n // shard_rows))
    shard = F.pmod(F.xxhash64("h", "id"), F.lit(shards)).cast("int")
    each = F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))).alias("copy")
    candidates = written(few.select(shard.alias("shard"), "dim", "id", "v", each).drop("copy"), "candidates")
    queries = given.where("q").select(F.col("id").alias("query_id"), "dim", "v", shard.alias("home"), F.xxhash64("id", F.lit("block")).alias("b"))
    asked_table = queries = written(queries, "queries")
    query_rows = query_rows or max(4096, 4 * math.isqrt(n))
    blocks = max(1, -(-queries.count() // query_rows))
    queries = queries.withColumn("block", F.pmod("b", F.lit(blocks)).cast("int")).drop("b")
    repeated = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    out = "query_id long, id long, score long"

    def search(key, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(asked):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")
        largest = [math.sqrt(max(float(np.dot(v, v)) for v in np.stack(t["v"].to_numpy()).astype(np.float64))) for t in (points, asked)]
        if largest[0] * largest[1] >= 2.0**53:
            raise ValueError("inner products of 2**53 and more are not exact in double precision")
        tree = KDTree(np.stack(points["v"].to_numpy()).astype(np.float64), points["id"].to_numpy(np.int64))
        rows = []
        for at in range(0, len(asked), 256):
            part = asked.iloc[at : at + 256]
            q = np.stack(part["v"].to_numpy()).astype(np.float64)
            for i, (own, kth, bounds) in enumerate(zip(part["query_id"].tolist(), part["kth"].tolist(), tree.bounds(q))):
                rows += [(own, -neg, score) for score, neg in tree.search(q[i], bounds, k, kth, own)]
        return pd.DataFrame(rows, columns=["query_id", "id", "score"]).astype("int64")

    key = ["dim", "shard", "block"]

    def at_shards(asked: DataFrame) -> DataFrame:
        return repeated.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, out)

    lowest = F.lit(float("-inf"))
    near = written(at_shards(queries.select("dim", F.col("home").alias("shard"), "block", "query_id", "v", lowest.alias("kth"))), "near")
    kths = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
    others = queries.join(kths, "query_id", "left").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", "block", "home", "query_id", "v", F.coalesce("kth", lowest).alias("kth")).where("shard != home")
    found = near.union(at_shards(others.select("dim", "shard", "block", "query_id", "v", "kth")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = written(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score"), "best")
    discard(vectors_table, candidates, asked_table, near)
    return best


ORACLE_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select distinct vec_id, q from v where vec_id % 50 = 0),
s as (select a.vec_id as query_id, b.vec_id as vec_id, list_dot_product(a.q::double[], b.q::double[])::bigint as score
      from a, v b where a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
