"""Connected components of an edge table by alternating star contraction, with one written table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component) for every id that has an edge; component is the smallest id that it reaches.

    Edges point from a larger id ``u`` to a smaller ``v``. A large star links the larger neighbours of each id with the
    smallest of all its neighbours, a small star does so with the smaller ones; both are a minimum for each id and a join, so no
    group of neighbours is ever gathered in one place. Loops and null ends are left out. Rounds go with
    the logarithm of the longest path; a round that changes nothing ends them.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = written(edges, "edges")
    before = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # An edge (u, v) gives the larger end the least neighbour of the smaller one.
        large = edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        old, edges = edges, written(small, "edges")
        discard(old)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
