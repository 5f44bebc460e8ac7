"""Near-duplicate vectors by range search in a robust-pruned flat graph, built on overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, written
from .components import connected_components
from .flat_graph import build, range_search
from .vectors import matrix, usable


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, clusters: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(clusters, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least point of each point's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _nearest(vectors: np.ndarray, centres: np.ndarray, overlap: int) -> np.ndarray:
    """The ``overlap`` nearest centres of each vector, in ascending order of their numbers."""
    s = _unit(vectors) @ centres.T
    m = min(overlap, s.shape[1])
    return np.sort(np.argpartition(-s, m - 1, axis=1)[:, :m], axis=1).astype(np.int32)


def _fitted(vectors: np.ndarray, width: int) -> np.ndarray:
    """Rows cut or filled with zeros to ``width``: only for choosing cells."""
    return np.pad(vectors[:, :width], ((0, 0), (0, max(0, width - vectors.shape[1]))))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batch's rows and vectors, those of each length together."""
    lengths = batch.column("dim").to_numpy()
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, matrix(batch.column("v").take(pa.array(rows)))


def _numbered(lists: pd.Series, reps: np.ndarray) -> np.ndarray:
    """Lists of reps as a table of their places in ``reps``, filled with -1; reps that are not there are left out."""
    order = np.argsort(reps)
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate(lists.to_numpy()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(reps[order], flat), len(reps) - 1)
    here = reps[order][at] == flat
    row = np.repeat(np.arange(len(lists)), sizes)[here]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.full((len(lists), max(1, int(place.max(initial=0)) + 1)), -1)
    out[row, place] = order[at[here]]
    return out


def _linked(points: DataFrame, centres: np.ndarray, overlap: int, shard_rows: int, threshold: float, exact: bool = False) -> DataFrame:
    """(rep, n, other): links found by shard; n counts linked vectors with their copies, other is a member of the same component.

    With ``exact`` all vectors are in one cell, and every two of its shards are compared as a whole.
    """
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list = [None] * batch.num_rows
            for rows, x in _by_length(batch):
                near = np.zeros((len(x), 1), np.int32) if exact else _nearest(_fitted(x, shared.value.shape[1]), shared.value, overlap)
                for r, c in zip(rows.tolist(), near):
                    cells[r] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    cells = written(points.mapInArrow(assign, "rep long, copies long, dim int, v array<double>, cells array<int>"), "cells")
    members = cells.withColumn("cell", F.explode("cells"))
    # A cell with more members than a shard holds is dealt to several by a hash; every two of its shards are searched.
    parts = members.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    members = written(members.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")), "members")

    def graph(shard: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(shard["v"].to_numpy()).astype(np.float64)).astype(np.float32)
        links, _ = build(x)
        reps = shard["rep"].to_numpy(np.int64)
        return pd.DataFrame({"rep": reps, "near": [reps[a] for a in links]})

    if exact:
        nodes = members.withColumn("near", F.array().cast("array<bigint>"))
    else:
        edges = members.select("dim", "cell", "part", "rep", "v").groupBy("dim", "cell", "part").applyInPandas(graph, "rep long, near array<long>")
        union = edges.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        nodes = written(members.join(union, "rep"), "nodes")

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        _, cell, i, j = key
        if not len(right) or (i != j and not len(left)):
            return pd.DataFrame({"rep": [], "n": [], "other": []}).astype("int64")
        asked = right if i == j else left
        full = _unit(np.stack(right["v"].to_numpy()).astype(np.float64))
        full_q = full if i == j else _unit(np.stack(left["v"].to_numpy()).astype(np.float64))
        reps, asked_reps = right["rep"].to_numpy(np.int64), asked["rep"].to_numpy(np.int64)
        if exact:
            pairs = [np.nonzero(full_q[lo : lo + 256] @ full.T >= threshold - 1e-9) for lo in range(0, len(full_q), 256)]
        else:
            x, q = full.astype(np.float32), full_q.astype(np.float32)
            links, medoid = _numbered(right["near"], reps), int(np.argmax(x @ x.mean(axis=0)))
            pairs = [range_search(x, links, medoid, q[lo : lo + 256], threshold - 1e-4) for lo in range(0, len(q), 256)]
        a = np.concatenate([p[0] + 256 * k for k, p in enumerate(pairs)])
        b = np.concatenate([p[1] for p in pairs])
        if i == j:
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            pair = np.unique(a * len(full) + b)
            a, b = pair // len(full), pair % len(full)
        ok = np.concatenate([np.einsum("pd,pd->p", full_q[a[k : k + 50_000]], full[b[k : k + 50_000]]) >= threshold for k in range(0, len(a), 50_000)] or [np.zeros(0, bool)])
        a, b = a[ok], b[ok]
        # A pair that meets in several cells counts in the smallest of them.
        cells_a, cells_b = np.stack(asked["cells"].to_numpy()), np.stack(right["cells"].to_numpy())
        mine = np.ones(len(a), bool)
        for k in range(0, len(a), 50_000):
            ca, cb = cells_a[a[k : k + 50_000]], cells_b[b[k : k + 50_000]]
            common = np.where((ca[:, :, None] == cb[:, None, :]).any(axis=2), ca, np.iinfo(np.int32).max).min(axis=1)
            mine[k : k + 50_000] = common == cell
        na = np.bincount(a[mine], weights=right["copies"].to_numpy()[b[mine]], minlength=len(asked))
        nb = np.bincount(b[mine], weights=asked["copies"].to_numpy()[a[mine]], minlength=len(right))
        if i == j:
            label = _components(len(full), a, b)
            return pd.DataFrame({"rep": reps, "n": (na + nb).astype(np.int64), "other": reps[label]})
        label = _components(len(full_q) + len(full), a, b + len(full_q))
        both = np.concatenate([asked_reps, reps])
        return pd.DataFrame({"rep": both, "n": np.concatenate([na, nb]).astype(np.int64), "other": both[label]})

    shown = ["dim", "cell", "i", "j", "rep", "copies", "v", "cells"]
    right = nodes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("part")))).withColumn("j", F.col("part")).select(*shown, "near")
    left = nodes.where("part + 1 < parts").withColumn("j", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1))).withColumn("i", F.col("part")).select(*shown)
    key = ["dim", "cell", "i", "j"]
    found = written(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "rep long, n long, other long").where("n > 0 or rep != other"), "links")
    discard(cells, members, *([] if exact else [nodes]))
    return found


def _audit(points: DataFrame, sample: list, centres: np.ndarray, overlaps: list[int], threshold: float) -> dict[int, tuple[int, list[int]]]:
    """For a few vectors the number of all others (copies counted) that link with them, and how many of these share a cell at each overlap.

    The few are compared with every row, in the tasks that read the rows.
    """
    reps = np.array([r["rep"] for r in sample])
    own = {d: np.flatnonzero([len(r["v"]) == d for r in sample]) for d in {len(r["v"]) for r in sample}}
    asked = {d: _unit(np.array([sample[k]["v"] for k in rows], np.float64)) for d, rows in own.items()}
    cells = {d: [_nearest(_fitted(q, centres.shape[1]), centres, m) for m in overlaps] for d, q in asked.items()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(reps), 1 + len(overlaps)), np.int64)
        for batch in batches:
            for rows, x in _by_length(batch):
                d = x.shape[1]
                if d not in own:
                    continue
                a, b = np.nonzero(_unit(x) @ asked[d].T >= threshold)
                other = batch.column("rep").to_numpy()[rows[a]] != reps[own[d][b]]
                a, b = a[other], b[other]
                if not len(a):
                    continue
                copies = batch.column("copies").to_numpy()[rows[a]]
                np.add.at(total[:, 0], own[d][b], copies)
                some, at = np.unique(a, return_inverse=True)
                fitted = _fitted(x[some], centres.shape[1])
                for k, m in enumerate(overlaps):
                    shares = (_nearest(fitted, centres, m)[at][:, :, None] == cells[d][k][b][:, None, :]).any(axis=(1, 2))
                    np.add.at(total[:, 1 + k], own[d][b[shares]], copies[shares])
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(list(total), pa.list_(pa.int64()))], names=["rep", "n"])

    sums = [F.sum(F.get("n", F.lit(k))).alias(f"n{k}") for k in range(1 + len(overlaps))]
    rows = points.mapInArrow(compare, "rep long, n array<long>").groupBy("rep").agg(*sums).collect()
    return {r["rep"]: (r["n0"], list(r[2:])) for r in rows}


def near_duplicate_vectors(
    vectors: DataFrame, *, threshold: float = 0.9, cluster_rows: int = 500, most_clusters: int = 4096, sample_rows: int = 20_000, overlap: int = 2, shard_rows: int = 2048, audit_rows: int = 200, audit_linked: int = 30, least_recall: float = 0.98,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row (id_col, n_links, component_id, kept, recall, audited_links) for each row of ``vectors``.

    Vectors link if their cosine in double precision is at least ``threshold``. Null, empty and zero vectors, and those that
    hold null or non-finite components, link with nothing; nor do vectors of different lengths with each other. Equal vectors link and
    count as one from the start. Rows that share an id but not a vector are vectors of their own, with their own links.

    Each vector belongs to its nearest clusters, which are fitted on at most ``sample_rows`` vectors; a graph is built on each cluster's shards,
    each vector's adjacency lists are united, and every vector searches its clusters' shards. Links found are verified. Beyond
    ``most_clusters`` clusters grow with the input and are dealt to more shards, every two of which meet.

    ``audit_rows`` vectors, and four and sixteen times as many while fewer than ``audit_linked`` of them have links, are compared with all rows. The
    overlap is the least of ``overlap`` and its doubles at which they share clusters with enough of their links; after the
    search ``recall`` is the mean over the audited vectors with links of the share that was found, of ``audited_links`` links in all, and null if none has
    any. Under ``least_recall`` the overlap doubles; if every cluster is not enough, all shards are compared as a whole. component_id
    is the smallest id reachable by links; a null id is left out of that, and its row has null there and is kept. An empty table gives none.
    """
    spark = vectors.sparkSession
    ok = usable(vector_col) & F.exists(vector_col, lambda x: x != 0)
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(ok, F.col(vector_col).cast("array<double>")).alias("v"))
    given = written(given.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")}), "vectors")
    points = given.where("v is not null and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    points = written(points.select("h2", "least", F.col("h1").alias("rep"), "copies", F.size("v").alias("dim"), "v"), "points")
    n = points.count()
    recall, audited_links = None, 0
    if n:
        bodies = points.select("rep", "copies", "dim", "v")
        drawn = lambda name, rows: bodies.where(F.pmod(F.xxhash64("rep", F.lit(name)), F.lit(2**40)) < int(2**40 * min(1.0, rows / n))).limit(2 * rows).collect()
        sample = drawn("sample", sample_rows) or [bodies.first()]
        width = max(len(r["v"]) for r in sample)
        centres = fit_centres(_unit(np.array([[*r["v"], *[0.0] * (width - len(r["v"]))] for r in sample], np.float64)), min(most_clusters, max(1, n // cluster_rows)))
        overlaps = [overlap]
        while overlaps[-1] < len(centres) and len(overlaps) < 4:
            overlaps.append(2 * overlaps[-1])
        truth: dict[int, tuple[int, list[int]]] = {}
        for times in (1, 4, 16):
            audited = drawn("audit", audit_rows * times)
            truth = {k: v for k, v in _audit(bodies, audited, centres, overlaps, threshold).items() if v[0]} if audited else {}
            if len(truth) >= audit_linked or audit_rows * times >= n:
                break
        audited_links = sum(v[0] for v in truth.values())
        share = lambda k: np.mean([v[1][k] / v[0] for v in truth.values()]) if truth else 1.0
        enough = (1 + least_recall) / 2
        overlap = next((m for k, m in enumerate(overlaps) if share(k) >= enough), 2 * overlaps[-1])
        exact = False
        while True:
            found = _linked(bodies, centres, overlap, shard_rows, threshold, exact)
            counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
            if not truth:
                break
            seen = {r["rep"]: r["n"] for r in counts.where(F.col("rep").isin(list(truth))).collect()}
            recall = float(np.mean([min(seen.get(k, 0), v[0]) / v[0] for k, v in truth.items()]))
            if recall >= least_recall or exact:
                break
            exact = overlap >= len(centres)
            overlap *= 2
        classes = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
        named = points.join(counts, "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
        smallest = named.groupBy("c").agg(F.min("least").alias("component"))
        named = named.select(F.col("rep").alias("h1"), "h2", "c", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")).join(smallest, "c")
        out = given.join(named, ["h1", "h2"], "left")
    else:
        out = given.withColumns({"links": F.lit(0), "component": F.col("id")})
    linked = F.col("v").isNotNull() & F.col("id").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.when(linked, F.col("links")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("recall"), F.lit(audited_links).cast("long").alias("audited_links"),
    )
