"""A robust-pruned flat proximity graph over unit vectors, and range search in it, for many queries at once."""

from __future__ import annotations

import numpy as np


def robust_prune(similar: np.ndarray, degree: int, alpha: float, pool: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Out-neighbours of each of n points, given all their cosine similarities.

    Candidates are the ``pool`` nearest points and a few random ones, by distance 1 - cosine. The nearest candidate left becomes a
    neighbour and removes those it is closer to, by the factor ``alpha``, than the point itself; so long edges survive
    where no short one leads the same way.
    """
    n = len(similar)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    far = similar.copy()
    np.fill_diagonal(far, -np.inf)
    near = min(pool, n - 1)
    candidates = np.concatenate([np.argpartition(-far, near - 1, axis=1)[:, :near], rng.integers(0, n, (n, 12))], axis=1)
    distance = 1 - np.take_along_axis(far, candidates, axis=1)
    order = np.argsort(distance, axis=1, kind="stable")
    candidates, distance = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(distance, order, axis=1)
    alive = np.isfinite(distance)
    chosen = np.full((n, degree), -1)
    rows = np.arange(n)
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        pick = candidates[rows, first]
        chosen[some, k] = pick[some]
        alive &= alpha * (1 - similar[pick[:, None], candidates]) > distance
        alive[rows, first] = False
        alive &= candidates != pick[:, None]
    return [c[c >= 0] for c in chosen]


def build(vectors: np.ndarray, degree: int = 20, alpha: float = 1.2, pool: int = 40) -> tuple[list[np.ndarray], int]:
    """Adjacency of a shard's points and its medoid, from which every point can be reached."""
    n = len(vectors)
    similar = vectors @ vectors.T
    medoid = int(np.argmax(vectors @ vectors.mean(axis=0)))
    out = robust_prune(similar, degree, alpha, pool, np.random.default_rng(n))
    source = np.repeat(np.arange(n), [len(o) for o in out])
    target = np.concatenate(out) if n else np.zeros(0, int)
    # Edges run both ways; of too many that lead into a point, the nearest stay.
    s, t = np.concatenate([source, target]), np.concatenate([target, source])
    key = np.unique(s * n + t)
    s, t = key // n, key % n
    order = np.lexsort((-similar[s, t], s))
    s, t = s[order], t[order]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    s, t = s[place < 2 * degree], t[place < 2 * degree]
    links = [list(x) for x in np.split(t, np.searchsorted(s, np.arange(1, n)))] if n else []
    reached = np.zeros(n, bool)
    todo = [medoid] if n else []
    while True:
        while todo:
            x = todo.pop()
            if not reached[x]:
                reached[x] = True
                todo += links[x]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            break
        have = np.flatnonzero(reached)
        best = similar[np.ix_(lost, have)]
        at = int(best.max(axis=1).argmax())
        a, b = int(lost[at]), int(have[best[at].argmax()])
        links[a].append(b)
        links[b].append(a)
        todo = [a]
    return [np.array(x, np.int64) for x in links], medoid


def range_search(points: np.ndarray, links: np.ndarray, medoid: int, queries: np.ndarray, threshold: float, beam: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) with similarity of at least ``threshold`` that greedy search finds.

    ``links`` is the adjacency padded with -1. Each query walks from the medoid, always expanding the best point of its beam that is not
    yet expanded; then the range grows: all points found within the threshold are expanded, until none is new.
    """
    nq, n = len(queries), len(points)
    seen = np.zeros((nq, n), bool)
    hits = np.zeros((nq, n), bool)
    expanded = np.zeros((nq, n), bool)
    ids = np.full((nq, beam), medoid)
    sims = np.full((nq, beam), -np.inf, np.float32)
    sims[:, 0] = queries @ points[medoid]
    open_ = np.zeros((nq, beam), bool)
    open_[:, 0] = True
    seen[:, medoid] = True
    hits[:, medoid] = sims[:, 0] >= threshold
    active = np.arange(nq)
    while len(active):
        best = np.where(open_[active], sims[active], -np.inf).argmax(axis=1)
        some = open_[active, best]
        active, best = active[some], best[some]
        if not len(active):
            break
        open_[active, best] = False
        node = ids[active, best]
        expanded[active, node] = True
        new = links[node]
        fresh = (new >= 0) & ~seen[active[:, None], new]
        s = np.einsum("qd,qrd->qr", queries[active], points[new])
        s[~fresh] = -np.inf
        rows, cols = np.nonzero(fresh)
        seen[active[rows], new[rows, cols]] = True
        inside = s[rows, cols] >= threshold
        hits[active[rows[inside]], new[rows[inside], cols[inside]]] = True
        all_sims = np.concatenate([sims[active], s], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(all_sims, top, axis=1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], new], axis=1), top, axis=1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], fresh], axis=1), top, axis=1)
    while True:
        q, p = np.nonzero(hits & ~expanded)
        if not len(q):
            break
        expanded[q, p] = True
        for lo in range(0, len(q), 4096):
            qs, new = q[lo : lo + 4096], links[p[lo : lo + 4096]]
            qs = np.broadcast_to(qs[:, None], new.shape)[new >= 0]
            new = new[new >= 0]
            fresh = ~seen[qs, new]
            key = np.unique(qs[fresh] * n + new[fresh])
            qs, new = key // n, key % n
            seen[qs, new] = True
            inside = np.einsum("pd,pd->p", queries[qs], points[new]) >= threshold
            hits[qs[inside], new[inside]] = True
    return np.nonzero(hits)
