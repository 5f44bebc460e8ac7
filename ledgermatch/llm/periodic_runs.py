"""Periodic runs of words in texts: maximal stretches that repeat a period, found on enhanced suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, give_back, small_batches, unused

RUN_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _sorted_places(keys: np.ndarray, largest: int) -> np.ndarray:
    """The stable order of ``keys`` (0 to ``largest``). Where key and place fit in 63 bits together they are sorted as one number, which is faster."""
    bits = max(1, len(keys) - 1).bit_length()
    if largest.bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    both = (keys.astype(np.int64) << bits) | np.arange(len(keys))
    both.sort()
    return both & ((1 << bits) - 1)


class SuffixArray:
    """The suffix array of several texts at once, its inverse, its common prefixes, and the classes of stretches of 1, 2, 4, ... words.

    ``words`` numbers the words so that no number occurs in two texts; so no stretch is equal to one of another text. ``ends`` has the
    place behind the last word of each word's text and ``text_length`` that text's number of words. Two places have equal numbers in ``classes[k]`` if the 2**k words from
    there on are equal and within the text; the last level tells all places apart.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, text_length: np.ndarray):
        n = len(words)
        self.n, self.text_length = n, text_length
        counts = np.bincount(words)
        firsts = np.cumsum(counts) - counts
        self.order = _sorted_places(words, int(words.max(initial=0)))
        rank = np.full(n + 1, -1, np.int64)
        rank[:n] = firsts[words]
        self.classes = [rank.astype(np.int32)]
        apart = np.zeros(n, np.int8)  # the level at which a suffix first differs from the one before it in the order
        slots = np.flatnonzero(counts[words[self.order]] > 1)
        span = 1
        while len(slots):
            places = self.order[slots]
            group = rank[places]
            after = np.where(places + span < ends[places], rank[np.minimum(places + span, n)] + 1, 0)
            key = group * (n + 1) + after
            by = _sorted_places(key, n * (n + 1) + n)
            key, places, group = key[by], places[by], group[by]
            self.order[slots] = places
            new = np.empty(len(slots), bool)
            new[0] = True
            np.not_equal(key[1:], key[:-1], out=new[1:])
            inner = new.copy()
            inner[0] = False
            inner[1:] &= group[1:] == group[:-1]
            apart[slots[inner]] = len(self.classes)
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(slots)))
            rank[places] = np.repeat(slots[starts], sizes)
            self.classes.append(rank.astype(np.int32))
            slots = slots[np.repeat(sizes, sizes) > 1]
            span *= 2
        self.inverse = rank[:n]
        self.common = self._common(apart)

    def _common(self, apart: np.ndarray) -> np.ndarray:
        """Words that each suffix shares with the one before it in the order; 0 for the first."""
        common = np.zeros(self.n, np.int64)
        at = np.flatnonzero(apart)
        common[at] = 1 << (apart[at].astype(np.int64) - 1)
        for level in range(len(self.classes) - 2, -1, -1):
            at = np.flatnonzero(apart > level + 1)
            if len(at):
                left, right = self.order[at - 1] + common[at], self.order[at] + common[at]
                equal = self.classes[level][left] == self.classes[level][right]
                common[at[equal]] += 1 << level
        return common


def _lower_neighbours(values: np.ndarray, at: np.ndarray, widest: int) -> np.ndarray:
    """For each place of ``at`` the nearest place on its left with a smaller value, which is at most ``widest`` places away and exists."""
    minima = [values]
    while 2 << (len(minima) - 1) <= widest:
        step = 1 << (len(minima) - 1)
        low = minima[-1].copy()
        np.minimum(low[step:], minima[-1][:-step], out=low[step:])
        minima.append(low)
    here, limit = at - 1, values[at]
    for level in range(len(minima) - 1, -1, -1):
        here = np.where(minima[level][here] >= limit, here - (1 << level), here)
    return here


def _branching_squares(sa: SuffixArray, periods: int, block: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(place, half length) of all squares ww whose two suffixes part right behind their common w, where w occurs ``periods`` times or more.

    Each such square belongs to the interval of suffixes that begin with w. The suffixes of all children of an interval but the largest
    are tested: the one ``depth`` words on, or ``depth`` words back, must lie in the interval and in another child.
    """
    n, common = sa.n, sa.common
    # A run of that many periods fits into its text only if so many depths do.
    at = np.flatnonzero(common > 0)
    at = at[common[at] * periods <= sa.text_length[sa.order[at]]]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = common[at]
    widest = int(np.diff(np.append(np.flatnonzero(common == 0), n)).max())
    padded = np.append(common, 0)
    first = _lower_neighbours(common, at, widest)
    last = n - _lower_neighbours(padded[::-1], n - at, widest) - 1
    wide = last - first + 1 >= periods
    at, depth, first, last = at[wide], depth[wide], first[wide], last[wide]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    interval = first * n + last
    by = _sorted_places(interval, n * n)
    at, depth, first, last, interval = at[by], depth[by], first[by], last[by], interval[by]
    opens = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
    closes = np.append(opens[1:], len(at))
    lo, hi, depth = first[opens], last[opens], depth[opens]
    child_from = np.insert(at, opens, lo)
    child_to = np.insert(at, closes, hi + 1)
    counts = closes - opens + 1
    owner = np.repeat(np.arange(len(opens)), counts)
    sizes = child_to - child_from
    heads = np.cumsum(counts) - counts
    largest = sizes == np.maximum.reduceat(sizes, heads)[owner]
    one = np.minimum.reduceat(np.where(largest, np.arange(len(sizes)), len(sizes)), heads)
    small = np.ones(len(sizes), bool)
    small[one] = False
    child_from, child_to, owner, sizes = child_from[small], child_to[small], owner[small], sizes[small]
    parts = np.searchsorted(np.cumsum(sizes), np.arange(block, int(sizes.sum()) + block, block)) + 1
    found, begin = [], 0
    for end in np.unique(np.minimum(parts, len(sizes))):
        if end <= begin:
            continue
        s, f, t, o = sizes[begin:end], child_from[begin:end], child_to[begin:end], owner[begin:end]
        begin = end
        f_each, t_each, o_each = np.repeat(f, s), np.repeat(t, s), np.repeat(o, s)
        place = sa.order[f_each + np.arange(len(f_each)) - np.repeat(np.cumsum(s) - s, s)]
        d, low, high = depth[o_each], lo[o_each], hi[o_each]
        for shift in (d, -d):
            other = place + shift
            ok = (other >= 0) & (other < n)
            rank = sa.inverse[np.where(ok, other, 0)]
            ok &= (rank >= low) & (rank <= high) & ((rank < f_each) | (rank >= t_each))
            found.append((np.minimum(place, other)[ok], d[ok]))
    return np.concatenate([a for a, _ in found]), np.concatenate([d for _, d in found])


def runs_of(words: np.ndarray, text_starts: np.ndarray, *, periods: int, min_length: int) -> np.ndarray:
    """All runs of the texts as rows (start, end, period), places counted over all texts, by start and then period.

    ``text_starts`` has the first place of each text and the number of all words. A run is a maximal stretch with its smallest period, of at least
    ``periods`` periods and ``min_length`` words.
    """
    n = len(words)
    if not n:
        return np.zeros((0, 3), np.int64)
    text_sizes = np.diff(text_starts)
    sa = SuffixArray(words, np.repeat(text_starts[1:], text_sizes), np.repeat(text_sizes, text_sizes))
    begins = np.repeat(text_starts[:-1], text_sizes)
    place, d = _branching_squares(sa, periods)
    # A square whose first word follows the same word that ends it turns left into another; the leftmost begins the run.
    start, least = place.copy(), begins[place]
    for level in range(len(sa.classes) - 1, -1, -1):
        back = start - (1 << level)
        ok = back >= least
        back = np.where(ok, back, 0)
        ok &= sa.classes[level][back] == sa.classes[level][np.where(ok, back + d, 0)]
        start = np.where(ok, back, start)
    end = place + 2 * d
    by = np.lexsort((d, end, start))
    start, end, d = start[by], end[by], d[by]
    # Squares of several periods find the same stretch as those of one; the smallest period is the run's.
    keep = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(by) else np.zeros(0, bool)
    keep &= end - start >= np.maximum(min_length, periods * d)
    rows = np.stack([start[keep], end[keep], d[keep]], axis=1)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _numbered(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of the texts, their numbers, of which no two texts share one, and where each text's words start."""
    words: list[bytes] = []
    numbers: list[int] = []
    starts, base = [0], 0
    for text in texts:
        own = (text or b"").split()  # of bytes: at the space and tab to carriage return
        known: dict[bytes, int] = {}
        numbers += [known.setdefault(w, base + len(known)) for w in own]
        base += len(known)
        words += own
        starts.append(len(words))
    return words, np.array(numbers, np.int64), np.array(starts)


def collapse(texts: list[bytes | None], *, periods: int = 4, min_length: int = 6) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes | None]]:
    """For each text its number of words, its runs as (start, length, period), and its words outside of repeated periods, parted by one space."""
    words, numbers, starts = _numbered(texts)
    runs = runs_of(numbers, starts, periods=periods, min_length=min_length)
    edges = np.zeros(len(words) + 1, np.int32)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 1], -1)
    kept = np.cumsum(edges)[:-1] == 0
    text_of = np.searchsorted(starts, runs[:, 0], side="right") - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, (a, b, q) in zip(text_of.tolist(), runs.tolist()):
        found[t].append((a - int(starts[t]), b - a, q))
    keep = kept.tolist()
    out = [None if text is None else b" ".join(compress(words[a:b], keep[a:b])) for text, a, b in zip(texts, starts[:-1].tolist(), starts[1:].tolist())]
    return np.diff(starts).tolist(), found, out


def find_runs(docs: DataFrame, *, periods: int = 4, min_length: int = 6, text_col: str = "text", chunk_bytes: int = 200_000) -> DataFrame:
    """``docs`` with n_words, runs and collapsed.

    Words lie between ASCII white space and are numbered from 0. ``runs`` lists the text's runs as (start, length, period), by start and then period: stretches
    of consecutive words whose smallest period is ``period``, of at least ``periods`` periods and ``min_length`` words, that no neighbouring word
    extends with that period. ``collapsed`` has the words that no run holds after its first period, parted by one space.

    Null texts have no words, no runs and a null ``collapsed``; empty and blank texts an empty one. Rows are independent of each
    other, so repeated rows and null ids are nothing special, and an empty table gives an empty one. Other columns pass through; those named n_words, runs
    or collapsed are replaced. Suffixes of about ``chunk_bytes`` of texts are sorted at a time. A longer text is sorted as a whole and
    needs about 300 bytes of memory for each of its words.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    kept = docs.columns
    raw = unused("raw", kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, raw, chunk_bytes):
                n, runs, out = collapse(part.column(raw).to_pylist(), periods=periods, min_length=min_length)
                flat = [r for rs in runs for r in rs]
                entries = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(n, pa.int64()), lists, pa.array(out, pa.binary())], names=[*kept, "n_words", "runs", "collapsed"])
        give_back()

    small_batches(docs.sparkSession)
    given = docs.withColumn(raw, F.col(f"`{text_col}`").cast("binary"))
    return given.mapInArrow(run, f"{fields}, n_words bigint, runs {RUN_TYPE}, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))
