"""Packing of documents into windows of near-equal length by multiway number differencing."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, give_back, small_batches, task_number
from .tokens import tokenizer

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp for ``ways`` parts: indexes of ``sizes`` by part.

    Every number starts as a partial partition with one part in use. The two partial partitions of the largest spread
    are merged, the largest part of one with the smallest of the other, until one partition is left.
    """
    if not sizes:
        return [[] for _ in range(ways)]
    # A partial partition lists its parts in use, largest first; a part is (sum, tree of indexes).
    heap = [(-s if ways > 1 else 0, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    by_sum = lambda part: -part[0]
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        alone = max(0, ways - len(b))
        merged = a[:alone] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[alone:], reversed(b))]
        merged += list(reversed(b))[max(0, len(a) - alone) :]
        merged.sort(key=by_sum)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == ways else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    parts = []
    for _, tree in heap[0][2]:
        members, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                members.append(x)
        parts.append(sorted(members))
    return parts + [[] for _ in range(ways - len(parts))]


def near_equal_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most ``capacity``: as many as the total needs, and one more whenever a part exceeds the capacity."""
    ways = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        parts = differencing(sizes, ways)
        if max((sum(sizes[i] for i in p) for p in parts), default=0) <= capacity:
            return [p for p in parts if p]
        ways += 1


def binary_lengths(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


@dataclass
class Piece:
    """Ids ``start`` to ``start + length - 1`` of a document of ``total`` ids."""

    doc: int | None
    start: int
    length: int
    ids: bytes
    total: int

    def split(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, at, self.ids[: 4 * at], self.total), Piece(self.doc, self.start + at, self.length - at, self.ids[4 * at :], self.total)


class Packer:
    """Puts pieces into sequences, numbered by ``sequences``; ``done`` gathers (piece, sequence, offset)."""

    def __init__(self, capacity: int, windows: int, slack: int, sequences: Iterator[int]):
        self.capacity, self.windows, self.fill = capacity, windows, capacity - min(slack, capacity - 1)
        self.sequences = sequences
        self.waiting: list[Piece] = []
        self.held = 0
        self.done: list[tuple[Piece, int, int]] = []

    def add(self, piece: Piece) -> None:
        self.waiting.append(piece)
        self.held += piece.length
        while self.held >= self.fill * self.windows:
            self.close(self.windows)

    def sequence_of(self, pieces: list[Piece]) -> None:
        offset, sequence = 0, next(self.sequences)
        for p in pieces:
            self.done.append((p, sequence, offset))
            offset += p.length

    def taken(self, n: int) -> list[Piece]:
        """The first ``n`` waiting ids as pieces; the last one is cut to fit."""
        out, at = [], 0
        while n:
            p = self.waiting[at]
            if p.length > n:
                p, self.waiting[at] = p.split(n)
            else:
                at += 1
            out.append(p)
            n -= p.length
            self.held -= p.length
        del self.waiting[:at]
        return out

    def close(self, windows: int) -> None:
        """Near-equal windows of what fills ``windows`` of them but for the slack."""
        pieces = self.taken(windows * self.fill)
        for part in near_equal_windows([p.length for p in pieces], self.capacity):
            self.sequence_of([pieces[i] for i in part])

    def end(self, piece: int) -> None:
        """The last windows of what waits, in smaller pieces, as few of them are even less easily; and sequences of power-of-two lengths.

        The latter need no padding. They take what is left over, and what a last window has beyond the capacity, so
        no further window of which much is padding arises.
        """
        while self.held >= self.fill:
            pieces = []
            for p in self.taken(self.held // self.fill * self.fill):
                while p.length > piece:
                    head, p = p.split(piece)
                    pieces.append(head)
                pieces.append(p)
            for part in differencing([p.length for p in pieces], sum(p.length for p in pieces) // self.fill):
                window, room = [], self.capacity
                for p in (pieces[i] for i in part):
                    if p.length > room:
                        p, more = (p.split(room) if room else (None, p))
                        self.waiting.append(more)
                        self.held += more.length
                    if p:
                        window.append(p)
                        room -= p.length
                self.sequence_of(window)
        for n in binary_lengths(self.held):
            self.sequence_of(self.taken(n))


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, piece: int = 512, windows: int = 64, slack: int = 32, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", by: str | None = None, most_open: int = 32) -> DataFrame:
    """One row for each piece of a document, with its ids and its place in a sequence.

    A document is its ids and ``end_id``; null text counts as empty, so its document is the end id alone. Whole
    stretches of ``capacity`` ids fill sequences of their own; the rest of a document is cut into near-equal pieces of at
    most ``piece`` ids. Each task packs its pieces as they arrive, in groups of just the ids that fill ``windows`` sequences but for
    ``slack`` ids each, so memory is bounded by a group and nothing is shuffled. What is left at a task's end goes to fewer
    windows and then to sequences of power-of-two lengths, so padding does not depend on the number of
    tasks. ``sequence_id`` holds the task number in its upper bits, so it changes with the input's partitions. Rows with the
    same or a null id are packed like any others. Other columns of ``docs`` are ignored; an empty table gives no rows.

    With ``by``, a string column that follows the others in the result, no sequence holds documents of two of its values; null is one of its own. A task has pieces of ``most_open`` values
    waiting at a time; when a further one comes, those of the value that was longest without a document are packed as at a task's end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        sequences = itertools.count(task_number() << 32)
        packers: dict[str | None, Packer] = {}  # the one used last is the last

        def rows(value: str | None, packer: Packer) -> pa.RecordBatch:
            columns = list(zip(*[(p.doc, p.start, p.length, p.ids, p.total, sequence, offset) for p, sequence, offset in packer.done])) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            if by:
                arrays.append(pa.array([value] * len(packer.done), pa.string()))
                names.append(by)
            packer.done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def ended(value: str | None) -> pa.RecordBatch:
            packer = packers.pop(value)
            packer.end(max(1, piece // 8))
            return rows(value, packer)

        for batch in batches:
            for part in byte_slices(batch, "text", 2_000_000):
                values = part.column(2).to_pylist() if by else [None] * part.num_rows
                for doc, ids, value in zip(part.column(0).to_pylist(), tok.encode(part.column(1).to_pylist()), values):
                    packer = packers.pop(value, None) or Packer(capacity, windows, slack, sequences)
                    packers[value] = packer
                    if len(packers) > most_open:
                        yield ended(next(iter(packers)))
                    ids += end
                    n = len(ids) // 4
                    whole = n - n % capacity
                    for start in range(0, whole, capacity):
                        packer.sequence_of([Piece(doc, start, capacity, ids[4 * start : 4 * (start + capacity)], n)])
                    rest = n - whole
                    cuts = math.ceil(rest / piece)
                    for k in range(cuts):
                        lo, hi = whole + rest * k // cuts, whole + rest * (k + 1) // cuts
                        packer.add(Piece(doc, lo, hi - lo, ids[4 * lo : 4 * hi], n))
                    if len(packer.done) >= 2000:
                        yield rows(value, packer)
        for value in list(packers):
            yield ended(value)
        give_back()

    small_batches(docs.sparkSession)
    columns = [F.col(id_col).alias("doc_id").cast("long"), F.col(text_col).alias("text").cast("string"), *([F.col(by).cast("string")] if by else [])]
    return docs.select(*columns).mapInArrow(run, f"{_SCHEMA}, `{by}` string" if by else _SCHEMA)
