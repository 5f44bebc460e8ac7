"""Counting quotient filters that lose nothing: packed tuples of numbers, permuted, split into quotient and whole remainder, with counters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shingles import mix

_ROUNDS = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


@dataclass(frozen=True)
class Packing:
    """How ``size`` numbers (2 to 4) below 2**``bits`` (at most 32 bits) become a key: a left half of one or two of them, and a right half.

    A key is permuted over all keys of its width by rounds that change one half by a function of the other, so each round is undone by
    itself. The permuted left half says where a key stands in a filter; both halves together give the numbers back.
    """

    size: int
    bits: int

    @property
    def left_bits(self) -> int:
        return (self.size // 2 + (self.size == 3)) * self.bits

    @property
    def right_bits(self) -> int:
        return self.size * self.bits - self.left_bits

    @property
    def one_number(self) -> bool:
        return self.size * self.bits <= 64

    def keys(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The permuted halves of tuples, whose k-th numbers are in ``numbers[k]``."""
        cut = self.left_bits // self.bits
        left, right = (self._joined(part) for part in (numbers[:cut], numbers[cut:]))
        for k, c in enumerate(_ROUNDS):
            if k % 2:
                left = left ^ (mix(right + c) & _mask(self.left_bits))
            else:
                right = right ^ (mix(left + c) & _mask(self.right_bits))
        return left, right

    def numbers(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        """The inverse of ``keys``."""
        for k, c in reversed([*enumerate(_ROUNDS)]):
            if k % 2:
                left = left ^ (mix(right + c) & _mask(self.left_bits))
            else:
                right = right ^ (mix(left + c) & _mask(self.right_bits))
        cut = self.left_bits // self.bits
        return [*self._parted(left, cut), *self._parted(right, self.size - cut)]

    def _joined(self, numbers: list[np.ndarray]) -> np.ndarray:
        out = numbers[0].astype(np.uint64)
        for x in numbers[1:]:
            out = (out << np.uint64(self.bits)) | x.astype(np.uint64)
        return out

    def _parted(self, half: np.ndarray, count: int) -> list[np.ndarray]:
        return [((half >> np.uint64(self.bits * (count - 1 - k))) & _mask(self.bits)).astype(np.int64) for k in range(count)]


@dataclass
class Counts:
    """Different keys in ascending order, and how often each occurs."""

    left: np.ndarray
    right: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, packing: Packing, left: np.ndarray, right: np.ndarray, times: np.ndarray | None = None) -> Counts:
        """Counts of keys in any order; ``times`` counts each key of the input as so many (1 if None). Sorted stretches of the input are merged, not sorted anew."""
        if not len(left):
            return cls(left, right, np.zeros(0, np.int64))
        shift = np.uint64(packing.right_bits)
        if packing.one_number:
            both = (left << shift) | right
            if times is None:
                both = np.sort(both)
            else:
                by = np.argsort(both, kind="stable")
                both, times = both[by], times[by]
            heads = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            left, right = both[heads] >> shift, both[heads] & _mask(packing.right_bits)
            total = len(both)
        else:
            by = np.lexsort((right, left))
            left, right, times = left[by], right[by], None if times is None else times[by]
            heads = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
            total = len(left)
            left, right = left[heads], right[heads]
        return cls(left, right, np.diff(np.append(heads, total)) if times is None else np.add.reduceat(times, heads))


def encode(packing: Packing, counts: Counts, prefix_bits: int) -> bytes:
    """A filter of keys that agree in the first ``prefix_bits`` of their left half.

    The next bits are the quotient, about as many as tell the keys' number. For each quotient the filter holds as many zeros as it
    has keys and then a one, so a key's quotient is its slot and costs no room of its own; then the remainders, cut to whole bytes; then the
    counters, a byte each, of which 255 stands for a counter of eight bytes at the end.
    """
    n = len(counts.left)
    free = packing.left_bits - prefix_bits
    q = min(free, max(0, n.bit_length() - 1))
    rest_bits = free - q
    inside = counts.left & _mask(free)
    quotient = (inside >> np.uint64(rest_bits)).astype(np.int64)
    slots = np.ones(n + (1 << q), np.uint8)
    slots[np.arange(n) + quotient] = 0
    rest = inside & _mask(rest_bits)
    if rest_bits + packing.right_bits <= 64:
        columns = [((rest << np.uint64(packing.right_bits)) | counts.right if rest_bits else counts.right, rest_bits + packing.right_bits)]
    else:
        columns = [(rest, rest_bits), (counts.right, packing.right_bits)]
    remainders = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-bits // 8)]).tobytes() for c, bits in columns)
    long = counts.times >= 255
    counters = np.where(long, 255, counts.times).astype(np.uint8)
    head = np.array([n, q, int(long.sum())], "<i8").tobytes()
    return head + np.packbits(slots).tobytes() + remainders + counters.tobytes() + counts.times[long].astype("<i8").tobytes()


def decode(packing: Packing, blob: bytes, prefix: int, prefix_bits: int) -> Counts:
    """The inverse of ``encode``; ``prefix`` is what the keys' left halves begin with."""
    n, q, n_long = (int(x) for x in np.frombuffer(blob, "<i8", 3))
    free = packing.left_bits - prefix_bits
    rest_bits = free - q
    at = 24
    n_slots = n + (1 << q)
    slots = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n_slots // 8), at), count=n_slots)
    at += -(-n_slots // 8)
    left = (np.flatnonzero(slots == 0) - np.arange(n)).astype(np.uint64) << np.uint64(rest_bits)
    columns = []
    for bits in [rest_bits + packing.right_bits] if rest_bits + packing.right_bits <= 64 else [rest_bits, packing.right_bits]:
        width = -(-bits // 8)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
        columns.append(wide.view("<u8").reshape(n).astype(np.uint64))
        at += n * width
    if len(columns) == 1:
        rest = columns[0] >> np.uint64(packing.right_bits) if rest_bits else np.zeros(n, np.uint64)
        right = columns[0] & _mask(packing.right_bits)
    else:
        rest, right = columns
    times = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    times[times == 255] = np.frombuffer(blob, "<i8", n_long, at + n)
    return Counts((np.uint64(prefix << free) if prefix_bits else np.uint64(0)) | left | rest, right, times)


def merged(packing: Packing, filters: list[Counts]) -> Counts:
    """One filter's counts of several."""
    return Counts.of(packing, *(np.concatenate([getattr(f, k) for f in filters]) for k in ("left", "right", "times")))
