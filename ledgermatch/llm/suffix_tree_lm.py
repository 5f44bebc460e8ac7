"""Language-model scores from a probabilistic suffix tree over bytes, beside a word-frequency base score."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, give_back, small_batches, task_number, written
from .shingles import _LOWER, SPACE, mix, word_hashes

#: Stands before a text's first and after its last word; no word holds it.
END = 10
BLANK = 32


def normal_form(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, A to Z folded, words parted by one space, an end after each text; and the ends' places."""
    blobs = [(t or "").encode() for t in texts]
    raw = _LOWER[np.frombuffer(b" ".join(blobs) + b" ", np.uint8)]
    ends = np.cumsum([len(b) + 1 for b in blobs]) - 1
    space = SPACE[raw]
    raw = np.where(space, np.uint8(BLANK), raw)
    raw[ends] = END
    # White space goes if a text starts with it, if more follows, or if the end follows.
    after_gap = np.concatenate([[True], space[:-1]])
    starts = np.concatenate([[0], ends[:-1] + 1])
    keep = ~(space & after_gap)
    keep[starts] = ~space[starts]
    before_end = np.concatenate([raw[1:] == END, [False]]) & (raw == BLANK)
    keep[ends] = True
    # A run of blanks before an end keeps its first blank by the rule above; that one goes, too.
    run_end = np.flatnonzero(before_end)
    if len(run_end):
        solid = np.flatnonzero(~space | (raw == END))
        last = solid[np.searchsorted(solid, run_end) - 1]
        ok = (np.searchsorted(solid, run_end) > 0) & (last + 1 <= run_end)
        keep[np.where(ok, last + 1, run_end)] = False
        keep[ends] = True
    places = np.cumsum(keep)[ends] - 1
    return raw[keep], places


def gram_keys(buffer: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """For every symbol the ``depth`` symbols before it and itself as one number, the symbol lowest; a text begins after an end."""
    n = len(buffer)
    keys = np.zeros(n, np.uint64)
    text_start = np.concatenate([[0], places[:-1] + 1]).astype(np.int32)
    since = np.arange(n, dtype=np.int32) - np.repeat(text_start, np.diff(np.append(text_start, n)))
    for j in range(depth, -1, -1):
        symbol = np.full(n, END, np.uint8)
        symbol[j:] = buffer[: max(0, n - j)]
        if j:
            symbol[since < j] = END
        keys <<= np.uint64(8)
        keys |= symbol
    return keys


@dataclass
class SuffixTree:
    """A tree in memory, which ``gram_logs`` is tested against: states for the retained contexts and all their beginnings, with the log10 probability of each symbol.

    ``step[s, b]`` is the state after symbol class ``b`` in state ``s``: the longest state that is a suffix of what has been
    read. ``classes`` maps bytes to symbol classes; bytes that training never saw share class 0, whose probability is split among them.
    """

    classes: np.ndarray
    step: np.ndarray
    log: np.ndarray
    start: int

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each text's words and end, many texts at a time, symbol by symbol."""
        buffer, places = normal_form(texts)
        symbols = self.classes[buffer]
        starts = np.concatenate([[0], places[:-1] + 1])
        sizes = places + 1 - starts
        order = np.argsort(-sizes, kind="stable")
        at, total = starts[order], np.zeros(len(texts))
        state = np.full(len(texts), self.start, np.int32)
        sizes = sizes[order]
        live = len(order)
        width = self.step.shape[1]
        step, log = self.step.reshape(-1), self.log.reshape(-1)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[live - 1] <= t:
                live -= 1
            cell = state[:live] * width + symbols[at[:live] + t]
            total[:live] += log[cell]
            state[:live] = step[cell]
        out = np.empty(len(texts))
        out[order] = total
        return out


def build_tree(rows: list[tuple[int, int, np.ndarray, np.ndarray]], depth: int, *, divergence: float, strength: float) -> SuffixTree:
    """``rows``: (length, context as a number, symbols, counts) of all frequent contexts, the empty one included.

    Distributions are smoothed from the root down: counts plus ``strength`` times the parent's distribution, where the parent is the
    context without its first symbol. A context is retained if counts times the Kullback-Leibler divergence of its smoothed
    distribution from its parent's is at least ``divergence`` nats, or if a longer retained context needs it as a parent or beginning.
    """
    root = next((r for r in rows if r[0] == 0), (0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)))
    used = np.zeros(256, bool)
    used[root[2]] = True
    classes = np.where(used, np.cumsum(used), 0).astype(np.int32)
    width = int(used.sum()) + 1
    unseen = 256 - int(used.sum())
    uniform = np.full(width, 1 / 256)
    uniform[0] = unseen / 256
    by_length: list[dict[int, np.ndarray]] = [{} for _ in range(depth + 1)]
    keep: list[set[int]] = [set() for _ in range(depth + 1)]
    for length, context, symbols, counts in sorted(rows, key=lambda r: r[0]):
        parent = by_length[length - 1].get(context & ((1 << 8 * (length - 1)) - 1)) if length else uniform
        if parent is None:
            continue
        c = np.zeros(width)
        c[classes[symbols]] = counts
        n = c.sum()
        p = (c + strength * parent) / (n + strength)
        by_length[length][context] = p
        if length == 0 or n * float((p * np.log(p / parent)).sum()) >= divergence:
            keep[length].add(context)
    keep[0].add(0)
    for length in range(depth, 0, -1):
        for context in keep[length]:
            keep[length - 1].add(context & ((1 << 8 * (length - 1)) - 1))
            keep[length - 1].add(context >> 8)
    by_length[0].setdefault(0, uniform)
    states = [(length, c) for length in range(depth + 1) for c in sorted(keep[length])]
    number = {s: i for i, s in enumerate(states)}
    log = np.empty((len(states), width), np.float32)
    for i, (length, context) in enumerate(states):
        at, c = length, context
        while c not in by_length[at]:
            at -= 1
            c &= (1 << 8 * at) - 1
        log[i] = np.log10(by_length[at][c])
    log[:, 0] -= math.log10(max(1, unseen))
    # A state's successors: those of its parent, unless the state extended by the symbol is a state itself.
    step = np.zeros((len(states), width), np.int32)
    extended: dict[int, list[tuple[int, int]]] = {}
    for i, (length, context) in enumerate(states):
        if length:
            extended.setdefault(number[(length - 1, context >> 8)], []).append((int(classes[context & 255]), i))
    for i, (length, context) in enumerate(states):
        if length:
            step[i] = step[number[(length - 1, context & ((1 << 8 * (length - 1)) - 1))]]
        for b, to in extended.get(i, []):
            step[i, b] = to
    start = 0
    for _ in range(depth):
        start = int(step[start, classes[END]]) if classes[END] else 0
    return SuffixTree(classes, step, log, start)


def _pressed(raw: bytes, level: int = 1) -> bytes:
    """Length and bytes by zstd: what is shuffled is mostly letters and low numbers, which Spark's own codec leaves as they are."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _expanded(pressed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(pressed[8:], int.from_bytes(pressed[:8], "little"), asbytes=True)


def _planes(numbers: np.ndarray) -> bytes:
    """The numbers' bytes by significance, which compress well for sorted numbers, compressed."""
    return _pressed(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T).tobytes())


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_expanded(planes), np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)


#: Grams whose contexts share this many last symbols are in one block. Shorter contexts are few at any input size.
_TOGETHER = 3


def _low(keys: np.ndarray, symbols: int) -> np.ndarray:
    return keys & np.uint64((1 << 8 * symbols) - 1)


def _gram_block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return _block(_low(keys >> np.uint64(8), _TOGETHER), blocks)


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(keys) >> np.uint64(20)) % np.uint64(blocks)


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in a sorted array, and whether they are there."""
    at = np.searchsorted(sorted_, wanted)
    at[at == len(sorted_)] = 0
    return at, (sorted_[at] == wanted) if len(sorted_) else np.zeros(len(wanted), bool)


@dataclass
class Level:
    """All contexts of one length: their grams (context, symbol) with smoothed probabilities, their counts and which are states."""

    keys: np.ndarray
    p: np.ndarray
    contexts: np.ndarray
    n: np.ndarray
    kept: np.ndarray


def grow(levels: list[Level], keys: np.ndarray, counts: np.ndarray, depth: int, *, least: int, divergence: float, strength: float) -> list[Level]:
    """``levels`` and those that follow up to ``depth``, from training grams: all, or those of a block from length _TOGETHER on.

    Distributions are smoothed from the root down: counts plus ``strength`` times the parent's distribution, where the parent is the
    context without its first symbol. A context that occurs ``least`` times is a state if its count times the Kullback-Leibler
    divergence from its parent is at least ``divergence`` nats, if it is shorter than _TOGETHER, or if a longer state needs it as a parent.
    """
    levels = list(levels)
    first_new = len(levels)
    for length in range(first_new, depth + 1):
        own, c = _summed(_low(keys, length + 1), counts)
        context = own >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(own) else np.zeros(0, np.intp)
        n = np.add.reduceat(c, first) if len(own) else c
        total = np.repeat(n, np.diff(np.append(first, len(own))))
        q = levels[-1].p[np.searchsorted(levels[-1].keys, _low(own, length))] if length else np.full(len(own), 1 / 256)
        p = (c + strength * q) / (total + strength)
        kept = n >= least
        if length == 0:
            kept[:] = True
        elif length >= _TOGETHER and len(own):
            # Symbols that never follow have the parent's probability times this weight.
            w = strength / (n + strength)
            rest = np.maximum(0, 1 - np.add.reduceat(q, first))
            kept &= n * (np.add.reduceat(p * np.log(p / q), first) + w * rest * np.log(w)) >= divergence
        levels.append(Level(own, p, context[first], n, kept))
    for length in range(depth, max(first_new, 1), -1):
        upper, lower = levels[length], levels[length - 1]
        lower.kept[np.searchsorted(lower.contexts, _low(upper.contexts[upper.kept], length - 1))] = True
    return levels


def gram_logs(levels: list[Level], asked: np.ndarray, strength: float) -> np.ndarray:
    """log10 probability of each asked gram's symbol in the longest state that its context ends in."""
    v = np.full(len(asked), 1 / 256)
    live = np.arange(len(asked))
    for length, level in enumerate(levels):
        keys = _low(asked[live], length + 1)
        at, there = _find(level.contexts, keys >> np.uint64(8))
        if len(level.contexts):
            there &= level.kept[at]
        live, keys, at = live[there], keys[there], at[there]
        if not len(live):
            break
        entry, hit = _find(level.keys, keys)
        v[live] = np.where(hit, level.p[entry], v[live] * strength / (level.n[at] + strength))
    return np.log10(v).astype(np.float32)


#: The number of a block's row is its order in a chunk, so answers need not repeat the keys.
_ROW = "kind string, block int, chunk long, keys binary, counts binary"
_ANSWER = "kind string, block int, chunk long, answer binary"


def chunked(given: DataFrame, size: int) -> DataFrame:
    """Rows (id, text, train) in chunks of about ``size`` bytes that stay together: one row for each, with its texts' normal forms.

    ``low`` and ``low_counts`` are the grams of its training texts with contexts shorter than _TOGETHER.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = task_number() << 32
        ids, train, texts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal serial, held
            buffer, places = normal_form(texts)
            mark = np.array(train, np.uint8)
            sizes = np.diff(np.concatenate([[-1], places]))
            keys, counts = np.unique(gram_keys(buffer, places, _TOGETHER - 1)[np.repeat(mark, sizes) > 0], return_counts=True)
            row = [[serial], [held], [list(ids)], [mark.tobytes()], [_pressed(buffer.tobytes(), 6)], [keys.tobytes()], [counts.astype(np.int64).tobytes()]]
            serial, held = serial + 1, 0
            for x in (ids, train, texts):
                x.clear()
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["chunk", "size", "ids", "train", "buffer", "low", "low_counts"])

        for batch in batches:
            for i, t, mark in zip(*(batch.column(c) for c in ("id", "text", "train"))):
                ids.append(i.as_py())
                texts.append(t.as_py())
                train.append(mark.as_py())
                held += len(t.as_buffer() or b"") + 1
                if held >= size:
                    yield close()
        if ids:
            yield close()
        give_back()

    return given.mapInArrow(run, "chunk long, size long, ids array<long>, train binary, buffer binary, low binary, low_counts binary")


def _opened(pressed: bytes, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's grams, its texts' ends, its words' hashes and where each text's words begin."""
    buffer = _expanded(pressed)
    raw = np.frombuffer(buffer, np.uint8)
    places = np.flatnonzero(raw == END)
    words, offsets = word_hashes(buffer.decode("utf-8", "surrogatepass").split("\n")[:-1], lower=True)
    return gram_keys(raw, places, depth), places, words, offsets


def _asked(kind: str, keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted distinct keys by block, and the cuts between blocks."""
    block = (_gram_block if kind == "gram" else _block)(keys, blocks).astype(np.uint16 if blocks < 2**16 else np.uint64)
    order = np.argsort(block, kind="stable")
    return order, np.searchsorted(block[order], np.arange(blocks + 1))


def _counted(kind: str, keys: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each comes with a mark of 1."""
    if kind == "gram":  # has bits to spare, so one array is sorted in place
        keys = (keys << np.uint64(1)) | mark
        keys.sort()
        mark = (keys & np.uint64(1)).astype(np.uint8)
        keys >>= np.uint64(1)
    else:
        order = np.argsort(keys)
        keys, mark = keys[order], mark[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(mark, first, dtype=np.uint32)


def questions(chunks: DataFrame, depth: int, blocks: int) -> DataFrame:
    """For each chunk its distinct grams and words by block, with their counts in its training texts (0: only in others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = batch.column("chunk")[i].as_py()
                grams, places, words, offsets = _opened(batch.column("buffer")[i].as_py(), depth)
                train = np.frombuffer(batch.column("train")[i].as_py(), np.uint8)
                for kind, keys, sizes in (("gram", grams, np.diff(np.concatenate([[-1], places]))), ("word", words, np.diff(offsets))):
                    if not len(keys):
                        continue
                    distinct, counts = _counted(kind, keys, np.repeat(train, sizes))
                    order, cuts = _asked(kind, distinct, blocks)
                    distinct, counts = distinct[order], counts[order]
                    full = np.flatnonzero(np.diff(cuts))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(full)), pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), *[pa.array([_planes(x[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()) for x in (distinct, counts)]],
                        names=["kind", "block", "chunk", "keys", "counts"],
                    )

    return chunks.select("chunk", "train", "buffer").mapInArrow(run, _ROW)


def answers(asked: DataFrame, low, depth: int, blocks: int, options: dict) -> DataFrame:
    """For each chunk and block what was asked: grams' log10 probabilities or words' training counts.

    A block has all grams of its contexts, so their part of the tree arises here, however large the whole tree is. A row of
    kind ``sum``, in a chunk of its own, has the number of a block's training words and how many differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        now: tuple[str, int] | None = None

        def close() -> pa.RecordBatch:
            kind, block = now
            keys, which = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
            counts = np.bincount(which, weights=np.concatenate([h[2] for h in held]), minlength=len(keys)).astype(np.int64)
            if kind == "gram":
                seen = counts > 0
                out = gram_logs(grow(low.value, keys[seen], counts[seen], depth, **options), keys, options["strength"])
            else:
                out = counts
            ends = np.cumsum([len(h[1]) for h in held])
            out = out[which]
            rows = [(kind, block, h[0], _planes(out[e - len(h[1]) : e])) for h, e in zip(held, ends)]
            if kind == "word":
                rows.append(("sum", block, -1 - block, np.array([counts.sum(), (counts > 0).sum()], np.int64).tobytes()))
            held.clear()
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["kind", "block", "chunk", "answer"])

        for batch in batches:
            for kind, block, chunk, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and now != (kind, block):
                    yield close()
                now = (kind, block)
                held.append((chunk, _numbers(keys, np.uint64), _numbers(counts, np.uint32)))
        if held:
            yield close()
        give_back()

    # As many tasks as blocks, of grams and of words, so that no more of them share a task in larger inputs.
    return asked.repartition(2 * blocks, "kind", "block").sortWithinPartitions("kind", "block").mapInArrow(run, _ANSWER)


def finished(chunks: DataFrame, answered: DataFrame, depth: int, blocks: int, tasks: int, n_texts: int) -> DataFrame:
    """(id, n_tokens, n_known, logs, score), one row for each text of each chunk, from the chunk and its answers.

    Rows of kind ``sum`` stay rows: n_tokens and n_known hold their numbers, and logs is null.
    """
    end_log = math.log10(n_texts + 0.5)

    def settle(ids: list, buffer: bytes, got: dict[str, list[bytes]]) -> pa.RecordBatch:
        grams, places, words, offsets = _opened(buffer, depth)

        def values(kind: str, keys: np.ndarray, type_: type) -> np.ndarray:
            order = np.argsort(keys)
            ordered = keys[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            distinct = ordered[new]
            by_block, _ = _asked(kind, distinct, blocks)
            answer = np.empty(len(distinct), type_)
            answer[by_block] = np.concatenate([_numbers(a, type_) for a in got[kind]])
            out = np.empty(len(keys), type_)
            out[order] = answer[np.cumsum(new) - 1]
            return out

        score = np.add.reduceat(values("gram", grams, np.float32).astype(np.float64), np.concatenate([[0], places[:-1] + 1]))
        n = np.diff(offsets)
        doc = np.repeat(np.arange(len(ids)), n)
        c = values("word", words, np.int64) if len(words) else np.zeros(0, np.int64)
        known = np.bincount(doc, weights=c > 0, minlength=len(ids)).astype(np.int64) + (n_texts > 0)
        logs = np.bincount(doc, weights=np.log10(c + 0.5), minlength=len(ids)).astype(np.float64) + end_log
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n.astype(np.int64) + 1), pa.array(known), pa.array(logs), pa.array(score)], names=["id", "n_tokens", "n_known", "logs", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = buffer = None
        got: dict[str, list[bytes]] = {}
        for batch in batches:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                if kind == "sum":
                    n, kinds = np.frombuffer(batch.column("body")[i].as_py(), np.int64).tolist()
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n]), pa.array([kinds]), *[pa.nulls(1, pa.float64())] * 2], names=["id", "n_tokens", "n_known", "logs", "score"])
                elif kind == "docs":  # comes first
                    if ids is not None:
                        yield settle(ids, buffer, got)
                    ids, buffer, got = batch.column("ids")[i].as_py(), batch.column("body")[i].as_py(), {"gram": [], "word": []}
                else:
                    got[kind].append(batch.column("body")[i].as_py())
        if ids is not None:
            yield settle(ids, buffer, got)
        give_back()

    docs = chunks.select("chunk", F.lit("docs").alias("kind"), F.lit(0).alias("block"), "ids", F.col("buffer").alias("body"))
    back = answered.select("chunk", "kind", "block", F.lit(None).cast("array<long>").alias("ids"), F.col("answer").alias("body"))
    both = docs.union(back).repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "block")
    return both.select("kind", "ids", "body").mapInArrow(run, "id long, n_tokens long, n_known long, logs double, score double")


def score_texts(
    docs: DataFrame, *, training: Column, depth: int = 6, share: float = 1e-5, least: int = 8, divergence: float = 6.0, strength: float = 10.0, blocks: int | None = None, chunk_bytes: int = 6_000_000, block_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``.

    A to Z count as a to z; tokens are words between ASCII white space and one end. ``score`` is the log10 probability of the text's
    tokens under a probabilistic suffix tree over bytes, fitted on the rows where ``training`` holds (null: it doesn't):
    contexts of up to ``depth`` bytes that occur ``least`` times in training are candidates, at every input size (in very small corpora,
    also those that make up ``share`` of all training symbols and occur twice); those that pass the divergence test stay,
    and each byte is scored in the longest state that the text before it ends in. So the tree grows with the input. ``base_score`` sums
    log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, with c a token's count in training, N all tokens and V the
    distinct ones there.

    No task holds the whole tree: a byte's probability depends on its gram alone. Texts stay together in chunks of about ``chunk_bytes``; each
    sends its distinct grams and words by block, where all counts of a context meet, and gets their probabilities and counts back. There is a
    block for every ``block_bytes`` of text, so a block's share does not grow with the input, unless one context of three bytes alone has more. Only contexts
    shorter than _TOGETHER, whose number the alphabet bounds, go to all tasks. Null texts count as
    empty: their one token is the end. Rows that repeat an id, and rows without one, stay rows of their own. With no training
    rows the tree is uniform, and N and V are 0. Empty tables give none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    chunks = written(chunked(given, chunk_bytes), "chunks")
    size, n_chunks = chunks.agg(F.sum("size"), F.count("*")).first()
    blocks = blocks or max(16, (size or 0) // block_bytes)

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for train, keys, n in zip(*(c.to_pylist() for c in batch.columns)):
                keys, n = np.frombuffer(keys, np.int64), np.frombuffer(n, np.int64)
                keys, n = np.append(keys, -1), np.append(n, np.frombuffer(train, np.uint8).sum(dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    short = chunks.select("train", "low", "low_counts").mapInArrow(singles, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    n_texts = int(short["n"][short["key"] < 0].sum())
    keys, n = (short[c][short["key"] >= 0].to_numpy(t) for c, t in (("key", np.uint64), ("n", np.int64)))
    options = {"least": min(least, max(2, int(share * int(n.sum())))), "divergence": divergence, "strength": strength}
    low = spark.sparkContext.broadcast(grow([], keys, n, _TOGETHER - 1, **options))
    scored = written(finished(chunks, answers(questions(chunks, depth, blocks), low, depth, blocks, options), depth, blocks, max(1, n_chunks), n_texts), "scored")
    sums = scored.where("logs is null").agg(F.sum("n_tokens"), F.sum("n_known")).first()
    n_train, n_kinds = (sums[0] or 0) + n_texts, (sums[1] or 0) + (n_texts > 0)
    offset = math.log10(n_train + 0.5 * (n_kinds + 1))
    discard(chunks)
    return scored.where("logs is not null").select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * offset).alias("base_score"), "score",
    )
