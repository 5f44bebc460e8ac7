"""Quality of texts by attention-based multiple-instance learning: a text is a bag of passages, and only the bag has a label."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import byte_slices, give_back, small_batches, unused

#: Kinds of bytes, of which three in a row make a feature; a byte that is not here is of kind 1, and 0 stands behind a text's end.
_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "'\"-()", "|/\\<>[]{}=_~^`", "#$%&*+@"]
_KIND = np.ones(257, np.int64)
_KIND[128:256] = 2
for _k, _signs in enumerate(_KINDS):
    _KIND[list(_signs.encode())] = _k + 3
_KIND[256] = 0
N_KINDS = len(_KINDS) + 3
#: Buckets for three bytes in a row.
N_HASHED = 1024
#: The last feature is how much of a passage repeats what it had before.
N_FEATURES = N_KINDS**3 + N_HASHED + 1
END = 256


def passages(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, passage of each byte in it or -1, first passage of each text): passages are the stretches of ``size`` bytes of a text.

    The last passage of a text may be shorter; an empty text has one that is empty. Two ends stand behind each text.
    """
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // size))
    first = np.cumsum(counts) - counts
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    buffer = np.full(int((sizes + 2).sum()), END, np.int16)
    owner = np.full(len(buffer), -1, np.int64)
    for text, at, n, p in zip(texts, starts.tolist(), sizes.tolist(), first.tolist()):
        buffer[at : at + n] = np.frombuffer(text or b"", np.uint8)
        owner[at : at + n] = p + np.arange(n) // size
    return buffer, owner, first


def features(buffer: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(passages, features): roots of the shares of what begins at each byte: three kinds of bytes, and three bytes in a row;
    and the share of places whose three bytes stand elsewhere in the passage, too."""
    at = np.flatnonzero(owner >= 0)
    one, two, three = (buffer[at + k].astype(np.int64) for k in range(3))
    kinds = (_KIND[one] * N_KINDS + _KIND[two]) * N_KINDS + _KIND[three]
    hashed = (((one * 257 + two) * 257 + three) * 0x9E3779B1 >> 12) % N_HASHED + N_KINDS**3
    row = owner[at] * N_FEATURES
    x = np.bincount(row + kinds, minlength=n * N_FEATURES)
    x += np.bincount(row + hashed, minlength=n * N_FEATURES)
    x = np.sqrt(x, dtype=np.float32).reshape(n, N_FEATURES)
    sizes = np.maximum(1, np.bincount(owner[at], minlength=n))
    different = np.count_nonzero(x[:, N_KINDS**3 :], axis=1)
    x /= np.sqrt(sizes)[:, None].astype(np.float32)
    x[:, -1] = np.where(different > 0, 1 - different / sizes, 0)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """h = tanh(x W + b) encodes a passage; its weight in the text is the softmax of w (tanh(h V) * sigmoid(h U)); the text is the weighted sum of
    its passages' h, and its score sigmoid(h c + d)."""

    encode: np.ndarray
    shift: np.ndarray
    tanh_gate: np.ndarray
    sigmoid_gate: np.ndarray
    attend: np.ndarray
    judge: np.ndarray
    level: np.ndarray

    @classmethod
    def fresh(cls, n_features: int = N_FEATURES, width: int = 16, gates: int = 8, seed: int = 11, kind=np.float32) -> AttentionModel:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(kind)
        return cls(draw(n_features, width, s=0.3), np.zeros(width, kind), draw(width, gates, s=width**-0.5), draw(width, gates, s=width**-0.5), draw(gates, s=0.3), draw(width, s=0.3), np.zeros(1, kind))

    def weights(self) -> list[np.ndarray]:
        return [self.encode, self.shift, self.tanh_gate, self.sigmoid_gate, self.attend, self.judge, self.level]

    def encoded(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.encode + self.shift)

    def _attention(self, h: np.ndarray, first: np.ndarray, owner: np.ndarray):
        t, s = np.tanh(h @ self.tanh_gate), _sigmoid(h @ self.sigmoid_gate)
        e = (t * s) @ self.attend
        e = np.exp(e - np.maximum.reduceat(e, first)[owner])
        return t, s, e / np.add.reduceat(e, first)[owner]

    def scores(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts whose encoded passages are ``h`` and start at ``first``: the scores, and the attention of every passage."""
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        a = self._attention(h, first, owner)[2]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return _sigmoid(z @ self.judge + self.level), a

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The weighted mean cross-entropy of the texts' labels ``y`` and its gradients."""
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = self.encoded(x)
        t, s, a = self._attention(h, first, owner)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        p = _sigmoid(z @ self.judge + self.level)
        share = weight / weight.sum()
        loss = float(-(share * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum())
        d_out = (share * (p - y)).astype(h.dtype)
        d_z = np.outer(d_out, self.judge)[owner]
        d_a = (h * d_z).sum(axis=1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, first)[owner])
        d_g = np.outer(d_e, self.attend)
        d_t, d_s = d_g * s * (1 - t * t), d_g * t * s * (1 - s)
        d_h = a[:, None] * d_z + d_t @ self.tanh_gate.T + d_s @ self.sigmoid_gate.T
        d_x = d_h * (1 - h * h)
        return loss, [x.T @ d_x, d_x.sum(axis=0), h.T @ d_t, h.T @ d_s, (t * s).T @ d_e, z.T @ d_out, d_out.sum(keepdims=True)]

    def fit(self, texts: list[bytes | None], y: np.ndarray, weight: np.ndarray, *, size: int, epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 5) -> float:
        """Adam over shuffled batches of whole texts; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        w = self.weights()
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        step, mean = 0, float("nan")
        for _ in range(epochs):
            losses = []
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                buffer, owner, first = passages([texts[i] for i in pick], size)
                x = features(buffer, owner, int(max(owner.max(initial=0), first[-1])) + 1)
                loss, grads = self.gradients(x, first, y[pick], weight[pick])
                losses.append(loss)
                step += 1
                for a, g, m1, v1 in zip(w, grads, m, v):
                    m1 += 0.1 * (g - m1)
                    v1 += 0.001 * (g * g - v1)
                    a -= (rate / (1 - 0.9**step)) * m1 / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)
            mean = float(np.mean(losses))
        return mean

    def judge_texts(self, texts: list[bytes | None], *, size: int, block: int = 1024) -> tuple[np.ndarray, list[int]]:
        """Scores of whole texts, and for each the passage with the greatest attention. Features exist for ``block`` passages at a time."""
        buffer, owner, first = passages(texts, size)
        n = int(max(owner.max(initial=0), first[-1])) + 1
        at = np.flatnonzero(owner >= 0)
        cuts = np.searchsorted(owner[at], np.arange(0, n + block, block))
        parts = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            lo, hi = (int(at[a]), int(at[b - 1]) + 3) if b > a else (0, 0)
            own = owner[lo:hi] - k * block
            own[own >= block] = -1
            parts.append(self.encoded(features(buffer[lo:hi], np.where(owner[lo:hi] >= 0, own, -1), min(block, n - k * block))))
        scores, attention = self.scores(np.concatenate(parts), first)
        ends = np.append(first[1:], n)
        return scores, [int(attention[a:b].argmax()) for a, b in zip(first.tolist(), ends.tolist())]


def train(docs: DataFrame, labels: DataFrame, *, usable: Column, rows_per_label: int = 800, bytes_per_label: int = 24_000_000, size: int = 256, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AttentionModel | None:
    """Fit a model on a sample of labelled rows: at most ``rows_per_label`` of each of the labels 0 and 1, of whole texts of at most ``bytes_per_label`` together.

    ``usable`` is a condition on ``id_col`` that rows to learn from meet. Labels are counted over all usable rows; ids are drawn from them by a hash, so that
    only a bounded number of ids is broadcast to the texts. Each label weighs in training as much as it has rows
    before sampling. Other labels than 0 and 1, null labels, and labels without a document teach nothing. None if nothing is left to learn from.
    """
    known = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("l"))
    draw = F.xxhash64(F.lit("quality sample"), "i")
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rank = F.row_number().over(Window.partitionBy("l").orderBy(draw, "i"))
    ids = known.withColumn("r", rank).where(F.col("r") <= rows_per_label).drop("r").distinct()
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    found = texts.join(F.broadcast(ids), "i").withColumns({"h": draw, "n": F.octet_length("t"), "x": F.xxhash64("t")})
    # Ids may repeat in the table of texts, so the bounds are held here again.
    order = Window.partitionBy("l").orderBy("h", "i", "x")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows_per_label)
    found = found.withColumn("s", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("s") <= bytes_per_label)
    rows = sorted(found.select("l", "r", "t").collect(), key=lambda r: (r["l"], r["r"]))
    if not rows:
        return None
    y = np.array([r["l"] for r in rows], np.float32)
    taken = np.bincount(y.astype(int), minlength=2)
    weight = np.array([counts[r["l"]] / taken[r["l"]] for r in rows], np.float32)
    model = AttentionModel.fresh()
    model.fit([bytes(r["t"]) for r in rows], y, weight, size=size)
    return model


def judge(docs: DataFrame, model: AttentionModel | None, *, size: int = 256, text_col: str = "text", chunk_bytes: int = 500_000) -> DataFrame:
    """``docs`` with score (double, 0 to 1, higher where label 1 is likelier) and passage (int, the number of the passage with the greatest attention).

    A text is read whole, in passages of ``size`` bytes from its start. Null and empty texts are one empty passage each and get what the
    model gives that. Without a model all scores are 0.5 and ``passage`` is 0. Rows are independent of each other, so repeated
    rows and null ids are nothing special, and an empty table gives an empty one. Other columns pass through; those named score or
    passage are replaced. Texts are judged ``chunk_bytes`` at a time, a longer text alone; it takes about 30 bytes of memory for each of its own.
    """
    docs = docs.drop("score", "passage")
    if model is None:
        return docs.withColumns({"score": F.lit(0.5), "passage": F.lit(0)})
    kept = docs.columns
    raw = unused("raw", kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, raw, chunk_bytes):
                scores, top = model.judge_texts(part.column(raw).to_pylist(), size=size)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(scores.astype(np.float64)), pa.array(top, pa.int32())], names=[*kept, "score", "passage"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.withColumn(raw, F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, f"{fields}, score double, passage int")
