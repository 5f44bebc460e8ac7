"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import byte_slices, give_back, small_batches, unused
from .tokens import release

PAD = 256  # stands after the end of a short window
UND = "und"


def _squash(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Softsign in place: as a squashing function it costs a fraction of exp or tanh."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare
    return x


@dataclass
class ByteNetwork:
    """Two gated recurrent layers, one for each direction, and a softmax over languages at every position.

    ``tables[d][k]`` holds the input weights of each byte (257 x h) and ``inner[d][k]`` the recurrent weights (h x h), with k the
    reset gate, the update gate and the candidate. Gates are (1 + softsign) / 2, candidates softsign. Windows of
    bytes stand time-major, as (positions, windows).
    """

    languages: list[str]
    tables: list[list[np.ndarray]]
    inner: list[list[np.ndarray]]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int = 7) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        tables = [[draw(257, hidden, s=0.5) for _ in range(3)] for _ in range(2)]
        inner = [[draw(hidden, hidden, s=hidden**-0.5) for _ in range(3)] for _ in range(2)]
        return cls(languages, tables, inner, draw(2 * hidden, len(languages), s=0.3), np.zeros(len(languages), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.tables[0], *self.tables[1], *self.inner[0], *self.inner[1], self.out, self.bias]

    def _states(self, x: np.ndarray, d: int, keep: bool = False):
        """States of direction ``d`` at each position; with ``keep`` also what backpropagation needs."""
        steps, n = x.shape
        h = self.out.shape[0] // 2
        states = np.empty((steps, n, h), self.out.dtype)
        saved = []
        s = np.zeros((n, h), self.out.dtype)
        r, z, c, spare = (np.empty_like(s) for _ in range(4))
        # After a window's end the state is 0, so the backward direction begins at the window's last byte, whatever else is in the batch.
        ended = x == PAD
        some_ended = ended.any(axis=1)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            if keep:
                r, z, c = np.empty_like(s), np.empty_like(s), np.empty_like(s)
            for gate, k in ((r, 0), (z, 1)):
                np.matmul(s, self.inner[d][k], out=gate)
                np.take(self.tables[d][k], x[t], axis=0, out=spare, mode="clip")
                gate += spare
                _squash(gate, spare)
                gate += 1
                gate *= 0.5
            np.multiply(r, s, out=spare)
            np.matmul(spare, self.inner[d][2], out=c)
            np.take(self.tables[d][2], x[t], axis=0, out=spare, mode="clip")
            c += spare
            _squash(c, spare)
            if keep:
                saved.append((t, s, r, z, c))
            new = states[t]
            np.subtract(s, c, out=new)
            new *= z
            new += c
            if some_ended[t]:
                new[ended[t]] = 0
            s = new
        return states, saved

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(positions, windows, languages): the label distribution of every position."""
        h = self.out.shape[0] // 2
        e = self._states(x, 0)[0] @ self.out[:h]
        e += self._states(x, 1)[0] @ self.out[h:]
        e += self.bias
        top = e[..., :1].copy()
        for k in range(1, e.shape[2]):
            np.maximum(top, e[..., k : k + 1], out=top)
        e -= top
        np.exp(e, out=e)
        e /= (e @ np.ones((e.shape[2], 1), e.dtype))
        return e

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the positions of the windows, each labelled ``y``, and its gradients through time."""
        h = self.out.shape[0] // 2
        (hf, sf), (hb, sb) = self._states(x, 0, True), self._states(x, 1, True)
        both = np.concatenate([hf, hb], axis=2)
        e = both @ self.out + self.bias
        e -= e.max(axis=2, keepdims=True)
        p = np.exp(e)
        p /= p.sum(axis=2, keepdims=True)
        real = (x != PAD).astype(p.dtype)
        total = max(1.0, float(real.sum()))
        loss = float(-(np.log(p[:, np.arange(x.shape[1]), y] + 1e-12) * real).sum() / total)
        p[:, np.arange(x.shape[1]), y] -= 1
        p *= real[:, :, None] / total
        d_out = np.tensordot(both, p, axes=((0, 1), (0, 1)))
        d_both = p @ self.out.T
        d_tables = [[np.zeros_like(a) for a in tables] for tables in self.tables]
        d_inner = [[np.zeros_like(a) for a in inner] for inner in self.inner]
        for d, saved in ((0, sf), (1, sb)):
            later = np.zeros((x.shape[1], h), p.dtype)
            u = self.inner[d]
            for t, s, r, z, c in reversed(saved):
                ds = (d_both[t, :, d * h : (d + 1) * h] + later) * real[t][:, None]
                dc = ds * (1 - z) * (1 - np.abs(c)) ** 2
                drs = dc @ u[2].T
                dr = drs * s * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                dz = ds * (s - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                for k, (a, g) in enumerate(((s, dr), (s, dz), (r * s, dc))):
                    d_inner[d][k] += a.T @ g
                    np.add.at(d_tables[d][k], x[t], g)
                later = ds * z + drs * r + dr @ u[0].T + dz @ u[1].T
        return loss, [*d_tables[0], *d_tables[1], *d_inner[0], *d_inner[1], d_out, p.sum(axis=(0, 1))]

    def fit(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 5, batch: int = 128, rate: float = 0.01, seed: int = 7) -> float:
        """Adam over shuffled batches of windows; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        w = self.weights()
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        step, mean = 0, float("nan")
        for _ in range(epochs):
            losses = []
            order = rng.permutation(x.shape[1])
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                loss, grads = self.gradients(x[:, pick], y[pick])
                losses.append(loss)
                step += 1
                for a, g, m1, v1 in zip(w, grads, m, v):
                    m1 += 0.1 * (g - m1)
                    v1 += 0.001 * (g * g - v1)
                    a -= (rate / (1 - 0.9**step)) * m1 / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)
            mean = float(np.mean(losses))
        return mean

    def classify(self, texts: list[bytes], length: int, block: int = 1024) -> np.ndarray:
        """(texts, languages): mean of the label distributions over all positions of each text; no row may be empty."""
        windows = np.array([-(-len(t) // length) for t in texts])
        x = np.full((int(windows.sum()), length), PAD, np.int16)
        firsts = np.concatenate([[0], np.cumsum(windows)])
        flat = x.reshape(-1)
        for t, at in zip(texts, firsts):
            flat[at * length : at * length + len(t)] = np.frombuffer(t, np.uint8)
        # Windows of like length stand together, so that short texts cost as many steps as they have bytes.
        used = (x != PAD).sum(axis=1)
        order = np.argsort(used, kind="stable")
        sums = np.empty((len(x), len(self.languages)), np.float32)
        for at in range(0, len(order), block):
            pick = order[at : at + block]
            steps = int(used[pick[-1]])
            part = np.ascontiguousarray(x[pick, :steps].T).astype(np.intp)
            p = self.probabilities(part)
            if used[pick[0]] < steps:
                p *= (part != PAD)[:, :, None]
            sums[pick] = p.sum(axis=0)
        pooled = np.add.reduceat(sums.astype(np.float64), firsts[:-1], axis=0)
        return pooled / np.array([len(t) for t in texts])[:, None]


def training_windows(text: Column, length: int, each: int) -> Column:
    """Up to ``each`` windows of ``length`` bytes from evenly spread places of a text, as a list of binaries."""
    raw = text.cast("binary")
    size = F.octet_length(text)
    n = F.least(F.lit(each), F.ceil(size / length)).cast("int")
    start = lambda k: F.greatest(size - length, F.lit(0)) * k / F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(raw, F.floor(start(k)).cast("int") + 1, F.lit(length)))


def train(docs: DataFrame, *, usable: Column, rows_per_language: int = 300, windows_per_text: int = 8, length: int = 64, hidden: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNetwork | None:
    """Fit a network on a sample of at most ``rows_per_language`` labelled texts a language where ``usable`` holds.

    Languages are counted over all usable rows; each is then sampled by a hash of the id at a rate that gives the bound
    one and a half times over, and cut at the bound. Only ``windows_per_text`` windows of ``length`` bytes of each text leave the executors, so the
    driver gets a bounded number of bytes a language, at any input size and length of texts. (Windows are shorter here than in ``identify``: they
    give more different beginnings and ends to learn from, and a state does not depend on the window's length.) None if no
    usable row has a label and a text.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.xxhash64(F.lit("language sample"), F.col(id_col)).alias("h"))
    counts = known.groupBy("l").agg(F.count("*").alias("n"))
    rate = F.least(F.lit(1.0), F.lit(1.5 * (rows_per_language + 10)) / F.col("n"))
    bar = F.when(rate >= 1.0, F.lit(2**63 - 1)).otherwise((rate * 2.0**64 - 2.0**63).cast("long"))
    drawn = known.join(F.broadcast(counts.select("l", bar.alias("bar"))), "l").where(F.col("h") <= F.col("bar"))
    # Rows with one id have one hash; the bound holds for them, too.
    order = F.row_number().over(Window.partitionBy("l").orderBy("h", F.xxhash64("t")))
    taken = drawn.withColumn("r", order).where(F.col("r") <= rows_per_language).select("l", "r", training_windows(F.col("t"), length, windows_per_text).alias("w"))
    rows = sorted(taken.collect(), key=lambda r: (r["l"], r["r"]))
    if not rows:
        return None
    languages = sorted({r["l"] for r in rows})
    windows = [(languages.index(r["l"]), w) for r in rows for w in r["w"]]
    x = np.full((len(windows), length), PAD, np.int16)
    for row, (_, w) in zip(x, windows):
        row[: len(w)] = np.frombuffer(w, np.uint8)
    network = ByteNetwork.fresh(languages, hidden)
    network.fit(np.ascontiguousarray(x.T), np.array([label for label, _ in windows]))
    return network


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, network: ByteNetwork | None, *, length: int = 128, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1_000_000) -> DataFrame:
    """``docs`` with lang_pred and score, from every byte of every text.

    A text is read in windows of ``length`` bytes; every position is labelled and the document's probabilities are the means
    over its positions. lang_pred is the likeliest language (ties: the first in order), score its
    probability. Null texts, texts without a letter, and all texts where nothing was learned get `und` and 0.0. Other
    columns pass through, except that lang_pred and score are replaced. Empty tables give none. Texts are read ``chunk_bytes`` at a time, a
    longer text alone; it takes about ten bytes of memory for each of its own.
    """
    letters = has_letter(F.col(text_col))
    docs = docs.drop("lang_pred", "score")
    if network is None:
        return docs.withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in byte_slices(batch, text_col, chunk_bytes):
                texts, usable = part.column(text_col).to_pylist(), part.column(mark).to_pylist()
                rows = [i for i, ok in enumerate(usable) if ok]
                langs, scores = [UND] * len(texts), [0.0] * len(texts)
                if rows:
                    p = network.classify([texts[i].encode() for i in rows], length)
                    for i, best, top in zip(rows, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                        langs[i], scores[i] = network.languages[best], min(1.0, top)
                arrays = [part.column(c) for c in kept] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "lang_pred", "score"])
        give_back()

    kept = docs.columns
    mark = unused("letters", kept)
    small_batches(docs.sparkSession)
    given = docs.withColumn(mark, letters)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return given.mapInArrow(run, f"{fields}, lang_pred string, score double")
