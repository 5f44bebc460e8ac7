"""Near-duplicate documents by ProbMinHash over weighted word shingles, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, give_back, small_batches, written
from .components import connected_components
from .shingles import mix, shingle_hashes, word_hashes

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def prob_minhash(keys: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """Signature of a weighted set: for each register the key that arrives there first.

    Every key is a Poisson process with its weight as rate; each arrival goes to a register drawn from the key's own random
    stream. A key is done once its next arrival would come after the latest register's first arrival. Two
    signatures agree in a register with the probability Jaccard similarity of their sets.
    """
    first = np.full(registers, np.inf)
    winner = np.zeros(registers, np.uint64)
    at = np.zeros(len(keys))
    serial = 0
    while len(keys):
        take = max(1, -(-4 * registers // len(keys)))
        steps = np.arange(serial + 1, serial + 1 + take, dtype=np.uint64) * _GOLD
        serial += take
        random = mix(keys[:, None] + steps)
        gaps = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        times = at[:, None] + np.cumsum(gaps, axis=1) / weights[:, None]
        places = (mix(random) % np.uint64(registers)).astype(np.intp)
        near = times < first[places]
        if near.any():
            t, p, k = times[near], places[near], np.broadcast_to(keys[:, None], times.shape)[near]
            order = np.argsort(-t, kind="stable")  # of several, the earliest is written last
            first[p[order]] = t[order]
            winner[p[order]] = k[order]
        at = times[:, -1]
        live = at < first.max()
        keys, weights, at = keys[live], weights[live], at[live]
    return winner


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets, given as sorted keys and weights."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    only_a, sum_a = wa.sum() - wa[ia].sum(), wa[ia]
    only_b, sum_b = wb.sum() - wb[ib].sum(), wb[ib]
    # An element's share depends on its two weights' ratio alone; few ratios occur.
    ratios, which = np.unique(sum_b / sum_a, return_inverse=True)
    gained = np.bincount(which, weights=sum_a)
    return float(sum(g / (only_a + only_b / r + np.maximum(sum_a, sum_b / r).sum()) for r, g in zip(ratios, gained)))


def weighted_shingles(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(shingle_hashes(words, size), return_counts=True)
    return keys, counts.astype(np.float64)


def sketch(docs: DataFrame, *, size: int, bands: int, rows: int) -> DataFrame:
    """(id, t1, t2, bands, registers): a hash of the whole text in two parts, one hash for each band, one byte for each register.

    Texts without words have null in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.arange(1, rows + 1, dtype=np.uint64) * _GOLD
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                words, offsets = word_hashes(part.column("text").to_pylist())
                found, registers = [], []
                for s, e in zip(offsets[:-1], offsets[1:]):
                    if s == e:
                        found.append(None)
                        registers.append(None)
                        continue
                    winners = prob_minhash(*weighted_shingles(words[s:e], size), bands * rows)
                    registers.append((winners >> np.uint64(17)).astype(np.uint8).tobytes())
                    found.append(mix((winners.reshape(bands, rows) * (spread | np.uint64(1))).sum(axis=1, dtype=np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("t1"), part.column("t2"), pa.array(found, pa.list_(pa.int64())), pa.array(registers, pa.binary())], names=["id", "t1", "t2", "bands", "registers"])
        give_back()

    return docs.select("id", "t1", "t2", "text").mapInArrow(run, "id long, t1 long, t2 long, bands array<long>, registers binary")


def verify(pairs: DataFrame, texts: DataFrame, *, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold, with their exact similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, tuple] | None = None  # pairs come sorted by a, so its shingles serve many rows
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                part = batch.slice(lo, 250)
                ids_a, ids_b = part.column("a").to_pylist(), part.column("b").to_pylist()
                words_b, at_b = word_hashes(part.column("tb").to_pylist())
                texts_a = part.column("ta")
                out = []
                for i, (a, b) in enumerate(zip(ids_a, ids_b)):
                    if held is None or held[0] != a:
                        held = a, weighted_shingles(word_hashes([texts_a[i].as_py()])[0], size)
                    s = probability_jaccard(held[1], weighted_shingles(words_b[at_b[i] : at_b[i + 1]], size))
                    if s >= threshold:
                        out.append((a, b, s))
                a, b, s = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
        give_back()

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def compact_sets(texts: DataFrame, *, size: int) -> DataFrame:
    """(rep, keys, counts) of texts (id, text): their weighted shingles, as sorted 64-bit hashes and 32-bit counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                words, offsets = word_hashes(part.column("text").to_pylist())
                keys, counts = [], []
                for s, e in zip(offsets[:-1], offsets[1:]):
                    k, n = np.unique(shingle_hashes(words[s:e], size), return_counts=True)
                    keys.append(k.tobytes())
                    counts.append(n.astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["rep", "keys", "counts"])
        give_back()

    return texts.select("id", "text").mapInArrow(run, "rep long, keys binary, counts binary")


def linking_pairs(members: DataFrame, *, threshold: float, part_rows: int = 2000) -> DataFrame:
    """Pairs (a, b) that reach the threshold, enough to connect what is linked in every bucket.

    ``members`` are (band, h, rep, c, bands, registers, keys, counts). Pairs of different components are asked for whose
    registers agree at least as often as those of a pair at the threshold do less four standard deviations (of true links at the threshold
    three in 100,000 stay under that, fewer than banding misses); each by the first band that it shares. Buckets are cut into parts of about ``part_rows`` by a
    hash, and every two parts of a bucket meet in a task of their own. Pairs come by falling agreement, and one whose ends
    verified pairs have connected is passed over; all others are verified by their exact similarity.
    """
    parts = members.groupBy("band", "h").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    dealt = members.join(parts, ["band", "h"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", "h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "c", "bands", "registers", "keys", "counts")

    def meet(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        band, i, j = rows[0][0], rows[0][2], rows[0][3]
        part = np.array([r[4] for r in rows])
        rep, c = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
        bands = np.stack([np.array(r[7], np.int64) for r in rows])
        regs = np.stack([np.frombuffer(r[8], np.uint8) for r in rows])
        m = regs.shape[1]
        p = threshold + (1 - threshold) / 256
        least = m * p - 4 * (m * p * (1 - p)) ** 0.5
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        found = []
        for lo in range(0, len(left), 64):
            l = left[lo : lo + 64]
            x, y = np.nonzero(c[l][:, None] != c[right][None, :])
            x, y = l[x], right[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            for k in range(0, len(x), 20_000):
                u, v = x[k : k + 20_000], y[k : k + 20_000]
                same = (regs[u] == regs[v]).sum(axis=1)
                near = same >= least
                u, v, same = u[near], v[near], same[near]
                own = (bands[u] == bands[v]).argmax(axis=1) == band
                found.append((u[own], v[own], same[own]))
        if not found:
            return rep[:0], rep[:0]
        x, y, same = (np.concatenate(f) for f in zip(*found))
        order = np.argsort(-same, kind="stable")
        parent = {}

        def root(v: int) -> int:
            while parent.get(v, v) != v:
                parent[v] = parent.get(parent[v], parent[v])
                v = parent[v]
            return v

        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def weighted(v: int) -> tuple[np.ndarray, np.ndarray]:
            if v not in sets:
                sets[v] = np.frombuffer(rows[v][9], np.uint64), np.frombuffer(rows[v][10], np.uint32).astype(np.float64)
            return sets[v]

        a, b = [], []
        for u, v in zip(x[order].tolist(), y[order].tolist()):
            cu, cv = root(int(c[u])), root(int(c[v]))
            if cu == cv:
                continue
            if probability_jaccard(weighted(u), weighted(v)) >= threshold:
                parent[max(cu, cv)] = min(cu, cv)
                a.append(min(rep[u], rep[v]))
                b.append(max(rep[u], rep[v]))
        return np.array(a, np.int64), np.array(b, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:4] != held[0][:4]:
                    out.append(meet(held))
                    held = []
                    if len(out) >= 1000:
                        yield rows()
                held.append(row)
        if held:
            out.append(meet(held))
        yield rows()
        give_back()

    order = ["band", "h", "i", "j"]
    return units.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, size: int = 5, bands: int = 25, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, class_id, kept) for each row of ``docs``: class_id is the smallest id of its near-duplicate class.

    Texts are weighted sets of runs of ``size`` words (white space between words; a shorter text is one run). Two texts are
    linked if their probability Jaccard similarity is at least ``threshold``; classes are the linked texts'
    components. Equal texts count once from the first step on and share a class. Candidates share a band of
    ``rows`` registers. Each bucket's members are first verified against the text of its smallest hash; then, in large buckets
    that still hold several components, against a few others; then, in all that do, pairs across components whose
    registers can agree with the threshold, until what links is connected.
    Null, empty and blank texts link with nothing. Rows of one id share their classes through that id; a null id
    has class null and is kept. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    given = given.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), F.col("text"))})
    sketches = written(sketch(given, size=size, bands=bands, rows=rows), "sketches")
    usable = sketches.where(F.col("id").isNotNull() & F.col("bands").isNotNull())
    sets = written(usable.groupBy("t1", "t2").agg(F.min("id").alias("least"), F.first("bands").alias("bands"), F.first("registers").alias("registers")).withColumn("rep", F.col("t1")), "sets")
    # A text's own hash stands for it, as one id may have several texts; ids come in at the end.
    texts = sets.select("t1", "t2", "rep", "least")
    buckets = written(sets.select("rep", F.posexplode("bands").alias("band", "h")), "buckets")
    shared = buckets.groupBy("band", "h").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z").select("band", "h", "a")
    members = written(buckets.join(shared, ["band", "h"]), "members")
    # From here on only texts that share a bucket with another one count.
    # One row gives a text, that of its least id, so copies are never gathered.
    asked = texts.join(members.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("t1"), F.col("least").alias("id"))
    bodies = written(given.join(asked, ["t1", "id"], "left_semi").dropDuplicates(["t1", "id"]).select(F.col("t1").alias("id"), "text"), "bodies")
    first = written(members.where("a != rep").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    links = written(verify(first, bodies, size=size, threshold=threshold), "links")
    labels = connected_components(links)
    discard(links, buckets)

    def mixed(labels: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with their components and the bucket's size."""
        labelled = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("band", "h", "rep", F.coalesce("component", "rep").alias("c"))
        several = labelled.groupBy("band", "h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("band", "h", "n")
        return written(labelled.join(several, ["band", "h"]), "mixed")

    several = mixed(labels)
    large = several.where((F.col("n") >= 64) & (F.col("band") < 5))
    order = F.row_number().over(Window.partitionBy("band", "h").orderBy(F.xxhash64("rep")))
    pivots = large.withColumn("k", order).where("k <= 16").select("band", "h", F.col("rep").alias("p"), F.col("c").alias("pc"))
    second = large.join(pivots, ["band", "h"]).where("c != pc").select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct()
    second = written(second.join(first, ["a", "b"], "left_anti"), "pairs")
    links = written(verify(second, bodies, size=size, threshold=threshold), "links")
    discard(several)
    labels = connected_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links.select("a", "b")))

    discard(links)
    open_ = several = mixed(labels)
    asked = open_.select(F.col("rep").alias("id")).distinct()
    open_ = open_.join(sets.select("rep", "bands", "registers"), "rep").join(compact_sets(bodies.join(asked, "id", "left_semi"), size=size), "rep")
    links = written(linking_pairs(open_, threshold=threshold).distinct(), "links")
    # The texts of one id are linked by it.
    owned = usable.select("id", "t1").distinct()
    shared_ids = owned.groupBy("id").agg(F.min("t1").alias("a"), F.max("t1").alias("z")).where("a != z").select("id", "a")
    by_id = owned.join(shared_ids, "id").where("a != t1").select("a", F.col("t1").alias("b"))
    classes = connected_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links.select("a", "b")).union(by_id))
    discard(several, members, bodies, first, second, links)
    named = written(texts.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("t1", "t2", "least", F.coalesce("component", "rep").alias("c")), "classes")
    smallest = named.groupBy("c").agg(F.min("least").alias("class_id"))
    named = named.join(smallest, "c").select("t1", "t2", "class_id")
    rows = written(sketches.select("id", "t1", "t2", F.col("bands").isNotNull().alias("has")), "rows")
    discard(sets, sketches)
    out = rows.join(named, ["t1", "t2"], "left")
    cls = F.when(F.col("has") & F.col("id").isNotNull(), F.col("class_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), cls.alias("class_id"), F.coalesce(cls == F.col("id"), F.lit(True)).alias("kept"))
