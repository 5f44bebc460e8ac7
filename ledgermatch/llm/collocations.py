"""Phrases of two to four words that belong together, from exact counts in quotient filters that tasks fill and merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, give_back, new_path, small_batches, task_number, written
from .quotient_filter import Counts, Packing, decode, encode, merged

LONGEST = 4
#: A to Z folded; the signs that part pieces, and line ends, become line feeds; tabs become spaces.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else 10 if i in b".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i for i in range(256))
#: Numbers of the empty string (between two spaces) and of a piece's end in a chunk; words follow.
_NOTHING, _CUT = 0, 1


class _Chunk:
    """Texts of one language, as numbers of their words by first occurrence."""

    def __init__(self):
        self.known: dict[bytes, int] = {b"": _NOTHING, b"\n": _CUT}
        self.numbers: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> int:
        known = self.known
        parts = text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        numbers = np.array([known.setdefault(w, len(known)) for w in parts], np.uint32)
        numbers = np.append(numbers[numbers != _NOTHING], np.uint32(_CUT))
        self.numbers.append(numbers)
        self.size += len(numbers)
        return len(numbers)

    def row(self) -> tuple[list[bytes], np.ndarray, bytes]:
        """The words, how often each occurs, and the pressed numbers of the texts."""
        numbers = np.concatenate(self.numbers)
        keep = np.append(True, (numbers[1:] != _CUT) | (numbers[:-1] != _CUT))
        numbers = numbers[keep]
        counts = np.bincount(numbers, minlength=len(self.known))[2:]
        narrow = numbers.astype("<u2") if len(self.known) < 65536 else numbers.astype("<u4")
        return list(self.known)[2:], counts, bytes([narrow.itemsize]) + len(numbers).to_bytes(8, "little") + pa.compress(narrow.tobytes(), codec="zstd", asbytes=True)


def _numbers(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    return np.frombuffer(pa.decompress(blob[9:], n * width, codec="zstd", asbytes=True), f"<u{width}").astype(np.int64)


def chunk_words(docs: DataFrame, *, words_per_chunk: int) -> DataFrame:
    """(chunk, lang, words, counts, numbers) of the texts of a partition, some ``words_per_chunk`` words at a time; docs has lang and raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = task_number() << 32
        open_chunks: dict[str, _Chunk] = {}
        total = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal made, total
            for lang, chunk in open_chunks.items():
                words, counts, blob = chunk.row()
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([lang]), pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["chunk", "lang", "words", "counts", "numbers"])
                made += 1
            open_chunks.clear()
            total = 0

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("raw")):
                raw = text.as_py()
                if raw:
                    total += open_chunks.setdefault(lang, _Chunk()).add(raw)
                    if total >= words_per_chunk:
                        yield from rows()
        yield from rows()
        give_back()

    return docs.mapInArrow(run, "chunk long, lang string, words array<binary>, counts array<bigint>, numbers binary")


def number_words(frequent: DataFrame, parts: int = 64) -> DataFrame:
    """``frequent`` (lang, word, n) with id: 1, 2, ... within each lang. Words are dealt to parts by a hash and numbered in each; part sizes give the offsets."""
    dealt = frequent.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)))
    dealt = dealt.withColumn("local", F.row_number().over(Window.partitionBy("lang", "part").orderBy("word")))
    sizes = dealt.groupBy("lang", "part").agg(F.max("local").alias("size"))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("lang", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    return dealt.join(offsets, ["lang", "part"]).select("lang", "word", "n", (F.col("offset") + F.col("local")).cast("int").alias("id"))


def _filters(rows: DataFrame) -> DataFrame:
    """(lang, size, segment, bits, segment_bits, filter): for each chunk and phrase size the counts of its phrases, a filter for each segment of keys.

    ``rows`` has the chunks' numbers, the ids of their frequent words as (place, id), the greatest id of the lang, and its segment_bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, top, segment_bits = (batch.column(k)[i].as_py() for k in ("lang", "top", "segment_bits"))
                numbers = _numbers(batch.column("numbers")[i].as_py())
                pairs = batch.column("ids")[i].values
                ids = np.zeros(int(numbers.max(initial=1)) + 1, np.int64)
                ids[pairs.field("at").to_numpy(zero_copy_only=False) + 2] = pairs.field("id").to_numpy(zero_copy_only=False)
                ids = ids[numbers]
                bits = int(top).bit_length()
                valid = ids > 0
                for size in range(2, LONGEST + 1):
                    if len(ids) < size:
                        break
                    valid = valid[:-1] & (ids[size - 1 :] > 0)
                    at = np.flatnonzero(valid)
                    if not len(at):
                        break
                    packing = Packing(size, bits)
                    prefix_bits = min(segment_bits, packing.left_bits)
                    counts = Counts.of(packing, *packing.keys([ids[at + k] for k in range(size)]))
                    prefix = (counts.left >> np.uint64(packing.left_bits - prefix_bits)).astype(np.int64)
                    heads = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
                    blobs = [encode(packing, Counts(counts.left[a:b], counts.right[a:b], counts.times[a:b]), prefix_bits) for a, b in zip(heads, np.append(heads[1:], len(prefix)))]
                    n = len(heads)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([size] * n, pa.int32()), pa.array(prefix[heads]), pa.array([bits] * n, pa.int32()), pa.array([prefix_bits] * n, pa.int32()), pa.array(blobs, pa.binary())], names=["lang", "size", "segment", "bits", "segment_bits", "filter"])
        give_back()

    return rows.mapInArrow(run, "lang string, size int, segment long, bits int, segment_bits int, filter binary")


def _merge(filters: DataFrame, least: int) -> DataFrame:
    """(lang, ids, f): phrases that occur ``least`` times or more, from the filters of all chunks, merged by segment."""

    def run(table: pa.Table) -> pa.Table:
        lang, size, segment, bits, segment_bits = (table.column(k)[0].as_py() for k in ("lang", "size", "segment", "bits", "segment_bits"))
        packing = Packing(size, bits)
        counts = merged(packing, [decode(packing, blob.as_py(), segment, segment_bits) for blob in table.column("filter")])
        often = counts.times >= least
        ids = np.stack(packing.numbers(counts.left[often], counts.right[often]), axis=1).astype(np.int32)
        n = len(ids)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(ids.reshape(-1)))
        out = pa.Table.from_arrays([pa.array([lang] * n, pa.string()), lists, pa.array(counts.times[often])], names=["lang", "ids", "f"])
        del counts
        give_back()
        return out

    return filters.groupBy("lang", "size", "segment").applyInArrow(run, "lang string, ids array<int>, f bigint")


def phrase_counts(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 30, words_per_chunk: int = 1_000_000, words_per_segment: int = 3_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, sizes): all phrases of 1 to 4 words that occur ``least`` times or more in their lang as (lang, ids, f); the words behind the
    ids as (lang, word, n, id); and (lang, n, top, segment_bits), where n counts all words of the lang and top is its greatest id.

    Only words that occur ``least`` times can be in such a phrase, so others part the text as signs do. All three are written tables.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    path = new_path(spark, "phrase-chunks")
    chunk_words(texts, words_per_chunk=words_per_chunk).write.parquet(path)
    chunks = spark.read.parquet(path)
    chunks._written_to = path
    found = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("chunk", "lang", "at", F.col("w.words").cast("string").alias("word"), F.col("w.counts").alias("c"))
    frequent = found.groupBy("lang", "word").agg(F.sum("c").alias("n")).where(F.col("n") >= least)
    words = written(number_words(frequent), "phrase-words")
    totals = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    tops = words.groupBy("lang").agg(F.max("id").alias("top"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / words_per_segment))).cast("int")
    sizes = written(totals.join(tops, "lang").withColumn("segment_bits", bits), "phrase-sizes")
    ids = found.select("chunk", "lang", "at", "word").join(words.select("lang", "word", "id"), ["lang", "word"])
    ids = ids.groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("ids"))
    rows = chunks.select("chunk", "lang", "numbers").join(ids, "chunk").join(sizes.select("lang", "top", "segment_bits"), "lang")
    counted = _merge(_filters(rows), least)
    phrases = written(counted.unionByName(words.select("lang", F.array("id").alias("ids"), F.col("n").alias("f"))), "phrases")
    discard(chunks)
    return phrases, words, sizes


def _parts(ids: Column, size: int) -> Column:
    """All cuts of a phrase of ``size`` words as (k, left, part): its first k words, and the others."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), (F.slice(ids, 1, k) if left else F.slice(ids, k + 1, size - k)).alias("part")) for k in range(1, size) for left in (True, False)])


def _inside(ids: Column, size: int) -> Column:
    """All stretches of two words or more that a phrase of ``size`` words holds beside itself."""
    return F.array(*[F.slice(ids, i + 1, n) for n in range(2, size) for i in range(size - n + 1)])


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int = 2000, scale: int = 2_000_000, inside_percent: int = 80, words_per_chunk: int = 1_000_000, words_per_segment: int = 3_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each lang, whatever other columns ``docs`` has.

    A to Z are folded, texts parted into pieces at . , ; : ! ? and line ends, and pieces into words at spaces and tabs. Candidates are phrases of 2 to
    4 words of a piece that occur a >= ``least`` times in their lang, overlaps included. Cutting one after its first k words gives l and r, the
    occurrences of both parts, and the score floor(``scale`` * a / (l + r)); the cut of the lowest score counts (ties: the smallest k). A
    candidate goes if it lies in a longer one that occurs at least ``inside_percent`` % as often. Order: score and a descending, phrase
    ascending by bytes. n counts all words of the lang. Arithmetic is exact, in decimals.

    A null lang counts as `und`; null and empty texts have no words; repeated rows count each time; ids are not looked at. A lang without candidates has no row.

    A chunk of about ``words_per_chunk`` words of consecutive texts numbers its words; these meet the frequent words of all chunks once. The
    chunk's phrases then fill quotient filters over permuted tuples of ids, in segments of keys; a task merges the filters of a
    segment, of which there are so many that one has about ``words_per_segment`` phrases of a size, however many texts a lang has.
    """
    phrases, words, sizes = phrase_counts(docs, lang_col=lang_col, text_col=text_col, least=least, words_per_chunk=words_per_chunk, words_per_segment=words_per_segment)
    candidates = phrases.where(F.size("ids") >= 2)
    by_size = lambda of: F.coalesce(*[F.when(F.size("ids") == n, of(F.col("ids"), n)) for n in range(2, LONGEST + 1)])
    cut = candidates.select("lang", "ids", F.col("f").alias("a"), F.explode(by_size(_parts)).alias("p")).select("lang", "ids", "a", "p.*")
    counted = cut.join(phrases.select("lang", F.col("ids").alias("part"), "f"), ["lang", "part"])
    side = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f")))
    sides = counted.groupBy("lang", "ids", "a").agg(*[side(k, left).alias(f"{'l' if left else 'r'}{k}") for k in range(1, LONGEST) for left in (True, False)])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = lambda k: F.expr(f"cast({scale} as decimal(18,0)) * cast(a as decimal(20,0)) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    cuts = F.array_min(F.filter(F.array(*[F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, LONGEST)]), lambda c: c["score"].isNotNull()))
    scored = sides.select("lang", "ids", "a", cuts.alias("best")).select("lang", "ids", "a", "best.l", "best.r", "best.score")
    longer = candidates.where(F.size("ids") >= 3).select("lang", F.explode(by_size(lambda ids, n: _inside(ids, n) if n > 2 else F.lit(None))).alias("ids"), "f").groupBy("lang", "ids").agg(F.max("f").alias("most"))
    kept = scored.join(longer, ["lang", "ids"], "left").where(F.col("most").isNull() | (F.lit(100).cast("decimal(3,0)") * wide("most") < F.lit(inside_percent).cast("decimal(5,0)") * wide("a")))
    # Ties at the border stay until their words are there to order them. A lang's phrases are ranked in parts first, so the task that ranks them all gets few.
    first = kept.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(64)))
    for part in (["lang", "part"], ["lang"]):
        first = first.withColumn("r0", F.rank().over(Window.partitionBy(*part).orderBy(F.desc("score"), F.desc("a")))).where(F.col("r0") <= top)
    first = first.drop("r0", "part")
    spelled = first.select("lang", "ids", F.posexplode("ids").alias("at", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    spelled = spelled.groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    out = first.join(spelled, ["lang", "ids"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return out.join(sizes.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^ \t]+') as ws from p),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) as g from w, (select unnest([1, 2, 3, 4]) as k)),
f as (select lang, k as size, g, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
c as (select * from f where size >= 2 and f >= 30),
cuts as (select lang, size, g, f as a, unnest(range(1, size)) as k from c),
s as (select cuts.*, l.f as l, r.f as r, ((2000000::hugeint * a) // (l.f::hugeint + r.f))::bigint as score
      from cuts join f l on l.lang = cuts.lang and l.g = cuts.g[1:k] join f r on r.lang = cuts.lang and r.g = cuts.g[k + 1:cuts.size]),
b as (select * from s qualify row_number() over (partition by lang, g order by score, k) = 1),
x as (select lang, size, f, unnest([2, 3]) as m, g from c where size >= 3),
y as (select lang, f, unnest(list_transform(range(1, size - m + 2), lambda i: g[i:i + m - 1])) as g from x where m < size),
z as (select lang, g, max(f) as most from y group by all),
k as (select b.*, array_to_string(b.g, ' ') as phrase from b left join z on z.lang = b.lang and z.g = b.g where z.most is null or 100 * z.most::hugeint < 80 * b.a::hugeint)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from k join n on n.lang = k.lang qualify rank <= 2000
"""
