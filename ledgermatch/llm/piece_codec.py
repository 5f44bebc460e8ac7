"""SentencePiece encoding and decoding as joins with the piece table, and a fold over each word's lattice."""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import give_back, small_batches, task_number, written

SPACE = "▁"  # stands for a space in pieces
#: Longest word whose boundaries fit in the merging fold's number.
LONGEST = 60
_WORDS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_WORD, _BYTES = 1, 6  # piece types


class PieceModel:
    """What encoding needs of a model file: its pieces, its kind, and the characters that no longer piece holds."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.path = path
        self.bpe = model.trainer_spec.model_type == 2
        self.prefix = model.normalizer_spec.add_dummy_prefix
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only identity normalization with byte fallback is supported")
        self.pieces = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == _WORD]
        self.first_byte = next(i for i, p in enumerate(model.pieces) if p.type == _BYTES)
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in self.pieces) or any("\n" in p for _, p, _ in self.pieces):
            raise ValueError("pieces must not reach over a space or line end")
        self.longest = max(len(p) for _, p, _ in self.pieces)
        self.unknown = min(s for _, _, s in self.pieces) - 10.0
        order = sorted(self.pieces, key=lambda p: (-p[2], p[0]))
        ranks, last = {}, 0
        for i, (number, _, score) in enumerate(order):
            last = last if i and score == order[last][2] else i
            ranks[number] = last
        self.by_piece = {p: (i, s, ranks[i]) for i, p, s in self.pieces}

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score, rank), one row for each piece: as large as the vocabulary, whatever the input."""
        return spark.createDataFrame([(p, *x) for p, x in self.by_piece.items()], "piece string, id int, score double, rank int")


def words_in(text: str, prefix: bool = True) -> list[str]:
    """The text's words: cut before runs of spaces and around line feeds, which no piece crosses. No words for an empty text."""
    return _WORDS.findall((SPACE if prefix else "") + text.replace(" ", SPACE)) if text else []


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``words`` (with columns w, a number of each row, and word) with edges: every substring that is a piece, as (rank, start, end, id, score).

    Substrings are exploded by start and length, joined with the piece table and grouped by the word's number; edges come in
    ascending order. The first character's row stays also where it is no piece, so that every word has a row. Where ``words`` is
    partitioned by one of its other columns, nothing is shuffled.
    """
    keys = [c for c in words.columns if c not in ("w", "word")]
    starts = words.select("w", *keys, "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s"))
    cut = starts.select("w", *keys, "word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("s")))).alias("n"))
    cut = cut.withColumn("piece", F.expr("substring(word, s + 1, n)"))
    found = cut.join(F.broadcast(pieces), "piece", "left").where("id is not null or s = 0 and n = 1")
    edges = found.select("w", *keys, "word", F.when(F.col("id").isNotNull(), F.struct("rank", F.col("s").alias("start"), (F.col("s") + F.col("n")).alias("end"), "id", "score")).alias("edge"))
    return edges.groupBy("w", *keys).agg(F.first("word").alias("word"), F.array_sort(F.collect_list("edge")).alias("edges"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used and inside which lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def merge_fold(word: Column, edges: Column) -> Column:
    """Starts of the tokens and the word's end, for models that merge: a fold that keeps the boundaries as bits.

    Each step takes the applicable edge of the best rank, leftmost first. An edge is applicable if it starts and ends at
    boundaries and has just one between, so it joins two tokens. For words of at most 60 characters.
    """
    n = F.length(word)
    joining = F.transform(F.filter(edges, lambda e: e["end"] - e["start"] > 1), lambda e: F.struct((_bit(e["start"]).bitwiseOR(_bit(e["end"]))).alias("ends"), (_bit(e["end"]) - _bit(e["start"] + 1)).alias("inside")))

    def fold(joins: Column) -> Column:
        def step(mask: Column, _: Column) -> Column:
            best = F.get(F.filter(joins, lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(mask.bitwiseAND(e["inside"])) == 1)), F.lit(0))
            return F.coalesce(mask.bitwiseAND(F.bitwise_not(best["inside"])), mask)

        # Joining n characters takes at most as many steps as there are pieces of two and more characters, and n - 1.
        return F.aggregate(F.slice(joins, F.lit(1), F.greatest(n - 1, F.lit(0))), _bit(n + 1) - 1, step)

    return _let(_let(joining, fold), lambda m: F.filter(F.sequence(F.lit(0), n), lambda i: m.bitwiseAND(_bit(i)) != 0))


def viterbi_states(word: Column, edges: Column, unknown: float = -1e6) -> Column:
    """For each place in the word, 0 to its length, the best path there: (score, pieces as a negative number, back, the last piece's start).

    A fold over the places: of all edges that end at one, the path with the highest score, then the fewest pieces, then the later
    start is kept. A character that is no piece counts ``unknown``.
    """

    def step(best: Column, i: Column) -> Column:
        def by(start: Column, score: Column) -> Column:
            return _let(F.get(best, start), lambda b: F.struct((b["score"] + score).alias("score"), (b["pieces"] - 1).alias("pieces"), start.alias("back")))

        here = F.transform(F.filter(edges, lambda e: e["end"] == i), lambda e: by(e["start"], e["score"]))
        lone = by(i - 1, F.lit(unknown))
        return F.concat(best, F.array(F.greatest(F.coalesce(F.array_max(here), lone), lone)))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("pieces"), F.lit(0).alias("back")))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step)


def viterbi_fold(word: Column, edges: Column, unknown: float = -1e6) -> Column:
    """Starts of the tokens and the word's end on the path of the highest score, for models of independent pieces."""
    n = F.length(word)

    def walk(best: Column):
        return lambda path, _: F.when(F.get(path, F.lit(0)) > 0, F.concat(F.array(F.get(best, F.get(path, F.lit(0)))["back"]), path)).otherwise(path)

    return _let(viterbi_states(word, edges, unknown), lambda best: F.aggregate(F.sequence(F.lit(1), n), F.array(n), walk(best)))


def token_ids(word: Column, edges: Column, cuts: Column, first_byte: int) -> Column:
    """Ids of the tokens between ``cuts``; a character that is no piece becomes its UTF-8 bytes' pieces."""

    def one(s: Column, e: Column) -> Column:
        piece = F.get(F.filter(edges, lambda x: (x["start"] == s) & (x["end"] == e)), F.lit(0))
        digits = F.hex(F.encode(word.substr(s + 1, e - s), "UTF-8"))
        raw = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(digits.substr(i, F.lit(2)), 16, 10).cast("int") + first_byte)
        return _let(piece, lambda p: F.when(p.isNotNull(), F.array(p["id"])).otherwise(raw))

    return _let(cuts, lambda c: F.flatten(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), one)))


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """``words`` (w, word and others) with ids, and the score and number of pieces of the best path through the lattice."""
    edges = lattice(words, model.table(words.sparkSession), model.longest).withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<rank:int,start:int,end:int,id:int,score:double>>")))
    fold = merge_fold if model.bpe else viterbi_fold
    word, e = F.col("word"), F.col("edges")
    last = F.element_at(viterbi_states(word, e, model.unknown), -1)
    out = edges.withColumns({"ids": token_ids(word, e, fold(word, e), model.first_byte), "last": last})
    return out.select(*words.columns, "ids", F.col("last.score").alias("best_score"), (-F.col("last.pieces")).alias("best_pieces"))


def long_word(word: str, model: PieceModel) -> tuple[list[int], int, float]:
    """Ids, and pieces and score of the best path, of one word of any length: the same lattice, merged by a heap and folded in a loop."""
    known, n = model.by_piece, len(word)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, n + 1):
        b = best[end - 1]
        found = [(b[0] + model.unknown, b[1] - 1, end - 1)]
        for start in range(max(0, end - model.longest), end):
            if (p := known.get(word[start:end])) is not None:
                found.append((best[start][0] + p[1], best[start][1] - 1, start))
        best.append(max(found))
    if model.bpe:
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(s: int) -> None:
            if s >= 0 and (m := after[s]) < n and (p := known.get(word[s : after[m]])) is not None:
                heapq.heappush(heap, (p[2], s, after[m]))

        for s in range(n):
            offer(s)
        while heap:
            _, s, end = heapq.heappop(heap)
            m = after[s] if alive[s] else n
            if m >= n or after[m] != end:
                continue  # one of the two has been joined with another since
            alive[m], after[s] = False, end
            if end < n:
                before[end] = s
            offer(s)
            offer(before[s])
        cuts = [s for s in range(n) if alive[s]] + [n]
    else:
        cuts = [n]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][2])
        cuts.reverse()
    ids: list[int] = []
    for s, end in zip(cuts, cuts[1:]):
        p = known.get(word[s:end])
        ids += [p[0]] if p is not None else [model.first_byte + b for b in word[s:end].encode()]
    return ids, -best[n][1], best[n][0]


def _part(word: str, parts: int) -> int:
    return zlib.crc32(word.encode()) % parts


def _ask(texts: list[str], model: PieceModel, parts: int) -> tuple[list[list[str]], list[list[str]]]:
    """Each text's words, and their distinct words that the lattice is asked for, by part in ascending order."""
    split = [words_in(t, model.prefix) for t in texts]
    asked: list[list[str]] = [[] for _ in range(parts)]
    for w in sorted(set().union(*split)):
        if w != "\n" and len(w) <= LONGEST:
            asked[_part(w, parts)].append(w)
    return split, asked


def _opened(body: bytes, sizes: list[int]) -> list[str]:
    raw = pa.Codec("zstd").decompress(body, sum(sizes), asbytes=True)
    ends = np.cumsum(sizes).tolist()
    return [raw[e - n : e].decode() for e, n in zip(ends, sizes)]


def encode(docs: DataFrame, model: PieceModel, *, chunk_bytes: int = 4_000_000, task_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, best_score, best_pieces) for each row of ``docs``: the library's ids of the whole text.

    best_score and best_pieces are of the path with the highest sum of piece scores through the same lattices, which for a
    model of independent pieces is that of the ids. Null and empty texts have no ids; rows that repeat an id, or have none, stay rows of their own.

    Texts stay together in chunks of about ``chunk_bytes``. A chunk sends its distinct words, dealt to parts by a hash, so a word is one row for
    each chunk however often it occurs; the parts' lattices are made and folded in Spark, each distinct word once; and each
    part sends a chunk one row with its words' ids, in order. Words over 60 characters go through the same lattice
    in the chunk's task, as the fold keeps a word's boundaries in one number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, texts, held = task_number() << 32, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal chunk, held
            row = [[chunk], [list(ids)], [[len(t) for t in texts]], [pa.Codec("zstd", compression_level=6).compress(b"".join(texts), asbytes=True)]]
            chunk, held = chunk + 1, 0
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["chunk", "ids", "sizes", "body"])

        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids.append(i)
                texts.append(bytes(t.as_buffer()))
                held += len(texts[-1])
                if held >= chunk_bytes:
                    yield close()
        if ids:
            yield close()
        give_back()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, body in zip(*(batch.column(c) for c in ("chunk", "sizes", "body"))):
                _, asked = _ask(_opened(body.as_py(), sizes.as_py()), model, parts)
                rows = [(p, chunk.as_py(), "\n".join(a)) for p, a in enumerate(asked) if a]
                part, chunks_, words = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(chunks_, pa.int64()), pa.array(words, pa.string())], names=["part", "chunk", "words"])
        give_back()

    chunks = written(given.mapInArrow(gather, "chunk long, ids array<long>, sizes array<long>, body binary"), "chunks")
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    # The number of tasks is given, as what is sent is small and grows a hundredfold in the lattices.
    tasks = max(4, total // task_bytes)
    parts = 4 * tasks
    asked = written(chunks.mapInArrow(ask, "part int, chunk long, words string"), "asked")
    distinct = asked.repartition(tasks, "part").select("part", F.explode(F.split("words", "\n")).alias("word")).distinct().withColumn("w", F.monotonically_increasing_id())
    coded = encode_words(distinct.select("w", "part", "word"), model)
    answer = F.concat_ws(" ", F.transform("ids", lambda i: i.cast("string")))
    coded = written(coded.select("part", F.concat_ws("|", answer, F.col("best_pieces").cast("string"), F.col("best_score").cast("string")).alias("answer"), "word"), "words")

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            parts_, chunks_, words, found = [], [], [], []
            for part, chunk, text, a in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "words", "answer"))):
                if part != now:
                    now, known = part, {}
                if a is not None:  # comes first
                    known[text] = a
                else:
                    parts_.append(part)
                    chunks_.append(chunk)
                    found.append("\n".join([known[w] for w in text.split("\n")]))
            yield pa.RecordBatch.from_arrays([pa.array(parts_, pa.int32()), pa.array(chunks_, pa.int64()), pa.array(found, pa.string())], names=["part", "chunk", "answers"])
        give_back()

    told = coded.select("part", F.lit(None).cast("long").alias("chunk"), F.col("word").alias("words"), "answer")
    both = told.unionByName(asked.withColumn("answer", F.lit(None).cast("string"))).repartition(tasks, "part").sortWithinPartitions("part", F.asc_nulls_first("chunk"))
    answers = both.mapInArrow(reply, "part int, chunk long, answers string")
    first = chunks.select("chunk", F.lit(-1).alias("part"), "ids", "sizes", "body", F.lit(None).cast("string").alias("answers"))
    back = answers.select("chunk", "part", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("sizes"), F.lit(None).cast("binary").alias("body"), "answers")
    newline = [model.first_byte + 10], 1, model.unknown

    def settle(ids: list, texts: list[str], got: dict[int, str]) -> Iterator[pa.RecordBatch]:
        split, asked = _ask(texts, model, parts)
        answer: dict[str, tuple[bytes, int, float]] = {"\n": (np.array(newline[0], "<i4").tobytes(), *newline[1:])}
        for p, words in enumerate(asked):
            if words:
                for w, a in zip(words, got[p].split("\n")):
                    numbers, pieces, score = a.split("|")
                    answer[w] = np.array(numbers.split(" "), "<i4").tobytes(), int(pieces), float(score)
        for w in set().union(*split).difference(answer):
            numbers, pieces, score = long_word(w, model)
            answer[w] = np.array(numbers, "<i4").tobytes(), pieces, score
        for at in range(0, len(ids), 500):
            found = [[answer[w] for w in words] for words in split[at : at + 500]]
            flat = [np.frombuffer(b"".join([f[0] for f in x]), "<i4") for x in found]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*flat, np.zeros(0, np.int32)])))
            scores = [math.fsum(f[2] for f in x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 500], pa.int64()), lists, pa.array(scores, pa.float64()), pa.array([sum(f[1] for f in x) for x in found], pa.int64())], names=["id", "ids", "best_score", "best_pieces"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = texts = None
        got: dict[int, str] = {}
        for batch in batches:
            for part, i, sizes, body, a in zip(*(batch.column(c) for c in ("part", "ids", "sizes", "body", "answers"))):
                if part.as_py() < 0:
                    if ids is not None:
                        yield from settle(ids, texts, got)
                    ids, texts, got = i.as_py(), _opened(body.as_py(), sizes.as_py()), {}
                else:
                    got[part.as_py()] = a.as_py()
        if ids is not None:
            yield from settle(ids, texts, got)
        give_back()

    both = first.unionByName(back).repartition("chunk").sortWithinPartitions("chunk", "part")
    out = both.select("part", "ids", "sizes", "body", "answers").mapInArrow(assemble, "id long, ids array<int>, best_score double, best_pieces long")
    return out.withColumnRenamed("id", id_col)


def decoded_text(ids: Column, model: PieceModel) -> Column:
    """The text of ids, in the row that holds them: the pieces' bytes by id in the piece table, in order. Null ids give empty text.

    The sign for a space in pieces reads as a space also where the text held that sign itself, as in the library.
    """
    by_id = {i: p.replace(SPACE, " ").encode().hex() for i, p, _ in model.pieces} | {model.first_byte + b: f"{b:02x}" for b in range(256)}
    # One constant as large as the vocabulary, whatever the input; control pieces stand for nothing.
    table = F.split(F.lit(",".join(by_id.get(i, "") for i in range(max(by_id) + 1))), ",")
    hexes = F.transform(ids, lambda i: F.coalesce(F.when(i >= 0, F.get(table, i)), F.lit("")))
    text = F.decode(F.unhex(F.array_join(hexes, "")), "UTF-8")
    return F.coalesce(F.substring(text, 2, 2**31 - 1) if model.prefix else text, F.lit(""))


def decode(coded: DataFrame, model: PieceModel, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) from ids, for each row of ``coded`` by itself, so rows that repeat an id or have none keep their own texts."""
    return coded.select(F.col(id_col), decoded_text(F.col(ids_col), model).alias("text"))
