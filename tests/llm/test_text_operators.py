"""Text operators against brute force, and on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermatch.llm import language_id, line_dedup, minhash, packing, piece_codec, shingles, suffix_dedup, suffix_tree_lm, token_files, tokens
from ledgermatch.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


AWKWARD = [None, "", " ", "\n\n\n", "a", "x" * 5000, "ab " * 3000, "é" * 300, "same text", "same text", "\x00\x1c", "日本語 テキスト 😀", "a  b\n\n c\td "]


# Language identification.

@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    kinds = {"aa": "the quick brown fox and there".split(), "bb": "zwölf größer über schön weiß".split(), "cc": "été où naïve garçon élève".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(3, 60))), k) for i, k in enumerate(itertools.islice(itertools.cycle(kinds), 300))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_accuracy_and_und(spark, labelled):
    network = language_id.train(labelled, usable=F.col("doc_id") % 5 != 0)
    out = language_id.identify(labelled, network).where("doc_id % 5 = 0")
    assert out.where("lang = lang_pred").count() >= 0.9 * out.count()
    odd = language_id.identify(spark.createDataFrame([(1, None, "x", 9), (2, "", "x", 9), (3, "12 !?", "x", 9), (4, "x" * 100_000, "x", 9)], "doc_id long, text string, lang_pred string, extra int"), network)
    got = {r["doc_id"]: r for r in odd.collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in network.languages and 0 <= got[4]["score"] <= 1 and got[4]["extra"] == 9
    assert language_id.identify(labelled.limit(0), network).count() == 0
    assert language_id.train(labelled.where("lang is null"), usable=F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.identify(labelled.limit(5), None).collect()} == {"und"}


def test_gradients():
    rng = np.random.default_rng(0)
    net = language_id.ByteNetwork.fresh(["a", "b", "c"], 3)
    net.tables, net.inner = ([[b.astype(np.float64) for b in a] for a in x] for x in (net.tables, net.inner))
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    x, y = rng.integers(0, 257, (7, 5)), rng.integers(0, 3, 5)
    _, grads = net.gradients(x, y)
    for w, g in zip(net.weights(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 1e-5
        w[at] = old + step
        up = net.gradients(x, y)[0]
        w[at] = old - step
        down = net.gradients(x, y)[0]
        w[at] = old
        assert math.isclose(g[at], (up - down) / (2 * step), rel_tol=1e-3, abs_tol=1e-7)


# Tokens: files and packing.

def library_ids(name, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return t.encode(text or "", add_special_tokens=False).ids + [end]


ODD = [*"aB9zZ \n\t.,'_-\"<|>&", " ", " ", "İ", "ı", "é", "é", "\u0301", "ß", "日本", "😀", "\x1c", "\x85", "\u00a0", "\u3000", "\x00", "²", "①", "Σ", "ς", "İ.", "'s", "'re", "don't", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "größer,", "\u0338", "한", "\u200d", "\u0345", "Ⅷ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_wordwise_ids_are_the_librarys(name):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(10_000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]
    for keep_bytes in (10_000_000, 50_000):  # the second begins new dictionaries all the time
        assert tokens.WordwiseTokenizer(tokenizer_path(name), keep_bytes).encode(texts) == want


def test_variable_length_numbers():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        x = rng.integers(0, 2 ** rng.integers(1, 33, n), n, dtype=np.uint64).astype(np.uint32) if n else np.zeros(0, np.uint32)
        control, data = token_files.encode_numbers(x)
        assert len(control) == -(-n // 4)
        assert (token_files.decode_numbers(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == x).all()


def test_token_files(spark):
    texts = [*AWKWARD, "don't  stop -- (12) a.b.c foo's, <|endoftext|>"]
    docs = frame(spark, texts).withColumn("start", F.lit("clash"))
    rows = token_files.token_table(docs, tokenizer_path("word_bpe_49k.json"), file_tokens=500).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(rows, texts):
        ids = library_ids("word_bpe_49k.json", t, 2)
        assert (r["start"], r["n_tokens"]) == (at, len(ids)) and np.frombuffer(r["ids"], "<u4").tolist() == ids
        at += len(ids)
    assert len(rows) == len(texts)
    repeated = token_files.token_table(frame(spark, ["b", "a", None], [7, 7, None]), tokenizer_path("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] is None, r["start"]) for r in repeated)[-1] == (True, 0)


def padding(by_seq):
    """Share of padding; a sequence whose length is a power of two has none."""
    sizes = [sum(r["length"] for r in pieces) for pieces in by_seq.values()]
    padded = [n if n & (n - 1) == 0 else 2048 for n in sizes]
    return 1 - sum(sizes) / sum(padded)


def test_padding_does_not_depend_on_partitions(spark):
    rng = random.Random(6)
    docs = frame(spark, [prose(rng, rng.randint(1, 1500)) for _ in range(300)]).repartition(64)
    by_seq = {}
    for r in packing.pack(docs, tokenizer_path("byte_bpe_50k.json")).collect():
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert padding(by_seq) < 0.02


def test_packing(spark):
    rng = random.Random(5)
    texts = [*AWKWARD, *[prose(rng, rng.randint(1, 4000)) for _ in range(40)]]
    out = packing.pack(frame(spark, texts), tokenizer_path("byte_bpe_50k.json"), windows=8).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = library_ids("byte_bpe_50k.json", t, 1)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and np.frombuffer(r["ids"], "<u4").tolist() == ids[at : at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert padding(by_seq) < 0.02
    assert packing.pack(frame(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing_by_a_column(spark):
    """No sequence holds two values, each id is in one piece, and a sequence is gapless, also when values are packed early because many are open."""
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 900)), rng.choice(["a", "b", "c", None]), "s", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    for most_open in (32, 1):
        got = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), by="lang", most_open=most_open).collect()
        of = {i: lang for i, _, lang, _, _ in rows}
        sequences, ids = {}, {}
        for r in got:
            assert r["lang"] == of[r["doc_id"]]
            sequences.setdefault(r["sequence_id"], []).append(r)
            ids.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
        for s in sequences.values():
            s.sort(key=lambda r: r["offset"])
            assert len({r["lang"] for r in s}) == 1 and sum(r["length"] for r in s) <= 2048
            assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:k]) for k in range(len(s))]
        assert set(ids) == set(of)
        for pieces in ids.values():
            pieces.sort()
            assert [p[0] for p in pieces] == [sum(x[1] for x in pieces[:k]) for k in range(len(pieces))] and sum(p[1] for p in pieces) == pieces[0][2]


def test_added_tokens_as_the_library(spark, tmp_path):
    import zlib as z

    from tokenizers import Tokenizer

    from ledgermatch.llm import queries

    texts = [*AWKWARD, "a <|endoftext|> b", "x<|endoftext|>,  y\n<|startoftext|>z <|endoftext|", "<|endoftext|>", "plain words, after it"]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    want = {n: [Tokenizer.from_file(tokenizer_path(n)).encode(t or "", add_special_tokens=False).ids for t in texts] for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
    for r in queries.op2_token_files(spark, str(tmp_path)).collect():
        ids = want["word_bpe_49k.json"][r["doc_id"]] + [2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), z.crc32(np.array(ids, "<u4").tobytes()))
    for r in queries.op7_packing(spark, str(tmp_path)).collect():
        ids = (want["byte_bpe_50k.json"][r["doc_id"]] + [1])[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == z.crc32(np.array(ids, "<u4").tobytes())


def test_differencing():
    rng = random.Random(2)
    assert packing.differencing([8, 7, 6, 5, 4], 2) and sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    for _ in range(30):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 40))]
        ways = rng.randint(1, 8)
        parts = packing.differencing(sizes, ways)
        assert len(parts) == ways and sorted(i for p in parts for i in p) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in p) <= 100 for p in packing.near_equal_windows(sizes, 100))


# Lines.

def brute_lines(docs):
    seen, covered = {}, {}
    for i, t in sorted(docs.items()):
        lines = t.split("\n") if t is not None else []
        for p in range(len(lines) - 2):
            if tuple(lines[p : p + 3]) in seen:
                covered.setdefault(i, set()).update((p, p + 1, p + 2))
            seen.setdefault(tuple(lines[p : p + 3]), (i, p))
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in covered.get(i, ())) for i, t in docs.items()}


def test_line_dedup(spark):
    rng = random.Random(4)
    texts = [*AWKWARD, *["\n".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(60)]]
    out = line_dedup.dedup_lines(frame(spark, texts).withColumn("n_removed", F.lit("clash")))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute_lines(dict(enumerate(texts)))
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    same = line_dedup.dedup_lines(frame(spark, ["a\nb\nc"] * 2 + ["a\nb\nc"], [5, 5, None]))
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in same.collect()) == [(False, 3), (False, 3), (True, 0)]


def test_line_dedup_equals_its_sql_on_odd_rows(spark):
    """Repeated rows, null ids, and columns named like those that the operator makes."""
    import duckdb
    import pandas as pd

    texts = ["a\nb\nc\nd", "a\nb\nc\nd", "x\na\nb\nc", None, "", "a\nb\nc", "p\nq\nr", "p\nq\nr", "a\nb"]
    ids = [7, 7, 8, 9, 10, None, None, None, None]
    names = ["lines", "covered", "covered_id", "covered_text", "hash", "kept", "row", "__covered", "a.b"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in zip(ids, texts)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and all(tuple(r)[2:-2] == tuple(names) for r in out.collect())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text": texts}))
    want = sorted(con.execute(line_dedup.ORACLE_SQL).fetchall(), key=repr)
    assert sorted(map(tuple, out.select("doc_id", "n_lines", "n_removed", "text").collect()), key=repr) == want


def test_columns_named_like_the_operators_own(spark, labelled):
    network = language_id.train(labelled, usable=F.lit(True), rows_per_language=20)
    odd = labelled.limit(5).selectExpr("*", "1 as letters", "2 as letters_", "3 as __letters")
    rows = language_id.identify(odd, network, chunk_bytes=40).collect()
    assert len(rows) == 5 and all((r["letters"], r["letters_"], r["__letters"]) == (1, 2, 3) and r["lang_pred"] in network.languages for r in rows)


def test_slices_by_bytes():
    import pyarrow as pa

    from ledgermatch.llm.common import byte_slices

    batch = pa.RecordBatch.from_pydict({"t": ["aaaa", None, "", "bb", "c" * 50, "d", None]})
    parts = [p.column("t").to_pylist() for p in byte_slices(batch, "t", 6)]
    assert parts == [["aaaa", None, "", "bb"], ["c" * 50], ["d", None]]
    assert list(byte_slices(batch.slice(0, 0), "t", 6)) == []


# Near duplicates.

def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(6)
    keys = shingles.mix(np.arange(1, 400, dtype=np.uint64))
    wa = rng.integers(1, 5, len(keys)).astype(float)
    wb = np.where(rng.random(len(keys)) < 0.2, 9.0, wa)
    exact = minhash.probability_jaccard((np.sort(keys), wa), (np.sort(keys), wb))
    brute = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in range(len(keys)))
    order = np.argsort(keys)
    got = (minhash.prob_minhash(keys[order], wa, 4096) == minhash.prob_minhash(keys[order], wb, 4096)).mean()
    assert math.isclose(exact, brute, rel_tol=1e-9) and abs(got - exact) < 0.04


@pytest.mark.parametrize("part_rows", [2000, 7])
def test_near_duplicates(spark, part_rows, monkeypatch):
    rng = random.Random(7)
    texts = [*AWKWARD]
    for _ in range(8):
        words = [f"{rng.choice(WORDS)}{rng.randint(0, 500)}" for _ in range(150)]
        texts.append(" ".join(words))
        for _ in range(rng.randint(1, 12)):
            w = list(words)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 10**6))
            texts.append(" ".join(w))
    likely = minhash.linking_pairs
    monkeypatch.setattr(minhash, "linking_pairs", lambda m, **k: likely(m, **{**k, "part_rows": part_rows}))
    out = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    words, at = shingles.word_hashes(texts)
    sets = [minhash.weighted_shingles(words[s:e], 5) for s, e in zip(at[:-1], at[1:])]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i][0]) and minhash.probability_jaccard(sets[i], sets[j]) >= 0.8:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    assert [out[i]["class_id"] for i in range(len(texts))] == label
    assert all(r["kept"] == (r["class_id"] == r["doc_id"]) for r in out.values())
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert minhash.near_duplicates(frame(spark, ["a b"], [None])).first()["kept"]


def test_texts_of_one_id_are_verified_by_their_own_words(spark):
    rng = random.Random(23)
    one, two, three = ([f"{rng.choice(WORDS)}{rng.randint(0, 500)}" for _ in range(150)] for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "edited"])
    rows = [" ".join(one), " ".join(two), near(two), near(one), " ".join(three)]
    out = minhash.near_duplicates(frame(spark, rows, [7, 7, 8, 9, 10])).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in out) == [(7, 7), (7, 7), (8, 7), (9, 7), (10, 10)]


def test_texts_of_one_id_have_wide_hashes(spark):
    # 32 bits take two of 200,000 numbers for the same with near certainty.
    numbers = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert numbers.select(*suffix_dedup._key("doc_id", "text")).select("th").distinct().count() == 200_000


def test_a_heavy_shingle_does_not_hide_a_link(spark):
    # One run of words makes up most of three texts; the least id is near neither of the two that link.
    heavy = "w " * 70_000
    own = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    texts = [heavy + own("a", 21_000), heavy + own("b", 7000), heavy + own("c", 7000)]
    words, at = shingles.word_hashes(texts)
    sets = [minhash.weighted_shingles(words[s:e], 5) for s, e in zip(at[:-1], at[1:])]
    assert [minhash.probability_jaccard(sets[i], sets[j]) >= 0.8 for i, j in ((0, 1), (0, 2), (1, 2))] == [False, False, True]
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, texts)).collect()} == {0: 0, 1: 1, 2: 1}


def test_compact_sets_keep_true_counts(spark):
    heavy, other = "w " * 200_000, " ".join(f"x{i}" for i in range(1000))
    row = minhash.compact_sets(spark.createDataFrame([(1, heavy + other)], "id long, text string"), size=5).first()
    words, _ = shingles.word_hashes([heavy + other])
    counts = np.frombuffer(row["counts"], np.uint32)
    assert counts.max() == 199_996 and counts.sum() == len(words) - 4


# Repeated byte strings.

def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((bytes(b for b, g in zip(r, gone) if not g), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))))
    return out


@pytest.mark.parametrize("most, part", [(4096, 400_000), (1, 400_000), (4096, 150), (4096, 1)])
def test_remove_repeats(spark, most, part):
    rng = random.Random(8)
    passages = [prose(rng, rng.randint(30, 60)) for _ in range(4)]
    texts = [*AWKWARD, *[prose(rng, rng.randint(0, 40)) + rng.choice(passages) + prose(rng, rng.randint(0, 40)) for _ in range(30)], passages[0], passages[1][:-3]]
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, texts), most=most, part=part).collect()}
    for i, (kept, removed, spans) in enumerate(brute_repeats(texts, 200)):
        r = out[i]
        assert (bytes(r["kept"]), r["n_removed"], r["n_spans"], r["n_bytes"]) == (kept, removed, spans, len((texts[i] or "").encode()))
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    twice = suffix_dedup.remove_repeats(frame(spark, ["y" * 50 + prose(rng, 60)] * 2, [3, 3])).collect()
    assert all(r["n_removed"] == r["n_bytes"] for r in twice)


def test_runs_of_one_polynomial_sum_are_not_copies(spark):
    """Thue-Morse strings and their complements around one anchor: equal sums of powers modulo 2**64, but no common string of 200 bytes."""
    rng = random.Random(25)
    gap = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(64))
    one = "".join("8U"[i.bit_count() % 2] for i in range(128))
    other = one.translate(str.maketrans("8U", "U8"))
    texts = [one + gap + other, other + gap + one]
    rows = suffix_dedup.remove_repeats(frame(spark, texts)).collect()
    assert [(bytes(r["kept"]).decode(), r["n_removed"], r["n_spans"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(t, 0, 0) for t in texts]


def test_parts_of_long_texts_hold_each_window_once():
    for length, part in ((1, 1), (5, 3), (5, 100), (200, 150)):
        sizes = [0, length - 1, length, length + 1, part, part + length - 1, part + length, 3 * part + 2 * length]
        found = list(suffix_dedup.parts_of(sizes, length, part))
        for i, size in enumerate(sizes):
            mine = [(lo, hi) for j, lo, hi in found if j == i]
            assert [w for lo, hi in mine for w in range(lo, hi - length + 1)] == list(range(size - length + 1))
            assert all(hi <= size and hi - lo < part + length for lo, hi in mine)


def test_interval_expansion():
    from ledgermatch.llm.suffix_intervals import repeated_starts

    rng = np.random.default_rng(1)
    for length in (3, 8, 20, 50):
        for _ in range(20):
            base = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 120)).astype(np.uint8)) for _ in range(5)]
            parts = [b[: rng.integers(0, len(b) + 1)] + base[rng.integers(5)] for b in (base[rng.integers(5)] for _ in range(rng.integers(1, 12)))]
            mask, first = repeated_starts(parts, length)
            count = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
            for p, s in zip(parts, first):
                assert mask[s : s + len(p)].tolist() == [i + length <= len(p) and count[p[i : i + length]] > 1 for i in range(len(p))]


# Pieces.

def best_path(text, model):
    """Score and number of pieces of the best path through the whole text's lattice, place by place."""
    body = "▁" + text.replace(" ", "▁") if text else ""
    best = [(0.0, 0)]
    for end in range(1, len(body) + 1):
        found = [(best[end - 1][0] + model.unknown, best[end - 1][1] - 1)]
        for start in range(max(0, end - model.longest), end):
            if body[start:end] in model.by_piece:
                found.append((best[start][0] + model.by_piece[body[start:end]][1], best[start][1] - 1))
        best.append(max(found))
    return best[-1][0], -best[-1][1]


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 3000, "task_bytes": 3000}])
def test_piece_codec(spark, options):
    import sentencepiece

    model = piece_codec.PieceModel(tokenizer_path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=model.path)
    rng = random.Random(11)
    odd = ["".join(rng.choice([*"abcdeth  \n", "é", "日", "▁", "ing", "tion", "\x00", "|", "the"]) for _ in range(rng.randint(0, 150))) for _ in range(60)]
    texts = [*AWKWARD, "The theatre's  déjà vu, again!", "w" * 70 + " " + "v" * 61, "this" * 40, "日本語の文" * 30, *odd, *[prose(rng, 40) for _ in range(20)]]
    coded = piece_codec.encode(frame(spark, texts).withColumn("ids", F.lit("clash")), model, **options)
    rows = coded.collect()
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {i: library.encode(t) if t else [] for i, t in enumerate(texts)}
    for r in rows:
        score, n = best_path(texts[r["doc_id"]] or "", model)
        assert r["best_pieces"] == n and math.isclose(r["best_score"], score, rel_tol=1e-9, abs_tol=1e-6)
    back = {r["doc_id"]: r["text"] for r in piece_codec.decode(coded, model).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}  # the library takes both for the same, too
    assert piece_codec.encode(frame(spark, []), model).count() == 0


def test_pieces_are_decoded_row_by_row(spark, tmp_path):
    from ledgermatch.llm import queries

    texts = [*AWKWARD, "The theatre's  déjà vu, again!", "another text", "a third one"]
    ids = [*range(len(AWKWARD)), None, None, 0]
    model = piece_codec.PieceModel(tokenizer_path("piece_bpe_32k.model"))
    docs = frame(spark, texts, ids)
    back = piece_codec.decode(piece_codec.encode(docs, model), model).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, t or "") for i, t in zip(ids, texts))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op5_piece_codec(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in out) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in zip(ids, texts))


def test_viterbi_fold(spark):
    pieces = {"a": -1.0, "b": -1.2, "ab": -1.5, "ba": -2.5, "aba": -2.2, "bb": -1.9}
    table = spark.createDataFrame([(p, i, s, i) for i, (p, s) in enumerate(pieces.items())], "piece string, id int, score double, rank int")
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abc", repeat=n)]
    df = spark.createDataFrame(list(enumerate(words)), "w long, word string")
    full = piece_codec.lattice(df, table, 3)
    for r in full.select("word", piece_codec.viterbi_fold(F.col("word"), F.col("edges")).alias("cuts")).collect():
        score = lambda cuts, w=r["word"]: sum(pieces.get(w[s:e], -1e6 if e - s == 1 else -math.inf) for s, e in zip(cuts, cuts[1:]))
        n = len(r["word"])
        best = max(score([0, *c, n]) for k in range(n) for c in itertools.combinations(range(1, n), k))
        assert math.isclose(score(r["cuts"]), best)


# Language model.

def test_base_score_and_tokens(spark):
    rng = random.Random(9)
    texts = [*AWKWARD, *[prose(rng, rng.randint(1, 60)).title() for _ in range(60)]]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    out = suffix_tree_lm.score_texts(frame(spark, texts), training=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1, share=0.001).collect()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*"".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (t or "").translate(fold)).split(" ")] for i, t in enumerate(texts)}
    tokens = {i: [w for w in ws if w] + [None] for i, ws in tokens.items()}
    c = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for r in out:
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n) and math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] <= 0 and math.isfinite(r["score"])
    prose_rows = [r for r in out if r["doc_id"] >= len(AWKWARD) and held(r["doc_id"])]
    assert sum(r["score"] for r in prose_rows) > 3 * sum(r["base_score"] for r in prose_rows)
    assert suffix_tree_lm.score_texts(frame(spark, []), training=F.lit(True)).count() == 0
    none = suffix_tree_lm.score_texts(frame(spark, ["a b"]), training=F.lit(False)).first()
    assert none["train_tokens"] == 0 and none["n_tokens"] == 3


def test_tree_probabilities_sum_to_one():
    buffer, places = suffix_tree_lm.normal_form(["abab ab", "ba b"])
    keys, n = np.unique(suffix_tree_lm.gram_keys(buffer, places, 2), return_counts=True)
    rows = []
    for length in (2, 1, 0):
        keys, n = suffix_tree_lm._summed(keys & np.uint64((1 << 8 * (length + 1)) - 1), n)
        for context in np.unique(keys >> np.uint64(8)):
            at = keys >> np.uint64(8) == context
            rows.append((length, int(context), (keys[at] & np.uint64(255)).astype(int), n[at]))
    tree = suffix_tree_lm.build_tree(rows, 2, divergence=0.0, strength=1.0)
    unseen = 256 - (tree.classes > 0).sum()
    p = 10.0 ** tree.log.astype(float)
    assert np.allclose(p[:, 1:].sum(axis=1) + unseen * p[:, 0], 1, atol=1e-5)


def test_tree_grows_with_the_input(spark):
    rng = random.Random(19)
    texts = [prose(rng, 40) for _ in range(60)]
    training = F.col("doc_id") % 5 != 1
    # A context's share of the corpus falls as the corpus grows; its count decides.
    rare, common = (suffix_tree_lm.score_texts(frame(spark, texts), training=training, share=s).agg(F.sum("score")).first()[0] for s in (0.5, 8 / 9000))
    assert math.isclose(rare, common, rel_tol=1e-9)
    # Chunks and blocks don't change results.
    small = suffix_tree_lm.score_texts(frame(spark, texts), training=training, share=0.5, blocks=3, chunk_bytes=500).agg(F.sum("score")).first()[0]
    assert math.isclose(small, common, rel_tol=1e-6)


def test_scores_keep_every_row(spark):
    texts, ids = ["alpha beta", "alpha beta", "gamma", "gamma delta eta", None], [3, 3, 3, None, None]
    out = suffix_tree_lm.score_texts(frame(spark, texts, ids), training=F.lit(True), blocks=2, chunk_bytes=12).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == Counter([(3, 3), (3, 3), (3, 2), (None, 4), (None, 1)])


def test_gram_logs_equal_tree():
    texts = [prose(random.Random(20), 50), "abab ab", "", "zz top"]
    buffer, places = suffix_tree_lm.normal_form(texts)
    keys, n = np.unique(suffix_tree_lm.gram_keys(buffer, places, 4), return_counts=True)
    rows, left, m = [], keys, n
    for length in range(4, -1, -1):
        left, m = suffix_tree_lm._summed(left & np.uint64((1 << 8 * (length + 1)) - 1), m)
        for context in np.unique(left >> np.uint64(8)):
            at = left >> np.uint64(8) == context
            rows.append((length, int(context), (left[at] & np.uint64(255)).astype(int), m[at]))
    tree = suffix_tree_lm.build_tree(rows, 4, divergence=0.0, strength=2.0)
    levels = suffix_tree_lm.grow([], keys, n, 4, least=1, divergence=0.0, strength=2.0)
    for other in (texts, ["alphabet", "été", "a b  zz"]):
        buffer, places = suffix_tree_lm.normal_form(other)
        logs = suffix_tree_lm.gram_logs(levels, suffix_tree_lm.gram_keys(buffer, places, 4), 2.0)
        assert np.allclose(np.add.reduceat(logs, np.concatenate([[0], places[:-1] + 1])), tree.scores(other), rtol=1e-4)


def brute_scores(texts, train, depth, least, divergence, strength):
    """The model by its definition: counts of all contexts, smoothing from the root, retention, and the longest state for every byte."""
    end = bytes([suffix_tree_lm.END])
    forms = [b" ".join(w for w in (t or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()) + end for t in texts]
    counts = {}
    for form, mark in zip(forms, train):
        if mark:
            padded = end * depth + form
            for i in range(depth, len(padded)):
                for n in range(depth + 1):
                    counts.setdefault(padded[i - n : i], Counter())[padded[i]] += 1
    p, kept = {}, set()
    for context in sorted(counts, key=len):
        q = p[context[1:]] if context else np.full(256, 1 / 256)
        c = np.array([counts[context][b] for b in range(256)], float)
        p[context] = (c + strength * q) / (c.sum() + strength)
        gain = c.sum() * (p[context] * np.log(p[context] / q)).sum()
        if not context or c.sum() >= least and (len(context) < 3 or gain >= divergence):
            kept |= {context[i:] for i in range(len(context) + 1)}
    out = []
    for form in forms:
        padded, total = end * depth + form, 0.0
        for i in range(depth, len(padded)):
            state = next((padded[i - n : i] for n in range(depth, -1, -1) if padded[i - n : i] in kept), None)
            total += math.log10(p[state][padded[i]] if state in p else 1 / 256)
        out.append(total)
    return out


@pytest.mark.parametrize("options", [{}, {"blocks": 5, "chunk_bytes": 300}])
def test_score_is_that_of_the_longest_states(spark, options):
    rng = random.Random(12)
    texts = [None, "", " ", "a", "Été  d'été", "a  b\n\n c\td ", *[prose(rng, rng.randint(1, 30)) for _ in range(40)], "unseen Words ÿ here"]
    train = [i % 5 != 1 for i in range(len(texts))]
    got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score_texts(frame(spark, texts), training=F.col("doc_id") % 5 != 1, share=1.0, least=4, divergence=2.0, **options).collect()}
    want = brute_scores(texts, train, 6, 4, 2.0, 10.0)
    assert all(math.isclose(got[i], w, rel_tol=1e-5, abs_tol=1e-4) for i, w in enumerate(want))


@pytest.mark.parametrize("partitions, rows", [(1, 1), (4, 3), (200, 3), (200, 0)])
def test_scores_of_few_rows(spark, partitions, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = frame(spark, ["a b", "word", None][:rows]).repartition(max(1, rows))
        out = suffix_tree_lm.score_texts(docs, training=F.lit(True)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == [(0, 3), (1, 2), (2, 1)][:rows]


def test_classify_equals_a_plain_loop():
    rng = np.random.default_rng(5)
    net = language_id.ByteNetwork.fresh(["a", "b", "c"], 4)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 7, 8, 9, 30, 64, 3)]
    soft = lambda v: v / (1 + np.abs(v))
    for text, got in zip(texts, net.classify(texts, 8, block=3)):
        total = np.zeros(3)
        for at in range(0, len(text), 8):
            window, states = text[at : at + 8], []
            for d, order in ((0, range(len(window))), (1, range(len(window) - 1, -1, -1))):
                h, found = np.zeros(4), {}
                for t in order:
                    r, z = ((1 + soft(net.tables[d][k][window[t]] + h @ net.inner[d][k])) / 2 for k in (0, 1))
                    c = soft(net.tables[d][2][window[t]] + (r * h) @ net.inner[d][2])
                    h = found[t] = z * h + (1 - z) * c
                states.append(found)
            for t in range(len(window)):
                e = np.exp(np.concatenate([states[0][t], states[1][t]]) @ net.out + net.bias)
                total += e / e.sum()
        assert np.allclose(got, total / len(text), atol=1e-5)


def test_training_windows(spark):
    texts = ["", "abc", "é" * 50, "".join(chr(97 + i % 26) for i in range(1000))]
    rows = frame(spark, texts).where("text != ''").select("doc_id", language_id.training_windows(F.col("text"), 64, 8).alias("w")).collect()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        n = min(8, -(-len(raw) // 64))
        assert [bytes(w) for w in r["w"]] == [raw[(at := max(0, len(raw) - 64) * k // max(1, n - 1)) : at + 64] for k in range(n)]


def test_hash_is_stable():
    words, at = shingles.word_hashes(["a b", "b a", None, "A"], lower=True)
    assert at.tolist() == [0, 2, 4, 4, 5] and words[0] == words[3] == words[4] and words[1] == words[2]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
