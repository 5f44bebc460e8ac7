"""Periodic runs against brute force, and on awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgermatch.llm import periodic_runs, queries


def brute_runs(words, periods=4, least=6):
    """By definition: every period's maximal stretches, of which those with no smaller period stay."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, periods * q))


def brute_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts(rng, count):
    texts = []
    for _ in range(count):
        alphabet = [bytes([97 + i]) for i in range(rng.choice([1, 2, 3, 8]))]
        words = [rng.choice(alphabet) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 6))]
            at = rng.randint(0, len(words))
            words[at:at] = unit * rng.randint(2, 9)
        texts.append(b" ".join(words))
    return texts


@pytest.mark.parametrize("periods,least", [(4, 6), (2, 2), (3, 9)])
def test_runs_equal_the_definition(periods, least):
    texts = random_texts(random.Random(periods), 400)
    n, runs, out = periodic_runs.collapse(texts, periods=periods, min_length=least)
    for text, size, found, kept in zip(texts, n, runs, out):
        words = text.split()
        want = brute_runs(words, periods, least)
        assert (size, found, kept) == (len(words), want, brute_collapsed(words, want))


def test_blocks_and_one_word_texts():
    same = b"a " * 3000
    n, runs, out = periodic_runs.collapse([same, b"", None, b" \t\n", b"b", same])
    assert n == [3000, 0, 0, 0, 1, 3000] and runs == [[(0, 3000, 1)], [], [], [], [], [(0, 3000, 1)]] and out == [b"a", b"", None, b"", b"b", b"a"]
    words, numbers, starts = periodic_runs._numbered([b"a b " * 300, b"c " * 50])
    sizes = np.diff(starts)
    sa = periodic_runs.SuffixArray(numbers, np.repeat(starts[1:], sizes), np.repeat(sizes, sizes))
    whole, parts = (sorted(set(zip(*map(np.ndarray.tolist, periodic_runs._branching_squares(sa, 4, block=b))))) for b in (10**6, 7))
    assert whole == parts
    order = sorted(range(len(words)), key=lambda i: [int(x) for x in numbers[i : starts[1] if i < starts[1] else starts[2]]])
    assert sa.order.tolist() == order


def contract(doc_id, text):
    words = [w for w in (text or "").encode().translate(bytes(32 if 9 <= i <= 13 else i for i in range(256))).split(b" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    text = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
    return (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(brute_collapsed(words, runs)).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [t.decode() for t in random_texts(rng, 250)] + [None, "", " \n", "x", "x\x0bx\x0cx x\rx\tx x", "é　é " * 9, "w " * 20_000, "a\x00 " * 8]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(7, "again " * 10, "en", "s", 0), (7, "again " * 10, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    want = sorted(((i, *contract(i, t)) for i, t, *_ in rows if t is None or len(t) < 30_000), key=repr)
    assert sorted((tuple(r) for r in got if r["doc_id"] != 256), key=repr) == want
    assert [(r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in got if r["doc_id"] == 256] == [(1, 0, 20_000, 1, 20_000_000)]


def test_columns_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b " * 6, "n", 1), (None, "a b " * 6, "n", 1), (1, None, None, None)], "doc_id long, text string, runs string, `ledgermatch x` int")
    out = periodic_runs.find_runs(docs)
    assert out.columns == ["doc_id", "text", "ledgermatch x", "n_words", "runs", "collapsed"]
    got = sorted(map(tuple, out.select("doc_id", "n_words", "runs", "collapsed").collect()), key=repr)
    assert got == [(1, 0, [], None), (None, 12, [(0, 12, 2)], "a b"), (None, 12, [(0, 12, 2)], "a b")]
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
