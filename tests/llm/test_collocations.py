"""Quotient filters and collocations against plain counting, and on awkward rows."""

import glob
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgermatch.llm import collocations, queries
from ledgermatch.llm.quotient_filter import Counts, Packing, decode, encode, merged


@pytest.mark.parametrize("size,bits", [(2, 1), (2, 5), (3, 4), (4, 15), (4, 17), (3, 32), (4, 32), (2, 32)])
def test_filters_lose_nothing(size, bits):
    rng = np.random.default_rng(size * bits)
    packing = Packing(size, bits)
    total = Counter()
    parts = {}
    for _ in range(3):
        pool = rng.integers(0, 2**bits, (300, size))
        rows = pool[rng.integers(0, 300, 4000) * rng.integers(0, 2, 4000)]
        total.update(map(tuple, rows.tolist()))
        left, right = packing.keys(list(rows.T))
        back = np.stack(packing.numbers(left, right), axis=1)
        assert (back == rows).all() and int(left.max()) < 2**packing.left_bits and int(right.max()) < 2**packing.right_bits
        counts = Counts.of(packing, left, right)
        prefix_bits = min(2, packing.left_bits)
        prefix = counts.left >> np.uint64(packing.left_bits - prefix_bits)
        for p in np.unique(prefix).tolist():
            own = Counts(*(a[prefix == p] for a in (counts.left, counts.right, counts.times)))
            again = decode(packing, encode(packing, own, prefix_bits), p, prefix_bits)
            assert all((a == b).all() for a, b in zip((own.left, own.right, own.times), (again.left, again.right, again.times)))
            parts.setdefault(p, []).append(again)
    found = {}
    for p, filters in sorted(parts.items()):
        counts = merged(packing, filters)
        found.update(zip(map(tuple, np.stack(packing.numbers(counts.left, counts.right), axis=1).tolist()), counts.times.tolist()))
    assert found == total


def test_permutation_is_one_to_one():
    packing = Packing(3, 4)
    rows = np.stack(np.unravel_index(np.arange(4096), (16, 16, 16)))
    left, right = packing.keys(list(rows))
    assert len(set(zip(left.tolist(), right.tolist()))) == 4096


def brute(rows, least, top=2000, percent=80):
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if (own or "und") != lang:
                continue
            folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            for piece in re.split(r"[.,;:!?\x0a-\x0d]", folded):
                ws = re.findall(r"[^\x20\x09]+", piece)
                n += len(ws)
                f.update(tuple(ws[i : i + k]) for k in range(1, 5) for i in range(len(ws) - k + 1))
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        most = Counter()
        for g, a in often.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    most[g[i : i + k]] = max(most[g[i : i + k]], a)
        found = []
        for g, a in often.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            if not (g in most and 100 * most[g] >= percent * a):
                found.append((-score, -a, " ".join(g).encode(), " ".join(g), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p, -a, left, right, n, -s) for i, (s, a, _, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["New", "york", "city", "hall", "of", "the", "é", "\x1c", "日本", "a\x00b", "X"] + [f"w{i}" for i in range(30)]
    out = [("en", None), (None, ""), ("en", " \t."), (None, "the the the the the the"), ("de", "no, candidate")]
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 30)):
            parts.append(rng.choice(["New york", "new York city", "new york city hall", "of the", rng.choice(words)]) if rng.random() < 0.6 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "?!"]))
        out.append((rng.choice(["en", "en", "fr", None]), "".join(parts)))
    return out + out[:50]


@pytest.mark.parametrize("chunk,segment,least", [(1_000_000, 3_000_000, 30), (200, 50, 30), (37, 8, 3)])
def test_collocations_equal_plain_counting(spark, rows, chunk, segment, least):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(docs, least=least, words_per_chunk=chunk, words_per_segment=segment)
    assert sorted(map(tuple, got.collect())) == brute(rows, least)


def test_top_and_ties(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, least=2, top=7).collect())) == brute(rows, 2, top=7)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    odd = spark.createDataFrame([(1, "a b", "x", 1)] * 40, "rank int, text string, word string, ids int").selectExpr("*", "cast(null as string) lang")
    assert [tuple(r) for r in collocations.collocations(odd).collect()] == [("und", 1, "a b", 40, 40, 40, 80, 1_000_000)]


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = sorted(con.execute(collocations.ORACLE_SQL).fetchall())
    assert len(want) > 100 and sorted(map(tuple, queries.op11_collocations(spark, sf).collect())) == want
