"""The attention model: gradients, held-out accuracy, blocks, and awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermatch.llm import quality_mil, queries

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron".split()


def test_gradients():
    rng = np.random.default_rng(2)
    model = quality_mil.AttentionModel.fresh(6, 4, 3, kind=np.float64)
    x, first = rng.random((9, 6)), np.array([0, 2, 3, 7])
    y, weight = np.array([0.0, 1.0, 1.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.0])
    _, grads = model.gradients(x, first, y, weight)
    for a, g in zip(model.weights(), grads):
        for at in list(np.ndindex(a.shape))[:12]:
            old, step = a[at], 1e-6
            a[at] = old + step
            up = model.gradients(x, first, y, weight)[0]
            a[at] = old - step
            down = model.gradients(x, first, y, weight)[0]
            a[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_attention_by_definition_and_blocks():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)).encode() for n in (1, 3000, 40, 0, 700)] + [None]
    model = quality_mil.AttentionModel.fresh()
    scores, top = model.judge_texts(texts, size=64)
    for text, score, passage in zip(texts, scores, top):
        text = text or b""
        hs = []
        for at in range(0, max(1, len(text)), 64):
            counts = np.zeros(quality_mil.N_FEATURES)
            piece = [*text, 256, 256]
            for i in range(at, min(at + 64, len(text))):
                a, b, c = piece[i : i + 3]
                k = [int(quality_mil._KIND[s]) for s in (a, b, c)]
                counts[(k[0] * quality_mil.N_KINDS + k[1]) * quality_mil.N_KINDS + k[2]] += 1
                counts[(((a * 257 + b) * 257 + c) * 0x9E3779B1 >> 12) % quality_mil.N_HASHED + quality_mil.N_KINDS**3] += 1
            size = max(1, min(64, len(text) - at))
            root = np.sqrt(counts / size)
            root[-1] = 1 - np.count_nonzero(counts[quality_mil.N_KINDS**3 :]) / size if counts.any() else 0
            hs.append(np.tanh(root @ model.encode + model.shift))
        h = np.array(hs)
        e = (np.tanh(h @ model.tanh_gate) * quality_mil._sigmoid(h @ model.sigmoid_gate)) @ model.attend
        a = np.exp(e) / np.exp(e).sum()
        assert score == pytest.approx(quality_mil._sigmoid((a @ h) @ model.judge + model.level)[0], abs=1e-4)
        assert a[passage] == pytest.approx(a.max(), abs=1e-5)
    again, places = model.judge_texts(texts, size=64, block=5)
    assert np.allclose(scores, again, atol=1e-5) and places == top


@pytest.fixture(scope="module")
def labelled(spark):
    """Bad texts have a stretch of shouting or signs somewhere, so no fixed place tells them."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(rng.randint(60, 300))]
        bad = i % 4 == 0
        if bad:
            at = rng.randint(0, len(words) - 40)
            words[at : at + 40] = [w.upper() + "!!" if i % 8 else w + "***" for w in words[at : at + 40]]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark, labelled):
    docs, labels = labelled
    model = quality_mil.train(docs, labels, usable=F.col("doc_id") % 5 != 0)
    held = quality_mil.judge(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0")
    right = held.where((F.col("score") >= 0.7) == (F.col("quality") == 1)).count()
    assert right >= 0.93 * held.count()


def test_awkward_rows(spark, labelled):
    docs, labels = labelled
    model = quality_mil.train(docs, labels, usable=F.lit(True), rows_per_label=30)
    rows = [(1, None, 5.0, "p"), (2, "", 5.0, "p"), (None, "a", 5.0, "p"), (3, "x" * 300_000, 5.0, "p"), (3, "x" * 300_000, 5.0, "p"), (4, "é\x00日本", None, None)]
    out = quality_mil.judge(spark.createDataFrame(rows, "doc_id long, text string, score double, passage string"), model)
    got = {(r["doc_id"], r["text"]): r["score"] for r in out.collect()}
    assert out.count() == 6 and out.columns == ["doc_id", "text", "score", "passage"] and all(0 <= s <= 1 for s in got.values())
    assert got[(1, None)] == got[(2, "")]
    assert quality_mil.judge(docs.limit(0), model).count() == 0
    assert quality_mil.train(docs, labels, usable=F.lit(False)) is None and quality_mil.train(docs.limit(0), labels, usable=F.lit(True)) is None
    assert {r["score"] for r in quality_mil.judge(docs, None).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (3, 7), (9999, 0)], "doc_id long, quality int")
    assert quality_mil.train(docs, odd, usable=F.lit(True), rows_per_label=5) is not None


def test_query_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op12_quality_mil(spark, sf).cache()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    held = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert held.where("predicted = quality").count() >= 0.93 * held.count()
    assert out.where("held_out <> (crc32(cast(doc_id as string)) % 4 = 2)").count() == 0
    out.unpersist()
