"""Vector operators against brute force, with unusable, zero and repeated vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermatch.llm import topk_search, vector_dedup
from ledgermatch.llm.components import connected_components

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=300, d=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for i in range(0, n, 3):  # near and exact copies
        x[i] = x[rng.integers(n)] + (rng.normal(size=d) * 0.05 if i % 2 else 0)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(n, None, 0), (n + 50, [float("nan")] * d, 0), (n + 51, [None] * d, 0), (n + 52, [0.0] * d, 0), (n + 53, [0.0] * d, 0), (n + 54, [float("inf")] * d, 0)]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(4), x, n


@pytest.mark.parametrize("shard_rows, query_rows", [(None, None), (40, 2)])
def test_top_k(spark, shard_rows, query_rows):
    df, x, n = vectors(spark)
    out = topk_search.top_k(df.withColumn("score", F.lit("clash")), is_query=F.col("vec_id") % 50 == 0, shard_rows=shard_rows, query_rows=query_rows).collect()
    q = np.floor(256 * np.vstack([x.astype(np.float64), np.zeros((2, x.shape[1]))])).astype(np.int64)
    ids = [*range(n), n + 52, n + 53]
    want = []
    for i in [i for i in ids if i % 50 == 0]:
        s = q @ q[ids.index(i)]
        best = sorted((-int(s[k]), j) for k, j in enumerate(ids) if j != i)[:5]
        want += [(i, r + 1, j, -v) for r, (v, j) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == sorted(want)


def test_top_k_of_repeated_rows_equals_its_sql(spark):
    import duckdb

    rows = [(i, [((i * 7 + d * 3) % 11) / 11 for d in range(4)]) for i in range(0, 120, 3)]
    rows += [rows[3]] * 8 + [(50, [0.5] * 4)] * 2 + [(100, [0.25] * 4), (100, [0.9] * 4), (150, None), (200, [float("nan")] * 4), (53, [0.9, 0.9, 0.9, 0.9])] + [rows[3]] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    want = sorted(con.execute(topk_search.ORACLE_SQL).fetchall())
    got = topk_search.top_k(df, is_query=F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want and {r["query_id"] for r in got} == {0, 50, 100}


def test_top_k_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], SCHEMA)
    assert [tuple(r) for r in topk_search.top_k(few, is_query=F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk_search.top_k(few.limit(0), is_query=F.lit(True)).count() == 0
    odd = spark.createDataFrame([(0, [1.0], 0), (1, [2.0, 1.0], 0), (2, [3.0], 0), (3, [1.0, 1.0], 0), (3, [2.0], 0)], SCHEMA)
    assert [(r["query_id"], r["vec_id"]) for r in topk_search.top_k(odd, is_query=F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 2), (0, 3)]
    large = spark.createDataFrame([(0, [1e6], 0), (1, [1e6], 0)], SCHEMA)
    with pytest.raises(Exception, match="not exact"):
        topk_search.top_k(large, is_query=F.lit(True), scale=256).collect()


@pytest.mark.parametrize("options", [{}, {"cluster_rows": 30, "shard_rows": 16, "overlap": 2}])
def test_vector_classes(spark, options):
    df, x, n = vectors(spark)
    out = {r["vec_id"]: r for r in vector_dedup.near_duplicate_vectors(df, **options).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        if (new == label).all():
            break
        label = new
    found = np.array([out[i]["n_links"] for i in range(n)])
    assert found.sum() >= 0.98 * near.sum() and (found <= near.sum(axis=1)).all()
    assert np.mean([out[i]["component_id"] == label[i] for i in range(n)]) >= 0.97
    for i in (n, n + 50, n + 51, n + 52, n + 53, n + 54):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert out[0]["recall"] >= 0.98 and out[0]["audited_links"] > 0
    assert vector_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_planted_copies_are_linked(spark):
    from ledgermatch.llm import queries

    sf = "/root/testdata/sf0.001"
    out = {r["vec_id"]: r for r in queries.vector_links_planted(spark, sf).collect()}
    given = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r["embedding"] is not None}
    ids = [i + c * 10**9 for i in given for c in range(1 + (i % 3 == 0) + (i % 9 == 0))]
    made = []
    for i in ids:
        base, c = i % 10**9, i // 10**9
        v = given[base]
        made.append(v + c * 0.05 * np.sqrt((v * v).mean()) * np.sin(base * 7.3 + c * 2.1 + np.arange(len(v)) * 1.7))
    u = np.array(made)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    found = np.array([out[i]["n_links"] for i in ids])
    assert want.sum() > len(given) / 3 and found.sum() >= 0.98 * want.sum() and (found <= want).all()
    assert out[ids[0]]["recall"] >= 0.9 and out[ids[0]]["audited_links"] >= 30


def test_vectors_of_one_id_and_of_other_lengths(spark):
    rows = [(7, [1.0, 0.0], 0), (7, [0.0, 1.0], 0), (8, [1.0, 0.01], 0), (9, [0.0, 2.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [3.0, 0.1, 0.0], 0), (None, [1.0, 0.0], 0), (12, [-1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_links", F.lit("clash")).withColumn("v", F.lit(1))
    out = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicate_vectors(df).collect())
    assert out == [(-1, 0, None, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False), (10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True)]


def test_recall_is_null_where_nothing_links(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(rng.normal(size=(200, 40)))], SCHEMA)
    out = vector_dedup.near_duplicate_vectors(df).collect()
    assert {(r["recall"], r["n_links"], r["kept"]) for r in out} == {(None, 0, True)}


def test_comparison_of_whole_shards(spark, monkeypatch):
    df, x, n = vectors(spark)
    monkeypatch.setattr(vector_dedup, "range_search", lambda *a: (np.zeros(0, int), np.zeros(0, int)))  # finds nothing
    out = {r["vec_id"]: r for r in vector_dedup.near_duplicate_vectors(df, cluster_rows=100, shard_rows=64).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert [out[i]["n_links"] for i in range(n)] == ((u @ u.T >= 0.9).sum(axis=1) - 1).tolist() and out[0]["recall"] == 1.0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 9), (7, 7), (None, 4)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 5: 3, 9: 3}
