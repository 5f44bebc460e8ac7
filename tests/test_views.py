"""Pages far back, text search by grams, and joins of bucketed ledgers without exchanges."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators import ledger, text_index, views
from ledgermatch.sources.bucketed import drop_table, store_bucketed

T0 = datetime(2026, 8, 17)
ROW = "discrepancy_id string, fingerprint string, group_key string, match_key string, left_ref string, right_ref string, updated_at timestamp, disposed_at timestamp, disposition string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    made = []
    for i in range(600):
        at = rng.choice([T0, T0, T0 + timedelta(seconds=rng.randint(0, 10**8)), T0 + timedelta(microseconds=rng.randint(0, 3)), None])
        made.append((f"{rng.randrange(16**8):08x}-{i}", f"{rng.randrange(16**12):012x}", f"O{i}", None if i % 9 == 0 else f"Key_{i}%x", f"l:É{i}", None, at, None if i % 5 else T0 + timedelta(days=i), "CLOSED" if i % 5 == 0 else None))
    return spark.createDataFrame(made, ROW).repartition(5).cache()


def test_every_page_is_where_sorting_puts_it(spark, rows):
    whole = sorted(((r["disposed_at"] or r["updated_at"] or datetime.min, r["discrepancy_id"]) for r in rows.collect()), reverse=True)
    changed = F.coalesce("disposed_at", "updated_at")
    cells = [*views._time_cells(changed), *[F.substring("discrepancy_id", 1, n) for n in (2, 4)]]
    for skip in (0, 1, 50, 130, 299, 480, 598, 599):
        found, rest = views.located(rows, cells, skip, most=5)
        got = found.orderBy(F.desc(changed), F.desc("discrepancy_id")).limit(rest + 3).offset(rest).collect()
        assert [r["discrepancy_id"] for r in got] == [i for _, i in whole[skip : skip + 3]] and rest <= 5
    assert views.located(rows, cells, 600)[0].count() == 0
    page = lambda **k: [r["discrepancy_id"] for r in views.list_discrepancies(rows, size=7, **k)[0].collect()]
    ids = [i for _, i in whole]
    assert page(page=0) == ids[:7] and page(page=3) == ids[21:28] and page(page=85) == ids[595:] and page(page=86) == []
    assert page(after=whole[6]) == ids[7:14]
    assert page(page=2, status="CLOSED") == [r["discrepancy_id"] for r in rows.where("disposition = 'CLOSED'").orderBy(F.desc(changed), F.desc("discrepancy_id")).collect()][14:21]
    with pytest.raises(ValueError):
        page(page=-1)


def test_a_deep_page_sorts_few_rows(spark, rows):
    """The plan takes the page from the rows of a cell on; no exchange sorts all."""
    runs = spark.range(50_000).select(F.concat(F.lit("R"), "id").alias("run_id"), F.lit("S").alias("scenario"), F.lit("P").alias("period"), F.lit("OK").alias("status"), F.col("id").alias("sequence_no"), F.timestamp_seconds(F.col("id")).alias("created_at"))
    page, total = views.list_runs(runs, page=2000, size=20)
    assert [r["sequence_no"] for r in page.collect()] == list(range(49_999 - 40_000, 49_999 - 40_020, -1)) and total.first()["total"] == 50_000
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=" in plan and "Exchange" not in plan
    assert int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0]) < 10_100
    assert [r["sequence_no"] for r in views.latest_five(runs).collect()] == [49_999, 49_998, 49_997, 49_996, 49_995]
    last = page.collect()[-1]
    assert views.list_runs(runs, after=(last["created_at"], last["sequence_no"], last["run_id"]), size=2)[0].first()["sequence_no"] == 9_979


@pytest.mark.parametrize("text", ["key_12", "O1", "o5", "É3", "é30", "%", "y_1%x", "abc", "0%1", "_", "zzz", "key\\_1", "l:"])
def test_search_by_grams_equals_reading_all(spark, rows, text, tmp_path_factory):
    path = getattr(test_search_by_grams_equals_reading_all, "path", None)
    if path is None:
        path = test_search_by_grams_equals_reading_all.path = f"file://{tmp_path_factory.mktemp('index')}"
        text_index.write_index(rows, path, parts=16)
    found = text_index.search(spark, path, text)
    assert found.columns == rows.columns
    assert sorted(r["discrepancy_id"] for r in found.collect()) == sorted(r["discrepancy_id"] for r in rows.where(views.holds_text(text)).collect())


def test_a_search_reads_few_parts(spark, rows, tmp_path):
    path = f"file://{tmp_path}/index"
    text_index.write_index(rows, path, parts=16)
    found = text_index.search(spark, path, "O123")
    plan = found._jdf.queryExecution().executedPlan().toString()
    rows_scan, grams_scan = (next(x for x in plan.split("\n") if "FileScan" in x and column in x) for column in ("match_key#", "[gram#"))
    assert found.count() == 1 and re.search(r"PartitionFilters: \[isnotnull\(part#\d+\), \(part#\d+ = \d+\)\]", rows_scan) and re.search(r"PushedFilters: \[In\(gram, ", grams_scan)
    # Files of grams hold ranges of them, so that statistics tell most apart.
    ranges = spark.read.parquet(f"{path}/grams").groupBy(F.input_file_name()).agg(F.min("gram").alias("lo"), F.max("gram").alias("hi")).where("lo <= '123' and hi >= '123'")
    assert ranges.count() <= 2
    with pytest.raises(ValueError):
        text_index.search(spark, f"{path}-none", "abc")


def test_the_index_is_small_beside_its_rows(spark, tmp_path):
    """Rows with a gram stand together as places in a block, not as a row each with its id."""
    made = [(f"{i:08x}-{i * 7919 % 65536:04x}", f"{i * 2654435761 % 2**32:08x}" * 8, f"O{i}", f"K{i % 50}", f"l:{i}", None) for i in range(3000)]
    rows = spark.createDataFrame(made, ROW.split(", updated_at")[0]).coalesce(1)
    text_index.write_index(rows, f"file://{tmp_path}/index", parts=2)
    size = lambda table: sum(f.stat().st_size for f in (tmp_path / "index" / table).rglob("*.parquet"))
    pairs = sum(len({v.lower()[i : i + 3] for v in r if v for i in range(len(v) - 2)}) for r in made)
    assert spark.read.parquet(f"file://{tmp_path}/index/grams").count() < pairs / 4 and size("grams") < 2 * pairs + 200_000
    for text in ("K7", "2654", "0000%1"):
        found = text_index.search(spark, f"file://{tmp_path}/index", text)
        assert sorted(found.collect()) == sorted(rows.where(views.holds_text(text)).collect())


def test_bucketed_ledgers_meet_without_exchanges(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = lambda lo, hi: spark.range(lo, hi).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"))
        first = store_bucketed(keys(0, 500), "t_first", buckets=8, path=f"file://{tmp_path}/first")
        second = store_bucketed(keys(250, 750), "t_second", buckets=8, path=f"file://{tmp_path}/second")
        state = store_bucketed(keys(0, 400).select("fingerprint", F.lit("CLOSED").alias("status"), F.lit(0).cast("long").alias("version"), F.lit("R0").alias("last_seen_run")), "t_state", buckets=8, path=f"file://{tmp_path}/state")
        change = ledger.run_difference(first, second)
        after = ledger.converge_dispositions(state, second, "R1")
        counts = views.dashboard_counts(second, state)
        for df in (change, after):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0
        assert {r["change"]: r["count"] for r in change.groupBy("change").count().collect()} == {"vanished": 250, "new": 250, "relinked": 250}
        assert after.where("status = 'STALE'").count() == 250 and counts.first()["n_closed"] == 150
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for t in ("t_first", "t_second", "t_state"):
            drop_table(spark, t)


def test_dispositions_converge_on_stored_fingerprints(spark):
    from ledgermatch import queries

    for query in (queries.recon_converge_dispositions, queries.recon_converge_latest):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "sha2(" not in plan and "hashpartitioning(fingerprint" not in plan
