"""Publication of runs: all tables or none, re-runs, attempts that die, and attempts that race."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators.classify import Rule
from ledgermatch.plans import demo, pipeline
from ledgermatch.sources import versions

SF = "/root/testdata/sf0.001"


def small(spark, run_id="R:1", amount=1):
    return spark.createDataFrame([(run_id, "k", amount)], "run_id string, key string, amount int")


def write(spark, root, amount, run_id="R:1", tables=("a", "b")):
    attempt = versions.Attempt(spark, root, run_id)
    for t in tables:
        attempt.write(t, small(spark, run_id, amount))
    return attempt


def amounts(spark, root, run_id="R:1"):
    now = versions.published(spark, root, run_id)
    return now and (now.number, [now.table(t).first()["amount"] for t in sorted(now.tables)])


def test_readers_see_all_tables_of_one_attempt(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert amounts(spark, root) is None
    first = write(spark, root, 1)
    assert amounts(spark, root) is None  # nothing is visible yet
    first.publish(status="COMPLETED")
    second = write(spark, root, 2, tables=("a",))  # dies between its tables
    assert amounts(spark, root) == (1, [1, 1])
    second.write("b", small(spark, "R:1", 2))
    assert amounts(spark, root) == (1, [1, 1])
    second.publish(status="REPORT_IMBALANCE")
    assert amounts(spark, root) == (2, [2, 2]) and versions.published(spark, root, "R:1").facts == {"status": "REPORT_IMBALANCE"}
    assert versions.published(spark, root, "R:1").table("a").columns == ["run_id", "key", "amount"]


def test_of_two_attempts_one_is_published(spark, tmp_path):
    root = f"file://{tmp_path}"
    one, two = write(spark, root, 1), write(spark, root, 2)
    two.publish()
    with pytest.raises(versions.PublishConflict):
        one.publish()
    assert amounts(spark, root) == (1, [2, 2])
    assert not glob.glob(f"{tmp_path}/manifests/*/.??*json")


def test_vacuum_and_lists(spark, tmp_path):
    root = f"file://{tmp_path}"
    for amount in (1, 2):
        write(spark, root, amount).publish(period="p")
    write(spark, root, 3)  # never published
    write(spark, root, 7, run_id="R:2").publish(period="q")
    listed = {r["run_id"]: (r["number"], json.loads(r["facts"])["period"], sorted(json.loads(r["tables"]))) for r in versions.manifests(spark, root).collect()}
    assert listed == {"R:1": (2, "p", ["a", "b"]), "R:2": (1, "q", ["a", "b"])}
    assert sorted(map(tuple, versions.table_of_runs(spark, root, "a", ["R:1", "R:2", "R:3"]).collect())) == [("R:1", "k", 2), ("R:2", "k", 7)]
    with pytest.raises(ValueError):
        versions.table_of_runs(spark, root, "a", ["R:3"])
    assert len(versions.vacuum(spark, root, "R:1")) == 2 and amounts(spark, root) == (2, [2, 2])
    assert len(glob.glob(f"{tmp_path}/attempts/*1/*")) == 1 and versions.vacuum(spark, root, "R:9") == []
    assert versions.manifests(spark, f"{root}/none").count() == 0


def test_a_run_that_dies_leaves_the_former_run_whole(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    pipeline.write_run(demo.run(spark, SF, dropped=7), root)
    before = versions.published(spark, root, demo.RUN)
    state = lambda p: {t: p.table(t).count() for t in pipeline.RUN_TABLES}
    alerts = spark.read.parquet(f"{root}/alert").count()

    def dies(*a, **b):
        raise OSError("killed")

    for step in ("with_discrepancy_ids", "proven_report", "finished"):
        with monkeypatch.context() as m:
            m.setattr(pipeline, step, dies)
            with pytest.raises(OSError):
                pipeline.write_run(demo.run(spark, SF), root)
        assert versions.published(spark, root, demo.RUN) == before and spark.read.parquet(f"{root}/alert").count() == alerts
    counts = state(before)
    with monkeypatch.context() as m:  # published, but its handlers have not run
        m.setattr(pipeline, "append_absent", dies)
        with pytest.raises(OSError):
            pipeline.write_run(demo.run(spark, SF), root)
    after = versions.published(spark, root, demo.RUN)
    assert after.number == before.number + 1 and state(after) != counts
    done = pipeline.write_run(demo.run(spark, SF), root)
    assert state(versions.published(spark, root, demo.RUN)) == state(after)
    missing = done["discrepancies"].select(F.concat(F.lit("alert:"), "fingerprint").alias("idempotency_key")).join(done["alert"], "idempotency_key", "left_anti")
    assert missing.count() == 0 and done["alert"].count() == done["alert"].select("idempotency_key").distinct().count()


def test_a_repeated_fingerprint_is_never_published(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    monkeypatch.setattr(pipeline, "discrepancies", lambda c, f=pipeline.discrepancies: f(c).unionByName(f(c)))
    with pytest.raises(ValueError, match="a run holds a fingerprint twice"):
        pipeline.write_run(demo.run(spark, SF, rule=Rule()), root)
    assert versions.published(spark, root, demo.RUN) is None
