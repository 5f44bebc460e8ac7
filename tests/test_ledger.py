"""Stateful ledgers, views, entitlements, events and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators import entitlement, ledger, views
from ledgermatch.plans import demo
from ledgermatch.sources.sinks import append_absent, assert_unique, clear_run, replace_run, with_discrepancy_ids
from ledgermatch.streaming import events as ev, reconcile

D = "run_id string, segment_id string, fingerprint string, type string, currency string, delta long"


def test_convergence(spark):
    old = spark.createDataFrame([("a", "RESOLVED", 0, "R1"), ("b", "RESOLVED", 2, "R1"), ("c", "STALE", 3, "R0")], "fingerprint string, status string, version long, last_seen_run string")
    now = spark.createDataFrame([("a",), ("d",)], "fingerprint string")
    got = {r["fingerprint"]: tuple(r)[1:] for r in ledger.converge_dispositions(old, now, "R2").drop("audit_payload").collect()}
    assert got == {"a": ("RESOLVED", 0, "R2", None), "b": ("STALE", 3, "R1", "stale:b:2"), "c": ("STALE", 3, "R0", None)}


def test_disposition_conflicts(spark):
    state = spark.createDataFrame([("a", "RESOLVED", 1)], "fingerprint string, status string, version long")
    known = spark.createDataFrame([("a",), ("n",)], "fingerprint string")
    ask = [("a", "RESOLVE", "op", None, 1, 1), ("a", "CLOSE", "op", None, 1, 2), ("n", "SUPPRESS", "op", None, None, 1), ("x", "CLOSE", "op", None, None, 1), ("n", "CLOSE", None, None, None, 2)]
    out = ledger.apply_dispositions(state, spark.createDataFrame(ask, "fingerprint string, action string, operator string, note string, expected_version long, at long"), known)
    got = {(r["fingerprint"], r["at"]): (r["outcome"], r["new_version"], r["audit_key"]) for r in out.collect()}
    assert got == {("a", 1): ("noop", None, None), ("a", 2): ("conflict", None, None), ("n", 1): ("accepted", 0, "manual:SUPPRESS:n:0"), ("x", 1): ("not_found", None, None), ("n", 2): ("invalid", None, None)}


def test_versions_of_open_discrepancies(spark):
    state = spark.createDataFrame([], "fingerprint string, status string, version long")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "fingerprint string")
    ask = [("a", "CLOSE", "op", None, -1, 1), ("b", "CLOSE", "op", None, 0, 1), ("c", "CLOSE", "op", None, None, 1)]
    out = ledger.apply_dispositions(state, spark.createDataFrame(ask, "fingerprint string, action string, operator string, note string, expected_version long, at long"), known)
    assert {r["fingerprint"]: r["outcome"] for r in out.collect()} == {"a": "invalid", "b": "conflict", "c": "accepted"}


def test_only_the_latest_run_of_a_scenario_converges(spark):
    old = spark.createDataFrame([("a", "S", "P", "CLOSED", 0, "R0"), ("b", "S", "Q", "CLOSED", 0, "R0"), ("c", "S", "P", "CLOSED", 4, "R0")], "fingerprint string, scenario string, period string, status string, version long, last_seen_run string")
    now = spark.createDataFrame([("c",)], "fingerprint string")
    runs = spark.createDataFrame([("R1", "S", "P", 1), ("R2", "S", "P", 2)], "run_id string, scenario string, period string, sequence_no long")
    state = lambda run: {r["fingerprint"]: (r["status"], r["version"], r["last_seen_run"], r["audit_payload"]) for r in ledger.converge_dispositions(old, now, run, runs).collect()}
    assert state("R1") == {"a": ("CLOSED", 0, "R0", None), "b": ("CLOSED", 0, "R0", None), "c": ("CLOSED", 4, "R0", None)}
    assert state("R2") == {"a": ("STALE", 1, "R0", "priorStatus=CLOSED,runId=R2"), "b": ("CLOSED", 0, "R0", None), "c": ("CLOSED", 4, "R2", None)}


def test_handlers_are_idempotent(spark):
    d = spark.createDataFrame([("R", "S", "f1", "AMOUNT_MISMATCH", "USD", 5), ("R", "S", "f2", "TIMING", "USD", 0)], D)
    first = ledger.handle(d)
    assert {n: t.count() for n, t in first.items()} == {"ledger": 2, "reversal": 1, "alert": 2}
    assert all(t.count() == 0 for t in ledger.handle(d, first).values())


def test_delivery_gives_results_that_alerts_take(spark, tmp_path):
    d = spark.createDataFrame([("R", "S", f"f{i}", "TIMING", "USD", 0) for i in range(3)], D)
    alerts = ledger.handle(d)["alert"]
    sent = spark.sparkContext.accumulator(0)

    def send(row):
        sent.add(1)
        if row["fingerprint"] == "f1":
            raise OSError("no receiver")

    results = ledger.deliver(alerts, send, f"file://{tmp_path}/sent")
    got = {r["idempotency_key"]: (r["ok"], r["error"]) for r in results.collect()}
    assert got == {"alert:f0": (True, None), "alert:f1": (False, "no receiver"), "alert:f2": (True, None)} and results.count() == 3 and sent.value == 3
    after = {r["idempotency_key"]: (r["status"], r["attempt"]) for r in ledger.alerts_after(alerts, results).collect()}
    assert after == {"alert:f0": ("SENT", 0), "alert:f1": ("FAILED", 1), "alert:f2": ("SENT", 0)}


def test_insert_if_absent_and_run_replacement(spark, tmp_path):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    path = f"file://{tmp_path}/t"
    assert append_absent(new, spark, path, "k") == 2 and append_absent(new, spark, path, "k") == 0 and spark.read.parquet(path).count() == 2
    runs = spark.createDataFrame([("R:1", 1), ("R:2", 2)], "run_id string, v int")
    root = f"file://{tmp_path}/m"
    for r in ("R:1", "R:2", "R:1"):
        replace_run(runs, f"{root}/records", r)
    assert sorted(map(tuple, spark.read.parquet(f"{root}/records").select("run_id", "v").collect())) == [("R:1", 1), ("R:2", 2)]
    clear_run(spark, root, "R:1", {"records": "run_id string, v int"})
    assert [r["run_id"] for r in spark.read.parquet(f"{root}/records").collect()] == ["R:2"]


def test_ids_depend_on_run_and_fingerprint(spark):
    d = spark.createDataFrame([("R", "S", "f", "TIMING", None, 0), ("R", "S", "g", "TIMING", None, 0), ("Q", "S", "f", "TIMING", None, 0)], D)
    ids = [r["discrepancy_id"] for r in with_discrepancy_ids(d).collect()]
    assert len(set(ids)) == 3 and ids == [r["discrepancy_id"] for r in with_discrepancy_ids(d).collect()]


def test_repeated_discrepancies_fail(spark):
    twice = spark.createDataFrame([("R", "S", "f", "TIMING", None, 0), ("R", "S", "f", "TIMING", None, 0)], D)
    with pytest.raises(Exception, match="run holds a fingerprint twice"):
        assert_unique(with_discrepancy_ids(twice), ["run_id", "fingerprint"], "a run holds a fingerprint twice")
    assert assert_unique(twice.limit(1), ["run_id", "fingerprint"], "no") is not None


def test_rerun_gives_equal_results(spark):
    one, two = (demo.run(spark, "/root/testdata/sf0.001").discrepancies for _ in range(2))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_remediation_proposals(spark):
    rows = [("T", "S", "d", "A", None, "REISSUE", "r"), ("T", "S", "d", "A", None, "MANUAL_REVIEW", "r"), ("T", "S", "e", "A", "op", "REISSUE", "r"), ("T", "S", "e", "A", "op", "REISSUE", "s")]
    p = spark.createDataFrame(rows, "tenant_id string, scenario string, discrepancy_ref string, award_item_no string, original_operation_no string, action string, reason string")
    out = ledger.propose_remediations(p, spark.createDataFrame([], "suggestion_id string"))
    assert sorted(r["outcome"] for r in out.collect()) == ["accepted", "accepted", "duplicate", "invalid"]
    approved = out.where("outcome = 'accepted' and action = 'REISSUE'").withColumn("approval_ref", F.lit("REF"))
    cmd = ledger.remediation_commands(approved, F.lit("2026-08-17 01:02:03").cast("timestamp")).first()
    event = json.loads(cmd["payload"])
    assert event["eventId"] == event["payload"]["externalCommandId"] == cmd["command_id"] == "recon-remediation:" + cmd["suggestion_id"]
    assert event["payload"]["approvalRef"] == "REF" and event["payload"]["action"] == "REISSUE" and event["occurredAt"] == "2026-08-17T01:02:03Z" and event["traceId"] == cmd["suggestion_id"]
    assert (cmd["status"], cmd["attempt"], cmd["next_attempt"], cmd["lease_owner"]) == ("PENDING", 0, None, None)


def test_approval_needs_a_reference(spark):
    state = spark.createDataFrame([("a", "PROPOSED", 0, "REISSUE"), ("b", "PROPOSED", 0, "REISSUE"), ("c", "PROPOSED", 0, "MANUAL_REVIEW")], "suggestion_id string, status string, version long, action string")
    ask = [("a", "APPROVE", None, 1, " "), ("a", "APPROVE", None, 2, "REF"), ("b", "REJECT", None, 1, None), ("c", "APPROVE", None, 1, "REF")]
    out = ledger.step_remediations(state, spark.createDataFrame(ask, "suggestion_id string, action string, expected_version long, at long, approval_ref string"))
    assert sorted((r["suggestion_id"], r["at"], r["outcome"]) for r in out.collect()) == [("a", 1, "invalid"), ("a", 2, "accepted"), ("b", 1, "accepted"), ("c", 1, "illegal")]


def test_run_windows_are_utc_days(spark):
    request = spark.createDataFrame([("r", "S", "2026-08-17", None)], "request_id string, scenario string, period string, buckets int")
    runs = spark.createDataFrame([], "scenario string, period string, sequence_no long")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            row = ledger.plan_runs(request, runs).select(*[F.unix_timestamp(c).alias(c) for c in ("window_start", "window_end", "cutoff")]).first()
            assert (row["window_start"], row["window_end"], row["cutoff"]) == (1786924800, 1786924800 + 172799, 1786924800 + 82800)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rollup_and_skew(spark):
    r = spark.createDataFrame([("R", "A", "USD", True, 200), ("R", "B", "USD", False, 500), ("R", "A", "EUR", True, 0)], "run_id string, segment_id string, currency string, balanced boolean, bridge_broken long")
    got = {x["currency"]: (x["consistent"], x["bridge_broken"]) for x in views.three_way_rollup(r, "A", "B").collect()}
    assert got == {"USD": (False, 700), "EUR": (False, 0)} and not views.overall_consistency(views.three_way_rollup(r, "A", "B")).first()["consistent"]
    rows = spark.createDataFrame([("S", 0)] * 30 + [("S", 1)] * 2 + [("S", 2)] * 2, "segment_id string, bucket int")
    hot = [x["bucket"] for x in views.bucket_skew(rows, factor=2.0, least=5).where("hot").collect()]
    assert hot == [0]
    keys = spark.createDataFrame([("S", "k", "a"), ("S", "k", "b"), ("S", "c", "a"), ("S", None, "a"), ("S", None, "b")], "segment_id string, match_key string, group_key string")
    assert [tuple(x) for x in views.refine_violations(keys).collect()] == [("S", "k", 2)]


def obs(role, event, sku="s", q=1, status="ISSUED", ref=None):
    return ("T", event, "I", sku, q, status, ref, role, None, event)


def labels(spark, rows):
    df = spark.createDataFrame(rows, "tenant_id string, event_id string, issue_id string, sku_id string, quantity long, status string, provider_ref string, role string, occurred_at timestamp, raw_ref string")
    valid, rejects = entitlement.split_observations(df)
    return entitlement.entitlement_labels(entitlement.entitlement_groups(valid)).first()["labels"], rejects.count()


def test_entitlement_labels(spark):
    e, i, p = obs("EXPECTED", "e", status="EXPECTED"), obs("INTERNAL", "i", ref="r"), obs("PROVIDER", "p", ref="r")
    assert labels(spark, [e, i, p]) == (["CLEAN"], 0)
    assert labels(spark, [e]) == (["MISSING_INTERNAL", "MISSING_PROVIDER", "QUANTITY_MISMATCH"], 0)
    assert labels(spark, [i, p]) == (["EXTRA_INTERNAL", "EXTRA_PROVIDER", "QUANTITY_MISMATCH"], 0)
    assert labels(spark, [e, i, i, p]) == (["DUPLICATE_INTERNAL", "QUANTITY_MISMATCH"], 0)
    assert labels(spark, [e, i, obs("PROVIDER", "p", sku="t", status="USED", ref="q")]) == (["SKU_MISMATCH", "STATUS_MISMATCH", "PROVIDER_REFERENCE_MISMATCH"], 0)
    assert labels(spark, [e, i, obs("PROVIDER", "p", status="UNKNOWN"), obs("PROVIDER", " ", q=0)]) == (["UNKNOWN"], 1)


def envelope(event_id="e1", fact="EXPECTED", **payload):
    body = {"factType": fact, "benefitType": "GOODS", "awardItemNo": "A", "awardOrderNo": "O", "skuId": "s", "quantity": 1, "status": "PENDING"} | payload
    return json.dumps({"eventId": event_id, "eventType": "FULFILLMENT_" + fact, "schemaVersion": "1", "tenantId": "T", "occurredAt": "2026-08-17T00:00:00Z", "payload": body})


def test_remediation_results(spark):
    text = [json.dumps({"eventId": "1", "eventType": t, "schemaVersion": "1.0", "tenantId": "T", "payload": {"externalCommandId": "c", "status": "FAILED"}}) for t in ("REMEDIATION_RESULT", "REMEDIATION_DISPATCHED", "OTHER")]
    got = [(r["command_id"], r["action"], r["reason"]) for r in ev.remediation_results(spark.createDataFrame([(t,) for t in text], "value string")).collect()]
    assert got == [("c", "FAILED", None), (None, None, None), (None, None, "eventType is not known")]


def test_windows(spark):
    df = spark.createDataFrame([("2026-08-17 00:10:00",), ("2026-08-17 00:50:00",)], "t string").withColumn("t", F.col("t").cast("timestamp"))
    assert df.groupBy(reconcile.time_window("t", "1 hour")).count().count() == 1
    assert df.groupBy(reconcile.time_window("t", "1 hour", "30 minutes")).count().count() == 3
    assert df.groupBy(reconcile.time_window("t", "", gap="20 minutes")).count().count() == 2


def test_empty_views(spark):
    runs = spark.createDataFrame([], "run_id string, scenario string, period string, sequence_no long, status string, created_at timestamp")
    page, total = views.list_runs(runs)
    assert page.count() == 0 and total.first()["total"] == 0
    report = spark.createDataFrame([], "run_id string, balanced boolean")
    one = spark.createDataFrame([("R",)], "run_id string")
    assert ledger.finished(one, report).first()["status"] == "COMPLETED"
