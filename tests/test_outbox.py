"""Leases of remediation commands: golden cases of claiming, settling, and workers that die."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators import outbox

COMMAND = "tenant_id string, command_id string, suggestion_id string, status string, attempt int, next_attempt timestamp, lease_owner string, lease_until timestamp, published_at timestamp, last_error string, created_at timestamp"
RESULT = "tenant_id string, command_id string, worker string, ok boolean, error string, at long"
T0 = datetime(2026, 8, 17)


def command(i, status="PENDING", attempt=0, wait=None, owner=None, lease=None, tenant="T"):
    at = lambda s: None if s is None else T0 + timedelta(seconds=s)
    return (tenant, f"C{i}", f"S{i}", status, attempt, at(wait), owner, at(lease), None, None, T0 + timedelta(seconds=i))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COMMAND)


def now(seconds=0):
    return F.lit(T0 + timedelta(seconds=seconds))


def state(df):
    return {r["command_id"]: (r["status"], r["attempt"], r["lease_owner"]) for r in df.collect()}


def test_what_is_due(spark):
    rows = frame(spark, command(1), command(2, "FAILED", 3, wait=0), command(3, "FAILED", 3, wait=1), command(4, "SENDING", 1, owner="w", lease=60), command(5, "PUBLISHED", 1), command(6, "DEAD", 10), command(0, "FAILED", 1))
    assert [r["command_id"] for r in outbox.due(rows, now()).collect()] == ["C0", "C1", "C2"]
    assert [r["command_id"] for r in outbox.due(rows, now(), limit=2).collect()] == ["C0", "C1"]


def test_a_claim_counts_an_attempt_and_holds_a_lease(spark):
    rows = frame(spark, command(1), command(2, "FAILED", 3), command(3, "FAILED", 3, wait=1), command(4, "SENDING", 1, owner="v", lease=60), command(5, "SENDING", 1, owner="v", lease=-1))
    after = outbox.claim_commands(rows, "w", now(), limit=10)
    assert after.columns == rows.columns
    assert state(after) == {"C1": ("SENDING", 1, "w"), "C2": ("SENDING", 4, "w"), "C3": ("FAILED", 3, None), "C4": ("SENDING", 1, "v"), "C5": ("SENDING", 2, "w")}
    assert {r["lease_until"] for r in outbox.held(after, "w").collect()} == {T0 + timedelta(seconds=60)}
    # A second worker of the same moment gets nothing.
    assert state(outbox.claim_commands(after, "x", now())) == state(after)


def test_equal_command_ids_of_two_tenants_are_two(spark):
    rows = frame(spark, command(1), command(1, tenant="U"))
    after = outbox.claim_commands(rows, "w", now(), limit=1)
    assert sorted((r["tenant_id"], r["status"]) for r in after.collect()) in ([("T", "SENDING"), ("U", "PENDING")], [("T", "PENDING"), ("U", "SENDING")])


def test_only_the_holder_settles(spark):
    rows = frame(spark, *(command(i, "SENDING", 2, owner="w", lease=60) for i in range(5)), command(5, "PUBLISHED", 1), command(6, "DEAD", 10))
    results = [("T", "C0", "w", True, None, 1), ("T", "C1", "w", False, "x" * 600, 1), ("T", "C2", "v", True, None, 1), ("T", "C3", "w", True, None, 1), ("T", "C3", "w", False, "late", 2), ("T", "C5", "w", False, "late", 1), ("T", "C6", "w", True, None, 1), ("T", "C9", "w", True, None, 1), ("U", "C4", "w", True, None, 1)]
    after, outcomes = outbox.settle_commands(rows, spark.createDataFrame(results, RESULT), now(5))
    assert state(after) == {"C0": ("PUBLISHED", 2, None), "C1": ("FAILED", 2, None), "C2": ("SENDING", 2, "w"), "C3": ("PUBLISHED", 2, None), "C4": ("SENDING", 2, "w"), "C5": ("PUBLISHED", 1, None), "C6": ("DEAD", 10, None)}
    row = after.where("command_id = 'C1'").first()
    assert row["next_attempt"] == T0 + timedelta(seconds=9) and len(row["last_error"]) == 512 and after.where("command_id = 'C0'").first()["published_at"] == T0 + timedelta(seconds=5)
    got = sorted((r["tenant_id"], r["command_id"], r["at"], r["outcome"]) for r in outcomes.collect())
    assert got == [("T", "C0", 1, "published"), ("T", "C1", 1, "failed"), ("T", "C2", 1, "lost"), ("T", "C3", 1, "published"), ("T", "C3", 2, "lost"), ("T", "C5", 1, "lost"), ("T", "C6", 1, "lost"), ("T", "C9", 1, "lost"), ("U", "C4", 1, "lost")]


@pytest.mark.parametrize("attempt,status,wait", [(1, "FAILED", 2), (5, "FAILED", 32), (8, "FAILED", 256), (9, "FAILED", 256), (10, "DEAD", 256), (14, "DEAD", 256)])
def test_backoff_and_dead_letters(spark, attempt, status, wait):
    rows = frame(spark, command(1, "SENDING", attempt, owner="w", lease=60))
    after, _ = outbox.settle_commands(rows, spark.createDataFrame([("T", "C1", "w", False, "e", 1)], RESULT), now())
    row = after.first()
    assert (row["status"], row["attempt"], row["next_attempt"]) == (status, attempt, T0 + timedelta(seconds=wait))


def test_a_command_that_kills_its_holder(spark):
    """Each claim counts, so when a failure is at last reported after ten claims the command is dead; a late report of a lost lease changes nothing."""
    rows, none = frame(spark, command(1)), spark.createDataFrame([], RESULT)
    for n in range(10):
        rows = spark.createDataFrame(outbox.claim_commands(rows, f"w{n}", now(100 * n)).collect(), COMMAND)
        assert state(rows) == {"C1": ("SENDING", n + 1, f"w{n}")}
        rows, _ = outbox.settle_commands(rows, none, now(100 * n))
        rows = spark.createDataFrame(rows.collect(), COMMAND)
    late, outcomes = outbox.settle_commands(rows, spark.createDataFrame([("T", "C1", "w3", True, None, 1)], RESULT), now(950))
    assert state(late) == {"C1": ("SENDING", 10, "w9")} and outcomes.first()["outcome"] == "lost"
    assert state(outbox.settle_commands(rows, spark.createDataFrame([("T", "C1", "w9", False, "e", 1)], RESULT), now(950))[0]) == {"C1": ("DEAD", 10, None)}


def test_publishing_dispatches_in_the_same_step(spark):
    rows = frame(spark, *(command(i, "SENDING", 1, owner="w", lease=60) for i in range(4)))
    suggestions = spark.createDataFrame([("S0", "APPROVED", 1), ("S1", "DISPATCHING", 2), ("S2", "APPROVED", 1)], "suggestion_id string, status string, version long")
    results = [("T", "C0", "w", True, None, 1), ("T", "C1", "w", True, None, 1), ("T", "C2", "w", False, "down", 1), ("T", "C3", "w", True, None, 1)]
    commands, after, outcomes = outbox.relay(rows, suggestions, spark.createDataFrame(results, RESULT), now())
    assert state(commands) == {"C0": ("PUBLISHED", 1, None), "C1": ("FAILED", 1, None), "C2": ("FAILED", 1, None), "C3": ("FAILED", 1, None)}
    assert {r["suggestion_id"]: (r["status"], r["version"]) for r in after.collect()} == {"S0": ("DISPATCHING", 2), "S1": ("DISPATCHING", 2), "S2": ("APPROVED", 1)}
    errors = {r["command_id"]: r["last_error"] for r in commands.collect()}
    assert errors["C2"] == "down" and errors["C3"].endswith("not_found") and errors["C0"] is None and outcomes.where("outcome = 'published'").count() == 1
