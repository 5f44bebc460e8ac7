"""The outbox of remediation commands: workers claim due commands under a lease, and settle only what they still hold.

A command is (tenant_id, command_id, suggestion_id, payload, status, attempt, next_attempt, lease_owner, lease_until, published_at, last_error, created_at).
Its status is PENDING, SENDING while a worker holds it, PUBLISHED, FAILED until it is tried again, or DEAD.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ledger import REMEDIATION_STEPS, advanced, first_of_each, transition

KEY = ["tenant_id", "command_id"]
_LEASE = [("lease_owner", "string"), ("lease_until", "timestamp")]


def release_expired(commands: DataFrame, now: Column) -> DataFrame:
    """Commands whose lease has run out are FAILED and free again; their attempt was counted when they were claimed."""
    over = (F.col("status") == "SENDING") & (F.col("lease_until") < now)
    free = {c: F.when(over, F.lit(None).cast(kind)).otherwise(F.col(c)) for c, kind in _LEASE}
    return commands.withColumns({"status": F.when(over, "FAILED").otherwise(F.col("status")), **free})


def due(commands: DataFrame, now: Column, *, limit: int = 100) -> DataFrame:
    """Pending and failed commands whose time has come or that have none, oldest first; the limit is the size of one relay pass."""
    open_ = F.col("status").isin("PENDING", "FAILED") & (F.col("next_attempt").isNull() | (F.col("next_attempt") <= now))
    return commands.where(open_).orderBy("created_at", "command_id").limit(limit)


def claim_commands(commands: DataFrame, worker: str, now: Column, *, limit: int = 100, lease_seconds: int = 60) -> DataFrame:
    """All commands after ``worker`` has taken its share: leases that have run out are released first, and what is due then is SENDING, held by
    the worker until the lease ends, with an attempt more. The share is at most ``limit`` rows, so it is broadcast."""
    released = release_expired(commands, now)
    taken = due(released, now, limit=limit).select(*KEY, F.lit(True).alias("__taken"))
    out = released.join(F.broadcast(taken), KEY, "left")
    mine = F.coalesce("__taken", F.lit(False))
    return out.withColumns({
        "status": F.when(mine, "SENDING").otherwise(F.col("status")), "attempt": (F.col("attempt") + mine.cast("int")).cast("int"), "lease_owner": F.when(mine, worker).otherwise(F.col("lease_owner")),
        "lease_until": F.when(mine, now + F.make_dt_interval(secs=F.lit(lease_seconds))).otherwise(F.col("lease_until")),
    }).drop("__taken").select(*commands.columns)


def held(commands: DataFrame, worker: str) -> DataFrame:
    """What a worker holds and has to publish."""
    return commands.where((F.col("status") == "SENDING") & (F.col("lease_owner") == worker))


def judged(commands: DataFrame, results: DataFrame, *, most: int = 10) -> DataFrame:
    """Results (tenant_id, command_id, worker, ok, error, at) with outcome: published, failed, dead, or lost.

    A result is lost unless its worker holds the command's lease; so the first result by ``at`` counts and later ones of the batch are lost, as
    are late results of a lease that another worker has taken over.
    """
    now = commands.select(*KEY, "status", "lease_owner", "attempt")
    out = first_of_each(results, KEY, ["at", "ok"]).join(now, KEY, "left")
    mine = F.coalesce((F.col("nth") == 1) & (F.col("status") == "SENDING") & (F.col("lease_owner") == F.col("worker")), F.lit(False))
    outcome = F.when(~mine, "lost").when(F.col("ok"), "published").when(F.col("attempt") >= most, "dead").otherwise("failed")
    return out.withColumn("outcome", outcome).select(*results.columns, "outcome")


def settle_commands(commands: DataFrame, results: DataFrame, now: Column, *, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(commands after the results, results with outcomes as in ``judged``).

    Published commands are final. Failed ones wait 2 to the power of their attempts in seconds, 300 at most, or are DEAD after ``most`` attempts. Both
    give up the lease. A batch may hold results of several workers, of which a lost lease's change nothing.
    """
    outcomes = judged(commands, results, most=most)
    done = outcomes.where("outcome != 'lost'").select(*KEY, F.col("outcome").alias("__outcome"), F.col("error").alias("__error"))
    out = commands.join(done, KEY, "left")
    settled, bad = F.col("__outcome").isNotNull(), F.col("__outcome").isin("failed", "dead")
    wait = F.least(F.lit(300), F.pow(F.lit(2), F.least(F.col("attempt"), F.lit(8))).cast("int"))
    free = {c: F.when(settled, F.lit(None).cast(kind)).otherwise(F.col(c)) for c, kind in _LEASE}
    return out.withColumns({
        "status": F.when(settled, F.upper("__outcome")).otherwise(F.col("status")), **free, "published_at": F.when(F.col("__outcome") == "published", now).otherwise(F.col("published_at")),
        "next_attempt": F.when(bad, now + F.make_dt_interval(secs=wait)).otherwise(F.col("next_attempt")), "last_error": F.when(bad, F.substring("__error", 1, 512)).otherwise(F.col("last_error")),
    }).select(*commands.columns), outcomes


def relay(commands: DataFrame, suggestions: DataFrame, results: DataFrame, now: Column, *, most: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commands, suggestions, outcomes) after results of publishing: publishing a command and dispatching its suggestion are one step.

    A command that went out counts as published only if its suggestion can be dispatched, that is, if it is APPROVED; else the
    command has failed and is tried again.
    """
    first = judged(commands, results, most=most)
    wanted = first.where("outcome = 'published'").join(commands.select(*KEY, "suggestion_id"), KEY)
    requests = wanted.select(*KEY, "suggestion_id", F.lit("DISPATCH").alias("action"), F.lit(None).cast("long").alias("expected_version"), F.col("command_id").alias("at"))
    handled = transition(suggestions, requests, REMEDIATION_STEPS, key="suggestion_id", order=["at"])
    barred = handled.where("outcome != 'accepted'").select(*KEY, F.concat(F.lit("the suggestion can't be dispatched: "), "outcome").alias("__barred"))
    checked = results.join(barred, KEY, "left").withColumns({"ok": F.col("ok") & F.col("__barred").isNull(), "error": F.coalesce("__barred", "error")}).select(*results.columns)
    after, outcomes = settle_commands(commands, checked, now, most=most)
    return after, advanced(suggestions, handled, key="suggestion_id"), outcomes
