"""Operators on stateful ledgers: each takes the current state and a batch of requests, and gives the next state, audit and outcomes.

A request may name the version it expects; of several requests for one key in a batch the first is handled and the others are
conflicts, so a batch has one writer for each key. Nothing locks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import name_uuid
from ..sources.sinks import absent_only

# Allowed actions by status, and the status each leads to. OPEN means that there is no disposition.
TARGETS = {"RESOLVE": "RESOLVED", "CLOSE": "CLOSED", "SUPPRESS": "SUPPRESSED", "REOPEN": "REOPENED"}
ALLOWED = {"OPEN": ["RESOLVE", "CLOSE", "SUPPRESS"], "RESOLVED": ["CLOSE", "REOPEN"], "CLOSED": ["REOPEN"], "SUPPRESSED": ["CLOSE", "REOPEN"], "REOPENED": ["RESOLVE", "CLOSE", "SUPPRESS"], "STALE": ["RESOLVE", "CLOSE", "SUPPRESS"]}
REMEDIATION_STEPS = [("PROPOSED", "APPROVE", "APPROVED"), ("PROPOSED", "REJECT", "REJECTED"), ("APPROVED", "DISPATCH", "DISPATCHING"), *[(s, t, t) for s in ("DISPATCHING", "UNKNOWN") for t in ("SUCCEEDED", "FAILED", "UNKNOWN")]]


def first_of_each(requests: DataFrame, key: list[str], order: list) -> DataFrame:
    """Requests with ``nth``: 1 for the first of its key in the batch."""
    return requests.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def latest(log: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """The newest row of each key in an append-only log."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))
    return log.withColumn("__n", newest).where("__n = 1").drop("__n")


def transition(state: DataFrame, requests: DataFrame, steps: list[tuple[str, str, str]], *, key: str, order: list) -> DataFrame:
    """Requests (key, action, expected_version) with the state's status and version, the target and the outcome.

    ``steps`` are (from, action, to). Outcomes: not_found, conflict (version differs or a later request of the key), noop (already
    there), illegal, accepted.
    """
    spark = state.sparkSession
    table = F.broadcast(spark.createDataFrame(steps, "status string, action string, target string"))
    goals = F.broadcast(spark.createDataFrame(sorted({(a, t) for _, a, t in steps}), "action string, goal string"))
    now = state.select(key, "status", "version")
    out = first_of_each(requests, [key], order).join(now, key, "left").join(goals, "action", "left").join(table, ["status", "action"], "left")
    outcome = (
        F.when(F.col("status").isNull(), "not_found").when((F.col("nth") > 1) | F.coalesce(F.col("expected_version") != F.col("version"), F.col("expected_version").isNotNull()), "conflict")
        .when(F.col("goal") == F.col("status"), "noop").when(F.col("target").isNull(), "illegal").otherwise("accepted")
    )
    return out.withColumn("outcome", outcome)


def advanced(state: DataFrame, handled: DataFrame, *, key: str) -> DataFrame:
    """The state after the accepted requests: new status, and a version more by one."""
    done = handled.where("outcome = 'accepted'").select(key, F.col("target").alias("__to"))
    out = state.join(done, key, "left")
    return out.withColumns({"status": F.coalesce("__to", "status"), "version": F.col("version") + F.col("__to").isNotNull().cast("int")}).drop("__to")


# Runs.

def plan_runs(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Launch requests (request_id, scenario, period, buckets) with their run: window, cutoff, sequence and id, or a reason against it.

    Sequences go on from the highest of the scenario and period, without gaps. The window runs from the UTC day's start to the next
    day's last second, the cutoff is at 23:00 UTC; buckets are 64 unless given, 1 to 4096.
    """
    day = F.try_to_timestamp("period", F.lit("yyyy-MM-dd")).cast("date")
    buckets = F.coalesce("buckets", F.lit(64))
    reason = (
        F.when(F.coalesce(F.length(F.trim("scenario")), F.lit(0)) == 0, "scenario is required").when(F.length("scenario") > 32, "scenario is longer than 32")
        .when(~F.coalesce(F.col("period").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) | day.isNull(), "period is not a date").when((buckets < 1) | (buckets > 4096), "buckets must be 1 to 4096")
    )
    marked = requests.withColumns({"reason": reason, "buckets": buckets, "day": day})
    top = runs.groupBy("scenario", "period").agg(F.max("sequence_no").alias("top"))
    number = F.row_number().over(Window.partitionBy("scenario", "period", F.col("reason").isNull()).orderBy("request_id"))
    out = marked.join(top, ["scenario", "period"], "left").withColumn("sequence_no", F.when(F.col("reason").isNull(), F.coalesce("top", F.lit(0)) + number))
    # Days are UTC days, whatever the session's time zone is.
    start = F.timestamp_seconds(F.unix_date("day").cast("long") * 86400)
    run_id = F.concat_ws(":", "scenario", "period", F.col("sequence_no").cast("string"))
    out = out.withColumns({
        "run_id": F.when(F.col("reason").isNull(), run_id), "window_start": start, "window_end": start + F.expr("interval 47 hours 59 minutes 59 seconds"), "cutoff": start + F.expr("interval 23 hours"),
    })
    out = out.withColumn("reason", F.coalesce("reason", F.when(F.length("run_id") > 64, F.lit("run id is longer than 64"))))
    return out.select("request_id", "scenario", "period", "buckets", "sequence_no", "run_id", "window_start", "window_end", "cutoff", "reason")


def finished(runs: DataFrame, report: DataFrame) -> DataFrame:
    """Runs with their final status: COMPLETED if every report row is balanced, or there is none, else REPORT_IMBALANCE."""
    ok = report.groupBy("run_id").agg(F.bool_and("balanced").alias("__ok"))
    return runs.join(ok, "run_id", "left").withColumn("status", F.when(F.coalesce("__ok", F.lit(True)), "COMPLETED").otherwise("REPORT_IMBALANCE")).drop("__ok")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run with the highest sequence of each scenario and period."""
    return latest(runs, ["scenario", "period"], "sequence_no")


# Dispositions.

def apply_dispositions(dispositions: DataFrame, requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests (fingerprint, action, operator, note, expected_version, at) with outcome, target, next version and audit key.

    ``known`` has the fingerprints that exist. A discrepancy without a disposition is OPEN and has no version, so a request that expects one
    is a conflict; negative versions are invalid. Its first disposition has version 0, later ones one more. Reaching the status that is there already is a no-op without audit.
    """
    steps = [(s, a, TARGETS[a]) for s, actions in ALLOWED.items() for a in actions]
    state = known.select("fingerprint").distinct().join(dispositions.select("fingerprint", "status", "version"), "fingerprint", "left")
    state = state.select("fingerprint", F.coalesce("status", F.lit("OPEN")).alias("status"), F.col("version").cast("long").alias("version"))
    out = transition(state, requests, steps, key="fingerprint", order=["at", "action"])
    bad = (F.coalesce(F.length(F.trim("operator")), F.lit(0)) == 0) | (F.length("operator") > 64) | (F.length("note") > 512) | ~F.col("action").isin(list(TARGETS)) | (F.col("expected_version") < 0)
    out = out.withColumn("outcome", F.when(F.coalesce(bad, F.lit(True)) & F.col("operator").isNull() | F.coalesce(bad, F.lit(False)), "invalid").otherwise(F.col("outcome")))
    version = F.when(F.col("outcome") == "accepted", F.coalesce(F.col("version") + 1, F.lit(0)))
    return out.withColumns({"new_version": version, "audit_key": F.when(version.isNotNull(), F.concat_ws(":", F.lit("manual"), "action", "fingerprint", version.cast("string")))})


def converge_dispositions(dispositions: DataFrame, run_fingerprints: DataFrame, run_id: str, runs: DataFrame | None = None) -> DataFrame:
    """Dispositions after a run, with the audit of those that changed their status.

    Live ones whose discrepancy is there again are seen by this run; the others become STALE with a version more and an audit
    key that holds the version before. With ``runs`` (run_id, scenario, period, sequence_no) this holds for the dispositions of
    the run's scenario and period only, and for none if a later run of these exists.
    """
    here = run_fingerprints.select("fingerprint").distinct().withColumn("__here", F.lit(True))
    out = dispositions.join(here, "fingerprint", "left")
    live, gone = F.col("status") != "STALE", F.col("__here").isNull()
    if runs is not None:
        newest = latest_runs(runs).where(F.col("run_id") == run_id).select("scenario", "period", F.lit(True).alias("__latest"))
        out = out.join(F.broadcast(newest), ["scenario", "period"], "left")  # one row, or none
        live = live & F.coalesce("__latest", F.lit(False))
    scope = [c for c in ("scenario", "period") if c in dispositions.columns]
    return out.select(
        "fingerprint", *scope, F.when(live & gone, "STALE").otherwise(F.col("status")).alias("status"), (F.col("version") + (live & gone).cast("int")).alias("version"),
        F.when(live & ~gone, F.lit(run_id)).otherwise(F.col("last_seen_run")).alias("last_seen_run"),
        F.when(live & gone, F.concat_ws(":", F.lit("stale"), "fingerprint", F.col("version").cast("string"))).alias("audit_key"),
        F.when(live & gone, F.concat(F.lit("priorStatus="), "status", F.lit(f",runId={run_id}"))).alias("audit_payload"),
    )


def run_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fingerprints of two runs: relinked (in both), vanished or new."""
    a = before.select("fingerprint").distinct().withColumn("a", F.lit(1))
    b = after.select("fingerprint").distinct().withColumn("b", F.lit(1))
    return a.join(b, "fingerprint", "full_outer").select("fingerprint", F.when(F.col("b").isNull(), "vanished").when(F.col("a").isNull(), "new").otherwise("relinked").alias("change"))


# Handlers: each turns discrepancies into rows with an idempotency key, so a second pass adds nothing.

def ledger_audit(d: DataFrame) -> DataFrame:
    return d.select(F.concat(F.lit("ledger:"), "fingerprint").alias("idempotency_key"), "run_id", "fingerprint", F.lit("LEDGER").alias("action"), F.concat(F.lit("type="), "type", F.lit(",delta="), F.col("delta").cast("string")).alias("payload"))


def reversal_suggestions(d: DataFrame) -> DataFrame:
    """A reversal of the difference for amount and group-sum mismatches that have a currency."""
    rows = d.where(F.col("type").isin("AMOUNT_MISMATCH", "GROUP_SUM_MISMATCH") & F.col("currency").isNotNull() & (F.col("delta") != 0))
    return rows.select(F.concat(F.lit("reversal-suggestion:"), "fingerprint").alias("idempotency_key"), "run_id", "fingerprint", "currency", F.col("delta").alias("amount_minor"), F.lit("SUGGESTED").alias("status"), F.lit(0).cast("long").alias("version"))


def alert_outbox(d: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct("fingerprint", "type", "segment_id", "currency", "delta"))
    return d.select(F.concat(F.lit("alert:"), "fingerprint").alias("idempotency_key"), "run_id", "fingerprint", payload.alias("payload"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempt"))


HANDLERS: list[tuple[str, Callable[[DataFrame], DataFrame]]] = [("ledger", ledger_audit), ("reversal", reversal_suggestions), ("alert", alert_outbox)]


def handle(d: DataFrame, existing: dict[str, DataFrame] | None = None, handlers=None) -> dict[str, DataFrame]:
    """New rows of each handler in order, without those whose keys exist."""
    out = {}
    for name, handler in handlers or HANDLERS:
        rows = handler(d)
        out[name] = absent_only(rows, existing[name], "idempotency_key") if existing and name in existing else rows.dropDuplicates(["idempotency_key"])
    return out


# Alerts, reversals and commands.

def alerts_due(alerts: DataFrame, *, most: int = 5) -> DataFrame:
    return alerts.where((F.col("status") == "PENDING") | ((F.col("status") == "FAILED") & (F.col("attempt") < most))).orderBy("created_at", "idempotency_key")


def alerts_after(alerts: DataFrame, results: DataFrame) -> DataFrame:
    """Results (idempotency_key, ok): sent is final; a failure counts an attempt and never takes a sent alert back.

    Several results of one alert in a batch count together: one that went through makes it sent, and each failure is an attempt.
    """
    r = results.groupBy("idempotency_key").agg(F.bool_or("ok").alias("__ok"), F.count_if(~F.col("ok")).alias("__failed"))
    open_ = F.col("__ok").isNotNull() & (F.col("status") != "SENT")
    out = alerts.join(r, "idempotency_key", "left").withColumn("attempt", F.when(open_, F.col("attempt") + F.col("__failed")).otherwise(F.col("attempt")).cast("int"))
    return out.withColumn("status", F.when(open_ & F.col("__ok"), "SENT").when(open_, "FAILED").otherwise(F.col("status"))).drop("__ok", "__failed")


def deliver(rows: DataFrame, send: Callable, path: str, *, key: str = "idempotency_key") -> DataFrame:
    """Call ``send(row)`` for every row, on the executors, and give the results (key, ok, error), which ``alerts_after`` takes.

    A row counts as delivered if ``send`` returns; what it raises is the error, cut to 512 characters. Results are written to ``path`` once and read back, as each
    evaluation would send again; a task that is repeated sends its rows again, so receivers go by the key.
    """

    def each(batches):
        import pandas as pd

        for frame in batches:
            found = []
            for row in frame.itertuples(index=False):
                try:
                    send(row._asdict())
                    found.append((getattr(row, key), True, None))
                except Exception as e:  # noqa: BLE001  whatever a receiver does is a result
                    found.append((getattr(row, key), False, str(e)[:512]))
            yield pd.DataFrame(found, columns=[key, "ok", "error"])

    schema = f"{key} string, ok boolean, error string"
    rows.mapInPandas(each, schema).write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def decide_reversals(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (idempotency_key, approved, note): suggested ones become CONFIRMED or DISCARDED; a missing note keeps the old one."""
    d = decisions.select("idempotency_key", F.col("approved").alias("__yes"), F.col("note").alias("__note")).dropDuplicates(["idempotency_key"])
    out = suggestions.join(d, "idempotency_key", "left")
    decided = F.col("__yes").isNotNull() & (F.col("status") == "SUGGESTED")
    out = out.withColumns({"note": F.when(decided, F.coalesce("__note", "note")).otherwise(F.col("note")), "version": F.col("version") + F.coalesce(decided, F.lit(False)).cast("int")})
    return out.withColumn("status", F.when(decided & F.col("__yes"), "CONFIRMED").when(decided, "DISCARDED").otherwise(F.col("status"))).drop("__yes", "__note")


def settle_reversals(suggestions: DataFrame, results: DataFrame) -> DataFrame:
    """Execution results (idempotency_key, ok) move CONFIRMED ones only; EXECUTED stays."""
    r = results.groupBy("idempotency_key").agg(F.bool_or("ok").alias("__ok"))
    moved = F.col("__ok").isNotNull() & (F.col("status") == "CONFIRMED")
    out = suggestions.join(r, "idempotency_key", "left")
    return out.withColumns({"status": F.when(moved & F.col("__ok"), "EXECUTED").when(moved, "EXECUTION_FAILED").otherwise(F.col("status")), "version": F.col("version") + F.coalesce(moved, F.lit(False)).cast("int")}).drop("__ok")


def reversal_audit(suggestions: DataFrame, results: DataFrame, operator: str = "system") -> DataFrame:
    """An action row for each execution of a CONFIRMED suggestion, failed ones included. Results are (idempotency_key, ok, reference)."""
    r = results.groupBy("idempotency_key").agg(F.bool_or("ok").alias("__ok"), F.max("reference").alias("__ref"))
    done = suggestions.where("status = 'CONFIRMED'").join(r, "idempotency_key")
    key = F.concat(F.when(F.col("__ok"), "reversal-exec-ok:").otherwise("reversal-exec-fail:"), "idempotency_key")
    payload = F.concat(F.when(F.col("__ok"), "executed ref=").otherwise("execution failed: "), F.coalesce("__ref", F.lit("")))
    return done.select(key.alias("idempotency_key"), "fingerprint", F.lit("REVERSAL_EXECUTED").alias("action"), F.lit(operator).alias("operator"), payload.alias("payload"))


def propose_remediations(proposals: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposals (tenant_id, scenario, discrepancy_ref, award_item_no, original_operation_no, action, reason) with id and outcome.

    One proposal for each tenant, discrepancy and action; all but MANUAL_REVIEW need the original operation.
    """
    blank = lambda c: F.coalesce(F.length(F.trim(F.col(c))), F.lit(0)) == 0
    name = F.concat_ws("|", "tenant_id", "discrepancy_ref", "action")
    marked = first_of_each(proposals.withColumn("suggestion_id", name_uuid(name)), ["suggestion_id"], ["reason"])
    out = marked.join(existing.select("suggestion_id", F.lit(True).alias("__there")), "suggestion_id", "left")
    invalid = blank("tenant_id") | blank("scenario") | blank("discrepancy_ref") | blank("award_item_no") | blank("reason") | blank("action") | ((F.col("action") != "MANUAL_REVIEW") & blank("original_operation_no"))
    outcome = F.when(invalid, "invalid").when(F.col("__there") | (F.col("nth") > 1), "duplicate").otherwise("accepted")
    return out.withColumn("outcome", outcome).drop("__there", "nth").withColumns({"status": F.lit("PROPOSED"), "version": F.lit(0).cast("long")})


def step_remediations(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (suggestion_id, action, expected_version, at, approval_ref) against the lifecycle.

    Approving needs a reference to the approval, else the request is invalid; manual reviews can't be approved. A batch without the column
    approval_ref approves nothing.
    """
    if "approval_ref" not in requests.columns:
        requests = requests.withColumn("approval_ref", F.lit(None).cast("string"))
    unfounded = (F.col("action") == "APPROVE") & (F.coalesce(F.length(F.trim("approval_ref")), F.lit(0)) == 0)
    invalid = requests.where(F.coalesce(unfounded, F.lit(False)))
    handled = transition(state, requests.where(~F.coalesce(unfounded, F.lit(False))), REMEDIATION_STEPS, key="suggestion_id", order=["at", "action"])
    manual = state.select("suggestion_id", (F.col("action") == "MANUAL_REVIEW").alias("__manual"))
    out = handled.join(manual, "suggestion_id", "left")
    barred = F.col("__manual") & (F.col("action") == "APPROVE") & (F.col("outcome") == "accepted")
    out = out.withColumn("outcome", F.when(barred, "illegal").otherwise(F.col("outcome"))).drop("__manual")
    return out.unionByName(invalid.withColumn("outcome", F.lit("invalid")), allowMissingColumns=True)


def settle_remediations(state: DataFrame, commands: DataFrame, results: DataFrame) -> DataFrame:
    """Result events (tenant_id, event_id, command_id, action) as requests against the lifecycle, with outcomes.

    A command belongs to its tenant; an unknown one is not found.
    """
    named = results.join(commands.select("tenant_id", "command_id", "suggestion_id"), ["tenant_id", "command_id"], "left")
    requests = named.select("tenant_id", "event_id", "command_id", "suggestion_id", "action", F.lit(None).cast("long").alias("expected_version"), F.col("event_id").alias("at"))
    return step_remediations(state, requests)


def remediation_commands(approved: DataFrame, now: Column) -> DataFrame:
    """The command of each approved suggestion, due at once, with the hash of its envelope. ``approved`` has the approval's reference as approval_ref."""
    command = F.concat(F.lit("recon-remediation:"), "suggestion_id")
    instant = F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.struct(command.alias("externalCommandId"), "action", F.col("award_item_no").alias("awardItemNo"), F.col("original_operation_no").alias("originalOperationNo"), "reason", F.col("approval_ref").alias("approvalRef"))
    envelope = F.to_json(F.struct(
        command.alias("eventId"), F.lit("REMEDIATION_COMMAND").alias("eventType"), F.lit("1.0").alias("schemaVersion"), F.col("tenant_id").alias("tenantId"), instant.alias("occurredAt"), F.col("suggestion_id").alias("traceId"),
        F.col("award_item_no").alias("partitionKey"), payload.alias("payload"),
    ))
    none = lambda kind: F.lit(None).cast(kind)
    return approved.select(
        "tenant_id", command.alias("command_id"), "suggestion_id", envelope.alias("payload"), F.sha2(envelope, 256).alias("payload_hash"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempt"),
        none("timestamp").alias("next_attempt"), none("string").alias("lease_owner"), none("timestamp").alias("lease_until"), none("timestamp").alias("published_at"), none("string").alias("last_error"), now.alias("created_at"),
    )
