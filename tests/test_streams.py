"""Streams: keyed groups with timers, landing without loss, repair of late rows, and the inbox as state."""

import hashlib
import json
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgermatch.operators.classify import Roles, Rule
from ledgermatch.operators.match import match_groups
from ledgermatch.streaming import batches, events as ev, keyed, reconcile, slots

T0 = datetime(2026, 8, 17)
SCHEMA = "run_id string, segment_id string, side string, match_key string, group_key string, currency string, signed_amount_minor long, base_amount_minor long, entry_type string, biz_status string, biz_time timestamp, posting_time timestamp, raw_ref string, record_id string"
ROLES = {"S": Roles("MARKETING", "CHANNEL")}


def rec(side, key, amount, minute=0, ccy="USD", ref=None, base=None, status="PAID"):
    rec.n = getattr(rec, "n", 0) + 1
    at = None if minute is None else T0 + timedelta(minutes=minute)
    ref = ref or f"{side}{rec.n}"
    return ("r", "S", side, key, key or "g", ccy, amount, base, "ISSUE", status, at, at, ref, ref)


class Feed:
    """Files that a stream reads; ``go`` runs what is available through a new query on the old checkpoint, which is a restart."""

    def __init__(self, spark, root, go):
        self.spark, self.root, self.each = spark, f"file://{root}", go
        self.records = []

    def __call__(self, *rows):
        self.records += rows
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        self.each(self.spark.readStream.schema(SCHEMA).parquet(f"{self.root}/in"))


@pytest.fixture()
def groups(spark, tmp_path):
    keyed.use_rocksdb(spark)
    root = f"file://{tmp_path}"

    def go(source):
        out = keyed.keyed_groups(source, watermark="10 minutes", patience_seconds=3600)
        batches.run_batches(out, lambda df, i: batches.write_batch(df, f"{root}/out", i), f"{root}/check").awaitTermination()

    feed = Feed(spark, tmp_path, go)
    feed.out = lambda: sorted((r["match_key"] or r["null_ref"], r["revision"], r["cause"], r["left_sum"], r["right_sum"]) for r in spark.read.parquet(f"{root}/out").collect())
    return feed


def test_balanced_groups_come_at_once_and_others_at_their_timer(spark, groups):
    groups(rec("LEFT", "a", 10), rec("LEFT", "b", 10), rec("RIGHT", "b", 9), rec("LEFT", None, 5, ref="x"), rec("LEFT", None, 5, ref="y"))
    assert groups.out() == []
    groups(rec("RIGHT", "a", 10, 5))
    assert groups.out() == [("a", 1, "balanced", 10, 10)]
    groups(rec("RIGHT", "b", 1, 20))  # balances after a restart
    assert groups.out() == [("a", 1, "balanced", 10, 10), ("b", 1, "balanced", 10, 10)]
    groups(rec("LEFT", "b", 3, 21), rec("RIGHT", "c", 7, 30))  # b is no longer balanced, which its timer tells
    groups(rec("LEFT", "end", 1, 1000))
    assert groups.out() == [("LEFT:x", 1, "timer", 5, 0), ("LEFT:y", 1, "timer", 5, 0), ("a", 1, "balanced", 10, 10), ("b", 1, "balanced", 10, 10), ("b", 2, "timer", 13, 10), ("c", 1, "timer", 0, 7)]
    last = keyed.latest_groups(spark.read.parquet(f"{groups.root}/out"))
    names = ["match_key", "null_ref", "left_count", "right_count", "left_sum", "right_sum", "left_currency", "left_ref", "left_status", "left_posted", "left_base", "left_copies", "right_copies", "presence", "mixed"]
    batch = match_groups(spark.createDataFrame([r for r in groups.records if r[3] != "end"], SCHEMA), on_mixed="mark")
    assert sorted(map(tuple, last.select(*names).collect()), key=repr) == sorted(map(tuple, batch.select(*names).collect()), key=repr)


def test_state_of_copies_currencies_and_bases(spark, groups):
    groups(rec("LEFT", "a", 5, base=50), rec("LEFT", "a", 5, base=50), rec("LEFT", "b", 5), rec("LEFT", "b", 6), rec("LEFT", "m", 5, base=1), rec("LEFT", "m", 5, ccy="EUR"))
    groups(rec("LEFT", "b", 6, 1, status="A"), rec("RIGHT", "a", 10, 2, base=7), rec("RIGHT", "a", 1, 2), rec("RIGHT", "m", 10, 2))
    groups(rec("LEFT", "end", 1, 1000))
    last = keyed.latest_groups(spark.read.parquet(f"{groups.root}/out"))
    names = ["match_key", "left_count", "left_sum", "left_currency", "left_ref", "left_status", "left_base", "right_base", "left_copies", "right_copies", "mixed"]
    batch = match_groups(spark.createDataFrame([r for r in groups.records if r[3] != "end"], SCHEMA), on_mixed="mark")
    got = {r["match_key"]: tuple(r) for r in last.select(*names).collect()}
    assert got == {r["match_key"]: tuple(r) for r in batch.select(*names).collect()}
    assert got["a"][8] and got["b"][8] and not got["m"][8] and got["m"][10]


def test_a_key_begins_anew_after_its_timer(spark, groups):
    groups(rec("LEFT", "a", 10))
    groups(rec("LEFT", "end", 1, 200))
    groups(rec("RIGHT", "a", 10, 210))
    groups(rec("LEFT", "end", 1, 900))
    assert [x for x in groups.out() if x[0] == "a"] == [("a", 1, "timer", 0, 10), ("a", 1, "timer", 10, 0)]
    assert keyed.latest_groups(spark.read.parquet(f"{groups.root}/out")).where("match_key = 'a'").count() == 2


@pytest.fixture()
def landing(spark, tmp_path):
    root = f"file://{tmp_path}"
    rest = {"scenario": "C", "period": "P"}

    def go(source):
        reconcile.land(source, f"{root}/t", f"{root}/check-land").awaitTermination()
        reconcile.reconcile_landed(spark, f"{root}/t", SCHEMA, ROLES, Rule(), checkpoint=f"{root}/check", watermark="10 minutes", size="1 hour", **rest).awaitTermination()

    feed = Feed(spark, tmp_path, go)
    feed.table = f"{root}/t"
    feed.groups = lambda: sorted((r["match_key"], r["left_count"], r["right_count"], r["type"] or "CLEAN", r["revision"]) for r in reconcile.current_groups(spark, feed.table).collect())
    feed.rejects = lambda: sorted((r["raw_ref"], r["reason"]) for r in reconcile.all_rejects(spark, feed.table).collect())
    feed.repair = lambda name: reconcile.repair(spark, feed.table, SCHEMA, ROLES, Rule(), name=name, watermark="10 minutes", size="1 hour", **rest)
    return feed


MIXED = "several currencies on one side of its group"


def test_rows_in_are_rows_out_or_rejects(spark, landing):
    landing(rec("LEFT", "a", 10), rec("RIGHT", "a", 10), rec("LEFT", "n", 10, None, ref="n1"), rec("LEFT", "m", 1, ref="m1"), rec("LEFT", "m", 1, ccy="EUR", ref="m2"), rec("RIGHT", "m", 1, ref="m3"))
    landing(rec("LEFT", "end", 1, 600))
    landing(rec("RIGHT", "n", 10, None, ref="n2"))
    assert landing.groups() == [("a", 1, 1, "CLEAN", 0)]
    assert landing.rejects() == [("m1", MIXED), ("m2", MIXED), ("m3", MIXED), ("n1", "no event time"), ("n2", "no event time")]
    # A batch that is done again changes nothing.
    before = landing.rejects()
    again = spark.createDataFrame([rec("LEFT", "x", 1)], SCHEMA)
    for table in ("raw", "rejects-untimed"):
        batches.write_batch(again, f"{landing.table}/{table}", 0)
    assert landing.rejects() == before and reconcile.landed(spark, landing.table, SCHEMA).where("match_key = 'x'").count() == 0


def test_late_rows_are_repaired(spark, landing):
    landing(rec("LEFT", "a", 10), rec("LEFT", "b", 10), rec("RIGHT", "b", 10), rec("LEFT", "c", 1), rec("LEFT", "d", 1, ref="d1"))
    landing(rec("LEFT", "end", 1, 600))
    assert landing.groups() == [("a", 1, 0, "MISSING", 0), ("b", 1, 1, "CLEAN", 0), ("c", 1, 0, "MISSING", 0), ("d", 1, 0, "MISSING", 0)]
    landing(rec("RIGHT", "a", 10, 1), rec("RIGHT", "z", 5, 2), rec("LEFT", "d", 1, 3, ccy="EUR", ref="d2"))
    assert [g[0] for g in landing.groups()] == ["a", "b", "c", "d"]  # the windows had closed
    fixed = landing.repair("one")
    assert sorted((r["match_key"], r["type"], r["revision"]) for r in fixed.collect()) == [("a", None, 1), ("z", "EXTRA", 0)]
    assert landing.groups() == [("a", 1, 1, "CLEAN", 1), ("b", 1, 1, "CLEAN", 0), ("c", 1, 0, "MISSING", 0), ("d", 1, 0, "MISSING", 0), ("z", 0, 1, "EXTRA", 0)]
    assert landing.rejects() == [("d1", MIXED), ("d2", MIXED)]
    landing(rec("RIGHT", "a", 1, 4))
    landing.repair("two")
    assert [g for g in landing.groups() if g[0] == "a"] == [("a", 1, 2, "GROUP_SUM_MISMATCH", 2)]
    landing.repair("two")
    assert [g for g in landing.groups() if g[0] == "a"] == [("a", 1, 2, "GROUP_SUM_MISMATCH", 2)]


def envelope(event_id="e1", fact="EXPECTED", **payload):
    body = {"factType": fact, "benefitType": "GOODS", "awardItemNo": "A", "awardOrderNo": "O", "skuId": "s", "quantity": 1, "status": "PENDING"} | payload
    return json.dumps({"eventId": event_id, "eventType": "FULFILLMENT_" + fact, "schemaVersion": "1", "tenantId": "T", "occurredAt": "2026-08-17T00:00:00Z", "payload": body})


def stored(spark, root):
    facts = sorted((r["event_id"], r["target"], r["quantity"], r["occurred_at"]) for r in spark.read.parquet(f"{root}/facts").collect())
    return facts, sorted(r["reason"] for r in spark.read.parquet(f"{root}/rejects").collect())


def test_replays_by_hand(spark, tmp_path):
    root = f"file://{tmp_path}/ods"
    batch = lambda *texts: spark.createDataFrame([(t,) for t in texts], "value string")
    for _ in range(2):  # the second time each batch is there already
        ev.ingest_batch(batch(envelope(), envelope(), "{"), root, batch_id="one")
        ev.ingest_batch(batch(envelope(), envelope(quantity=2), envelope("e2", currency="USD"), envelope("e3", "PROVIDER", status="SUCCEEDED")), root, batch_id="two")
    facts, reasons = stored(spark, root)
    assert facts == [("e1", "ENTITLEMENT_EXPECTED", 1, T0), ("e3", "ENTITLEMENT_PROVIDER", 1, T0)]
    assert reasons == ["an entitlement event has currency or amount", "conflicting content", "not an event"]
    assert [f["status"] for f in ev.facts(spark, root, "ENTITLEMENT_PROVIDER").collect()] == ["ISSUED"]


def test_the_inbox_is_state(spark, tmp_path):
    root, texts = f"file://{tmp_path}/ods", tmp_path / "in"
    texts.mkdir()
    source = spark.readStream.schema("value string").text(f"file://{texts}")
    old = spark.createDataFrame([("T", "old", "hash of old content")], "tenant_id string, event_id string, hash string")
    batch = [[envelope(), envelope(), "{"], [envelope(), envelope(quantity=2), envelope("old"), envelope("e2", currency="USD")], [envelope("e3", "PROVIDER", status="SUCCEEDED"), envelope("e3", "PROVIDER", status="SUCCEEDED"), envelope(quantity=3)]]
    held, read = [], []
    for i, lines in enumerate(batch):
        (texts / f"{i}.txt").write_text("\n".join(lines) + "\n")
        q = ev.ingest_stream(source, root, f"file://{tmp_path}/check", inbox=old)
        q.awaitTermination()
        progress = [p for p in q.recentProgress if p["numInputRows"]]
        read.append(sum(p["numInputRows"] for p in progress))
        held.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
    facts, reasons = stored(spark, root)
    assert facts == [("e1", "ENTITLEMENT_EXPECTED", 1, T0), ("e3", "ENTITLEMENT_PROVIDER", 1, T0)]
    assert reasons == ["an entitlement event has currency or amount"] + ["conflicting content"] * 3 + ["not an event"]
    # State grows by what is claimed; a batch reads its own lines, once for each branch of its plan.
    assert held == [2, 2, 3] and read == [2 * len(b) for b in batch]


def test_the_inbox_is_asked_by_slot(spark, tmp_path):
    """300 events are kept in at most as many values as there are slots; replays, conflicts, numbers past 2**53 and nulls come out as one by one."""
    keyed.use_rocksdb(spark)
    big = 2**60
    cash = {"benefitType": "CASH", "skuId": None, "quantity": None, "currency": "EUR", "entryType": "ISSUE", "providerReference": "p", "status": "SUCCEEDED"}
    first = [envelope(f"e{i}", quantity=big + i) if i % 3 else envelope(f"e{i}", "PROVIDER", amountMinor=big + i, **cash) for i in range(300)]
    parts = [[*first, first[0], first[1], first[1], envelope("e1", quantity=1), envelope("e1", quantity=2)], [first[2], envelope("e2", quantity=5), envelope("e300"), "{"]]
    held, rows = [], []

    def keep(df, i):
        rows.extend(df.collect())

    for i, lines in enumerate(parts):
        spark.createDataFrame([(t,) for t in lines], "value string").coalesce(1).write.mode("append").text(f"file://{tmp_path}/in")
        q = batches.run_batches(ev.claimed_stream(spark.readStream.schema("value string").text(f"file://{tmp_path}/in"), slots=16), keep, f"file://{tmp_path}/check")
        q.awaitTermination()
        held.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]))
    assert max(held) <= 16
    count = {o: sum(r["outcome"] == o for r in rows) for o in ("claimed", "replay", "conflict", None)}
    assert count["claimed"] == 301 and count[None] == 1 and count["replay"] + count["conflict"] == 7
    won = min((t for t in parts[0] if '"e1"' in t), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    mine = [r for r in rows if r["event_id"] == "e1"]
    assert [r["raw"] for r in mine if r["outcome"] == "claimed"] == [won]
    assert sorted(r["outcome"] for r in mine) == sorted(["claimed", *["replay"] * (parts[0].count(won) - 1), *["conflict"] * (5 - parts[0].count(won))])
    want = {r["event_id"]: r for r in ev.routed(spark.createDataFrame([(t,) for t in first], "value string")).collect()}
    for r in rows:
        if r["outcome"] == "claimed" and r["event_id"] not in ("e1", "e300"):
            assert r.asDict() == {**want[r["event_id"]].asDict(), "outcome": "claimed"}


def test_state_is_asked_by_slot(spark, tmp_path):
    """1000 groups are kept in at most as many values as there are slots, and times beyond pandas' range are kept; sums past 2**53 stay exact."""
    keyed.use_rocksdb(spark)
    root = f"file://{tmp_path}"
    rows = [rec("LEFT", f"k{i}", 2**60 + i, base=2**60 + i) for i in range(1000)] + [rec("RIGHT", f"k{i}", 2**60 + i) for i in range(500)]
    far = list(rec("LEFT", "end", 1))
    far[10] = datetime(2999, 1, 1)
    held = []
    for part in (rows, [tuple(far)]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        q = batches.run_batches(keyed.keyed_groups(source, slots=16), lambda df, i: batches.write_batch(df, f"{root}/out", i), f"{root}/check")
        q.awaitTermination()
        held.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]))
    assert max(held) <= 16
    last = keyed.latest_groups(spark.read.parquet(f"{root}/out")).where("match_key <> 'end'")
    names = ["match_key", "left_count", "right_count", "left_sum", "right_sum", "left_base", "left_copies", "presence"]
    batch = match_groups(spark.createDataFrame(rows, SCHEMA), on_mixed="mark")
    assert sorted(map(tuple, last.select(*names).collect())) == sorted(map(tuple, batch.select(*names).collect()))


def test_a_large_stream_has_more_slots_and_partitions(spark, tmp_path):
    """What one task holds of the state is bounded: slots and partitions follow the records, and a slot's groups come out a few thousand at a time."""
    assert keyed.sized(1000, 4) == (1024, 4) and keyed.sized(210_000_000, 12) == (32_768, 210)
    n = 25_000
    fill = {"string": "x", "int64": 1}
    parts = pa.table({f.name: pa.array([f"k{i}" for i in range(n)] if f.name == "match_key" else ["LEFT"] * n if f.name == "side" else [fill[str(f.type)]] * n, f.type) for f in slots._PARTS})
    frames = list(slots._frames(slots._groups(parts), "timer"))
    assert max(map(len, frames)) <= 10_000 and sum(map(len, frames)) == n and pd.concat(frames)["match_key"].nunique() == n
    keyed.use_rocksdb(spark)
    root = f"file://{tmp_path}"
    for part, partitions in (([rec("LEFT", f"k{i}", 1) for i in range(50)], 6), ([rec("LEFT", "end", 1, 6000)], None)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        batches.run_batches(keyed.keyed_groups(source, slots=16), lambda df, i: batches.write_batch(df, f"{root}/out", i), f"{root}/check", partitions=partitions).awaitTermination()
    assert len([f for f in (tmp_path / "check" / "state" / "0").iterdir() if f.name.isdigit()]) == 6 and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert keyed.latest_groups(spark.read.parquet(f"{root}/out")).where("match_key <> 'end'").count() == 50


@pytest.mark.parametrize("window", [{"size": "1 hour"}, {"size": "2 hours", "slide": "1 hour"}, {"gap": "30 minutes"}])
def test_windows_close_without_state(spark, tmp_path, window):
    """Windows over restarts: each closes once, sessions grow over batches, late rows stay out, and the engine keeps no state."""
    root, found = f"file://{tmp_path}", []

    def go(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        q = reconcile.reconcile_windows(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), f"{root}/t", ROLES, Rule(), scenario="C", period="P", checkpoint=f"{root}/check", watermark="10 minutes", **window)
        q.awaitTermination()
        assert not any(p["stateOperators"] for p in q.recentProgress)
        out = spark.read.parquet(f"{root}/t/discrepancies").groupBy("match_key", "type", "actual", "expected").count().collect()
        return sorted((r["match_key"], r["type"], r["expected"], r["actual"], r["count"]) for r in out)

    twice = 2 if "slide" in window else 1
    assert go(rec("LEFT", "a", 10, 0), rec("LEFT", "b", 10, 1), rec("RIGHT", "b", 10, 1), rec("LEFT", None, 3, None)) == []
    assert go(rec("RIGHT", "a", 9, 20)) == []
    a = ("a", "AMOUNT_MISMATCH", 10, 9, twice)
    assert go(rec("LEFT", "end", 1, 600)) == [a]
    assert go(rec("RIGHT", "a", 1, 2), rec("RIGHT", "c", 5, 595)) == [a]  # the first is late
    assert go(rec("LEFT", "end", 1, 1200))[:2] == [a, ("c", "EXTRA", 0, 5, twice)]


@pytest.mark.parametrize("window", [{"size": "2 hours", "slide": "1 hour"}, {"size": "90 minutes", "slide": "30 minutes"}, {"size": "50 minutes", "slide": "20 minutes"}])
def test_sliding_windows_deal_a_record_once(spark, window):
    """Windows of panes are those of the engine's expansion: over blocks, copies in several panes, other currencies, null keys and times before 1970."""
    rows = [rec(("LEFT", "RIGHT")[i % 2], f"k{i % 7}" if i % 11 else None, 10 + i % 2, 3 * i, ccy="EUR" if i % 29 == 0 else "USD", base=i if i % 5 else None, status="AB"[i % 2]) for i in range(400)]
    old = list(rec("LEFT", "k1", 5))
    old[10] = datetime(1969, 12, 31, 23, 59)
    df = spark.createDataFrame([*rows, tuple(old)], SCHEMA)
    got = reconcile.windowed_groups(df, on_mixed="mark", **window)
    keyed_rows = reconcile.with_null_refs(df)
    copies = keyed_rows.groupBy(F.window("biz_time", window["size"], window["slide"]).alias("window"), *reconcile.GROUP, *reconcile.COPY).agg(*reconcile.copy_columns())
    want = reconcile.with_presence(copies.groupBy("window", *reconcile.GROUP).agg(*reconcile.side_columns())).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and got.where("mixed").count() and got.where("left_copies").count()
    if window["size"] != "50 minutes":
        plan = reconcile.windowed_groups(df, on_mixed="mark", **window)._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_windows_leave_no_more_than_needed_on_disk(spark, tmp_path):
    """Landed records have no column that no discrepancy asks for, references stand for null keys only, and what sessions were made of goes; a batch's shuffle files go with it."""
    root = f"file://{tmp_path}"
    rows = [rec("LEFT", "a", 10), rec("LEFT", None, 3, ref="n1"), rec("LEFT", "end", 1, 6000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/in")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    for kind, window in (("fixed", {"size": "1 hour"}), ("session", {"gap": "30 minutes"})):
        source = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        reconcile.reconcile_windows(source, f"{root}/{kind}", ROLES, Rule(), scenario="C", period="P", checkpoint=f"{root}/check-{kind}", watermark="10 minutes", **window).awaitTermination()
        assert sorted(r["type"] for r in spark.read.parquet(f"{root}/{kind}/discrepancies").collect()) == ["MISSING"] * 2
    raw = spark.read.parquet(f"{root}/fixed/raw")
    assert "record_id" not in raw.columns and {r["raw_ref"] for r in raw.collect()} == {None, "n1"}
    assert not list((tmp_path / "session" / "sessions").glob("batch=*")) and list((tmp_path / "session" / "open").glob("batch=*"))
    seen = []
    batches.run_batches(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), lambda df, i: seen.append(df.sparkSession.conf.get(name)), f"{root}/check").awaitTermination()
    assert seen == ["true"] and spark.conf.get(name, None) == before


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_windows_close_and_are_repaired_span_by_span(spark, tmp_path, monkeypatch, slide):
    """Spans of few records give what one gives, each window once; a repair that is done again changes nothing, and a later one does not reject again what has been rejected."""
    monkeypatch.setattr(reconcile, "AT_ONCE", 5)
    root, rest = f"file://{tmp_path}", {"scenario": "C", "period": "P", "watermark": "10 minutes", "size": "1 hour", "slide": slide}
    first = [rec("LEFT", f"k{i % 4}", 10 + i, 25 * i, ref=f"a{i}") for i in range(24)]
    late = [rec("RIGHT", f"k{i % 4}", 10 + i, 25 * i + 1, ref=f"b{i}") for i in range(24) if i % 3] + [rec("LEFT", "k0", 1, 100, ccy="EUR", ref="m")]
    for part in (first, [rec("LEFT", "end", 1, 6000)], late):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        reconcile.land(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), f"{root}/t", f"{root}/check-land").awaitTermination()
        reconcile.reconcile_landed(spark, f"{root}/t", SCHEMA, ROLES, Rule(), checkpoint=f"{root}/check", **rest).awaitTermination()
    made = []
    for name in ("one", "one", "two"):
        reconcile.repair(spark, f"{root}/t", SCHEMA, ROLES, Rule(), name=name, **rest)
        groups = reconcile.current_groups(spark, f"{root}/t")
        made.append((sorted((r["window"]["start"], r["match_key"], r["left_count"], r["right_count"], r["left_sum"], r["right_sum"], r["revision"]) for r in groups.collect()), sorted(r["raw_ref"] for r in reconcile.all_rejects(spark, f"{root}/t").collect())))
    assert made[0] == made[1] == made[2]
    assert len(list((tmp_path / "t" / "groups").glob("batch=*-*"))) > 3 and len(list((tmp_path / "t" / "corrections").glob("batch=one-*"))) > 3
    spark.createDataFrame([*first, *late], SCHEMA).createOrReplaceTempView("spans_all")
    whole = reconcile.windowed_groups(spark.table("spans_all"), size="1 hour", slide=slide, on_mixed="mark")
    mixed = {(r["window"]["start"], r["match_key"]) for r in whole.where("mixed").collect()}
    want = [(r["window"]["start"], r["match_key"], r["left_count"], r["right_count"], r["left_sum"], r["right_sum"]) for r in whole.where("not mixed").collect()]
    assert sorted(g[:6] for g in made[0][0] if g[:2] not in mixed) == sorted(want) and mixed
    assert "m" in made[0][1] and (slide or len(made[0][1]) == len(set(made[0][1])))


def test_events_are_parsed_once_whatever_follows(spark):
    good = {"eventId": "e1", "eventType": "FULFILLMENT_INTERNAL", "schemaVersion": "1.0", "tenantId": "T", "occurredAt": "2026-08-17T00:00:00Z", "payload": {"factType": "INTERNAL", "benefitType": "GOODS", "awardItemNo": "A", "awardOrderNo": "O", "skuId": "s", "quantity": 1, "status": "SUCCEEDED"}}
    other = good | {"payload": good["payload"] | {"quantity": 2}}
    raw = spark.createDataFrame([(0, json.dumps(good)), (1, json.dumps(good)), (2, json.dumps(other)), (0, "{"), (0, None)], "seen int, value string")
    rows = ev.claim(ev.routed(raw, carry=["seen"]).where("target is not null"), spark.createDataFrame([], ev.INBOX), "c").select("event_id", "seen", "outcome")
    assert sorted(map(tuple, rows.collect())) == [("e1", 0, "claimed"), ("e1", 1, "replay"), ("e1", 2, "conflict")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [r["reason"] for r in ev.routed(raw).where("target is null").collect()] == ["not an event"] * 2
    known = spark.createDataFrame([("T", "c", "e1", "h"), ("T", "d", "e1", "h")], ev.INBOX)
    assert {r["outcome"] for r in ev.claim(ev.routed(raw).where("target is not null"), known, "c").collect()} == {"conflict"}
