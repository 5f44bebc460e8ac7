"""Golden ledgers: types, sums and reports of small literal inputs."""

import pytest
from pyspark.sql import functions as F

from ledgermatch.functions.keys import bucket_of, fingerprint, name_uuid, string_hash, strip_trailing, sub_index_of
from ledgermatch.operators.classify import PolicyRule, Roles, Rule, classify, discrepancies, register_evaluator
from ledgermatch.operators.conserve import conservation_report
from ledgermatch.operators.match import MIXED, broken_rejects, match_groups, standardize
from ledgermatch.plans.pipeline import Reconciliation
from ledgermatch.plans.scenario import Scenario, Segment, Source, marketing_three_way
from ledgermatch.sources.mapping import ReadContext, SourceMapping
from ledgermatch.sources.readers import csv_rows, read_csv_source, read_table_source, register_source, route_source, with_line_numbers
from ledgermatch.sources.sinks import with_discrepancy_ids
from ledgermatch.streaming.reconcile import windowed_groups

SCHEMA = "segment_id string, side string, match_key string, group_key string, currency string, signed_amount_minor long, entry_type string, biz_status string, posting_time string, base_amount_minor long, raw_ref string"
DAY = "2026-08-17 10:00:00"


def row(side, key, amount, ccy="USD", entry="ISSUE", status="PAID", at=DAY, base=None, ref=None, group=None, segment="S"):
    row.n = getattr(row, "n", 0) + 1
    return (segment, side, key, group or key or "g", ccy, amount, entry, status, at, base, ref or f"r{row.n}")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("posting_time", F.col("posting_time").cast("timestamp")).withColumn("run_id", F.lit("run"))


def run(spark, rows, rule=Rule(), roles=None, **kw):
    return classify(match_groups(frame(spark, rows), **kw), roles or {"S": Roles("MARKETING", "CHANNEL")}, rule, scenario="S", period="2026-08-17")


def types(classified):
    return {r["match_key"]: r["type"] for r in classified.collect()}


E2E = [
    row("LEFT", "CLEAN", 1000), row("RIGHT", "CLEAN", 1000), row("LEFT", "AMT", 1000), row("RIGHT", "AMT", 900), row("LEFT", "MISS", 500), row("RIGHT", "EXTRA", 700),
    row("LEFT", "DUP", 300), row("LEFT", "DUP", 300), row("RIGHT", "DUP", 600), row("LEFT", "GSM", 400), row("LEFT", "GSM", -100, entry="REFUND"), row("RIGHT", "GSM", 500),
    row("LEFT", "STAT", 200), row("RIGHT", "STAT", 200, status="PENDING"), row("LEFT", "CCY", 200), row("RIGHT", "CCY", 200, ccy="EUR"),
]


def test_one_segment(spark):
    c = run(spark, E2E)
    assert types(c) == {"CLEAN": None, "AMT": "AMOUNT_MISMATCH", "MISS": "MISSING", "EXTRA": "EXTRA", "DUP": "DUPLICATE", "GSM": "GROUP_SUM_MISMATCH", "STAT": "STATUS_MISMATCH", "CCY": "CURRENCY_MISMATCH"}
    report = {r["currency"]: r for r in conservation_report(c).collect()}
    assert (report["USD"]["expected_total"], report["USD"]["matched_left"]) == (3800, 1000)
    assert all(r["balanced"] for r in report.values()) and set(report) == {"USD", "EUR"}
    assert discrepancies(c).count() == 7


@pytest.mark.parametrize("rows, expected", [
    ([row("LEFT", "k", 5), row("LEFT", "k", 5)], "MISSING"),  # copies on one side only are no duplicate
    ([row("LEFT", "k", 5), row("LEFT", "k", 5), row("RIGHT", "k", 10, ccy="EUR")], "CURRENCY_MISMATCH"),
    ([row("LEFT", "k", 5), row("LEFT", "k", 5), row("RIGHT", "k", 11)], "DUPLICATE"),
    ([row("LEFT", "k", 5), row("LEFT", "k", 6), row("RIGHT", "k", 12)], "GROUP_SUM_MISMATCH"),
    ([row("LEFT", "k", 5), row("LEFT", "k", 6), row("RIGHT", "k", 11, status="X")], None),
    ([row("LEFT", "k", 5), row("RIGHT", "k", 6, status="X")], "AMOUNT_MISMATCH"),
    ([row("LEFT", "k", 5), row("RIGHT", "k", 5, status="X", at="2026-08-18 10:00:00")], "STATUS_MISMATCH"),
    ([row("LEFT", "k", 5), row("RIGHT", "k", 5, at="2026-08-18 00:00:00")], "TIMING"),
    ([row("LEFT", "k", 5, status=None), row("RIGHT", "k", 5)], None),
    ([row("LEFT", "k", 5, at=None), row("RIGHT", "k", 5)], None),
    ([row("LEFT", "k", 5, base=1000), row("RIGHT", "k", 5, ccy="EUR", base=1005)], None),
    ([row("LEFT", "k", 5, base=1000), row("RIGHT", "k", 5, ccy="EUR", base=1011)], "FX_RATE_DIFF"),
    ([row("LEFT", "k", 5, base=1000), row("RIGHT", "k", 5, ccy="EUR")], "CURRENCY_MISMATCH"),
])
def test_precedence(spark, rows, expected):
    c = run(spark, rows, Rule(fx_tolerance=10))
    assert [r["type"] for r in c.collect()] == [expected]
    assert all(r["balanced"] for r in conservation_report(c).collect())


def test_timing_window(spark):
    rows = [row("LEFT", "k", 5), row("RIGHT", "k", 5, at="2026-08-19 10:00:00")]
    assert types(run(spark, rows, Rule(window=("2026-08-17 00:00:00", "2026-08-18 23:59:59")))) == {"k": None}
    assert types(run(spark, rows, Rule(window=("2026-08-17 00:00:00", "2026-08-19 10:00:00")))) == {"k": "TIMING"}


@pytest.mark.parametrize("rule, actual, clean", [
    (Rule("TOLERANCE", abs_minor=100), 900, True), (Rule("TOLERANCE", abs_minor=100), 899, False), (Rule("TOLERANCE", bps=100), 990, True), (Rule("TOLERANCE", bps=100), 989, False),
    (Rule("TOLERANCE"), 999, False), (Rule("EXACT", enabled=("MISSING",)), 900, True), (Rule("EXACT", enabled=()), 900, True), (Rule("POLICY", abs_minor=100), 900, True), (Rule("POLICY", enabled=("EXTRA",)), 900, True),
])
def test_evaluators(spark, rule, actual, clean):
    c = run(spark, [row("LEFT", "k", 1000), row("RIGHT", "k", actual)], rule)
    assert [r["type"] is None for r in c.collect()] == [clean]
    assert all(r["balanced"] for r in conservation_report(c).collect())


def test_policy_retype_and_errors(spark):
    rows = [row("LEFT", "k", 1000), row("RIGHT", "k", 900)]
    plain = run(spark, rows).first()
    retyped = run(spark, rows, Rule("POLICY", policies=(PolicyRule("delta = 100", "retype", "TIMING"),))).first()
    assert retyped["type"] == "TIMING" and retyped["fingerprint"] != plain["fingerprint"]
    with pytest.raises(Exception):
        run(spark, rows, Rule("POLICY", policies=(PolicyRule("no_such_column = 1", "suppress"),)))
    with pytest.raises(ValueError):
        run(spark, rows, Rule("SCRIPT"))


def test_overflow_and_mixed_currencies_fail(spark):
    top = 2**63 - 1
    with pytest.raises(Exception, match="OVERFLOW"):
        run(spark, [row("LEFT", "k", top), row("LEFT", "k", top - 1)]).collect()
    mixed = [row("LEFT", "k", 1), row("LEFT", "k", 2, ccy="EUR"), row("RIGHT", "k", 3)]
    with pytest.raises(Exception, match="several currencies"):
        run(spark, mixed).collect()
    assert match_groups(frame(spark, mixed), on_mixed="mark").first()["mixed"]


def test_null_keys_stay_apart(spark):
    roles = {"S": Roles("MARKETING", "ACCOUNTING", "ACCOUNTING", "SEG1")}
    c = run(spark, [row("LEFT", None, 400, group="O"), row("LEFT", None, 300, group="O"), row("RIGHT", None, 300, group="O")], roles=roles)
    d = discrepancies(c).collect()
    assert sorted(r["type"] for r in d) == ["BRIDGE_BROKEN", "BRIDGE_BROKEN", "EXTRA"] and len({r["fingerprint"] for r in d}) == 3
    assert {r["bridge_broken"] for r in conservation_report(c).collect()} == {700}


LEDGER = "id string, order_no string, issue_id string, channel_serial_no string, ccy string, amount_minor long, entry_type string, biz_status string, biz_time string, posting_time string"


def three_way(spark):
    line = lambda i, o, k, c, a, e="ISSUE": (i, o, k, c, "USD", a, e, "PAID", DAY, DAY)
    marketing = [line("m1", "O1", "I1a", None, 1000), line("m2", "O1", "I1b", None, 2000), line("m3", "O2", "I2", None, 1000), line("m4", "O3", "I3", None, 500), line("m5", "O5", "I5", None, 400), line("m6", "O5", "I5", None, -100, "REFUND"), line("m7", "O6", "I6", None, 800), line("m8", "O8", "I8", None, 300)]
    accounting = [line("a1", "O1", "I1a", "C1a", 1000), line("a2", "O1", "I1b", "C1b", 2000), line("a3", "O2", "I2", "C2", 900), line("a5", "O5", "I5", "C5", 500), line("a6", "O6", "I6", "C6", 800), line("a8", "O8", "I8", "C8", 300)]
    channel = [line("c1", None, None, "C1a", 1000), line("c2", None, None, "C1b", 2000), line("c3", None, None, "C2", 900), line("c5", None, None, "C5", 500), line("c6", None, None, "C6", 700), line("c9", None, None, "C9", 700)]
    tables = {n: spark.createDataFrame(r, LEDGER) for n, r in (("marketing", marketing), ("accounting", accounting), ("channel", channel))}
    return Reconciliation(spark, marketing_three_way(), "RUN", "2026-08-17", tables)


def test_three_way(spark):
    r = three_way(spark)
    found = {(d["segment_id"][:4], d["match_key"]): (d["type"], d["stage"]) for d in r.discrepancies.collect()}
    assert found == {
        ("SEG1", "I2"): ("AMOUNT_MISMATCH", None), ("SEG1", "I3"): ("BRIDGE_BROKEN", "SEG1"), ("SEG1", "I5"): ("GROUP_SUM_MISMATCH", None), ("SEG2", "C6"): ("AMOUNT_MISMATCH", None), ("SEG2", "C8"): ("MISSING", None), ("SEG2", "C9"): ("BRIDGE_BROKEN", "SEG2"),
    }
    s1, s2 = sorted(r.proven.collect(), key=lambda x: x["segment_id"])
    assert (s1["expected_total"], s1["matched_left"], s1["bridge_broken"]) == (5900, 4100, 500)
    assert (s2["expected_total"], s2["matched_left"], s2["missing"], s2["bridge_broken"]) == (5500, 4400, 300, 700)
    assert s1["balanced"] and s2["balanced"]


def test_partition_count_does_not_matter(spark):
    def rows():
        return sorted(map(tuple, three_way(spark).discrepancies.collect()), key=repr)

    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_plan_has_no_python_and_no_join(spark):
    plan = three_way(spark).classified._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan


def test_keys(spark):
    df = spark.createDataFrame([("a \t　",), (" a",), ("a ",), (None,), ("O1",)], "k string")
    got = [tuple(r) for r in df.select(strip_trailing(F.col("k")), string_hash(F.col("k")), bucket_of(F.coalesce("k", F.lit("x")), 64), sub_index_of(F.col("k"), F.lit(None).cast("string"), 4)).collect()]
    assert [g[0] for g in got] == ["a", " a", "a ", None, "O1"] and got[4][1] == 2498 and got[4][2] == 2498 % 64 and all(0 <= g[3] < 4 for g in got)
    one = spark.range(1).select(fingerprint("a|b", F.lit(None).cast("string")).alias("f"), F.sha2(F.lit("a\\|b|∅"), 256).alias("g"), name_uuid(F.lit("x")).alias("u")).first()
    import uuid, hashlib  # noqa: E401

    assert one["f"] == one["g"] and one["u"] == str(uuid.UUID(bytes=hashlib.md5(b"x").digest(), version=3))


def test_money_columns_are_longs(spark):
    r = three_way(spark)
    for df in (r.records, r.discrepancies, r.report):
        assert "double" not in [t for _, t in df.dtypes] and "float" not in [t for _, t in df.dtypes]


def test_table_source_rejects(spark):
    rows = [("1", "g", "USD", 5, "refund"), ("2", None, "USD", 5, None), ("3", "g", None, 5, None), ("4", "g", "USD", None, None), ("5", "g", "US", 5, "other"), ("6", "", "usd", 5, "other")]
    df = spark.createDataFrame(rows, "id string, group_key string, ccy string, amount_minor long, entry_type string")
    mapping = SourceMapping("t", biz_status=None, biz_time=None, posting_time=None)
    records, rejects = read_table_source(df, mapping, ReadContext("r", "s", "LEFT", "MARKETING"))
    assert {(r["raw_ref"], r["entry_type"], r["currency"]) for r in records.collect()} == {("t:1", "REFUND", "USD"), ("t:6", "ISSUE", "usd")}
    assert {r["raw_ref"]: r["reason"] for r in rejects.collect()} == {"t:2": "null group_key", "t:3": "null currency", "t:4": "null amount", "t:5": "invalid money: currency US"}
    with pytest.raises(ValueError):
        read_table_source(df.drop("ccy"), mapping, ReadContext("r", "s", "LEFT", "MARKETING"))


def test_csv_source(spark, tmp_path):
    path = tmp_path / "m.csv"
    head = "id;order_no;issue_id;ccy;amount_minor;entry_type;biz_status;biz_time;posting_time\n"
    body = ['1;"O;x";I1; usd ; 100 ;ISSUE;PAID;2026-08-17T00:00:00Z;', "2;O;I2;USD;not-long;ISSUE;PAID;2026-08-17T00:00:00Z;", "3;O;I3;USD;1;GIFT;PAID;2026-08-17T00:00:00Z;", "4;O;I4;USD;1;ISSUE;PAID;2026-08-17;", "5;;I5;USD;1;ISSUE;PAID;2026-08-17T00:00:00Z;", "6;O", "7;O;;USD;-7;REFUND;;2026-08-17T00:00:00.5Z;2026-08-18T00:00:00Z"]
    path.write_bytes(("﻿" + head + "\n".join(body) + "\n").encode())
    records, rejects = read_csv_source(spark, str(path), SourceMapping("m", match_key="issue_id", group_key="order_no"), ReadContext("r", "s", "LEFT", "MARKETING"), delimiter=";")
    good = {r["raw_ref"].rsplit(":", 1)[1]: r for r in records.collect()}
    assert set(good) == {"1", "7"} and good["1"]["group_key"] == "O;x" and good["1"]["currency"] == "USD" and good["1"]["signed_amount_minor"] == 100 and good["7"]["match_key"] is None
    reasons = {r["raw_ref"].rsplit(":", 1)[1]: r["reason"] for r in rejects.collect()}
    assert reasons["2"].startswith("not a signed long") and reasons["3"].startswith("unknown entry_type") and reasons["4"].startswith("not an instant") and reasons["5"] == "group_key is required" and "6" in reasons
    with pytest.raises(ValueError):
        read_csv_source(spark, str(path), SourceMapping("m", match_key="none", group_key="order_no"), ReadContext("r", "s", "LEFT", "MARKETING"), delimiter=";")
    lines = with_line_numbers(spark, str(path)).orderBy("file", "number").collect()
    assert [r["number"] for r in lines] == list(range(1, 9)) and lines[0]["file"].endswith("m.csv")


def test_routing(spark):
    with pytest.raises(ValueError):
        route_source(spark, "tape", None, SourceMapping("t"), ReadContext("r", "s", "LEFT", "M"))
    with pytest.raises(ValueError):
        register_source("db", None)


def test_scenario_json(spark):
    s = marketing_three_way()
    assert Scenario.from_json(s.to_json()) == s
    for broken in (lambda x: x.__class__("", x.segments), lambda x: x.__class__("a", ()), lambda x: x.__class__("a", x.segments + x.segments), lambda x: x.__class__("a" * 33, x.segments)):
        with pytest.raises(ValueError):
            broken(s).validate()


def test_standardize_checks_keys(spark):
    df = spark.createDataFrame([("k ", None), ("k\t", "g ")], "match_key string, group_key string")
    assert [tuple(r) for r in standardize(df).select("match_key", "group_key").collect()] == [("k", "g")]
    with pytest.raises(Exception, match="without group key"):
        standardize(df, strict=True).collect()


def ledger_table(spark, rows):
    return spark.createDataFrame(rows, "id string, key string, ccy string, amount_minor long")


def plain(name, **options):
    return Source("memory", name, SourceMapping(name, match_key="key", group_key="key", entry_type=None, biz_status=None, biz_time=None, posting_time=None), **options)


def test_quarantine_of_mixed_currencies(spark):
    tables = {"l": ledger_table(spark, [("1", "a", "USD", 5), ("2", "b", "USD", 7), ("3", "b", "EUR", 7)]), "r": ledger_table(spark, [("4", "a", "USD", 5), ("5", "b", "USD", 14), ("6", None, "USD", 1)])}
    scenario = Scenario("S", (Segment("S", "A", "B", plain("l"), plain("r")),))
    with pytest.raises(Exception, match="several currencies"):
        Reconciliation(spark, scenario, "S:1", "p", tables).report.collect()  # though the report needs no single currency
    r = Reconciliation(spark, scenario, "S:1", "p", tables, on_mixed="quarantine")
    assert {(x["raw_ref"], x["reason"]) for x in r.rejects.collect()} == {("l:2", MIXED), ("l:3", MIXED), ("r:5", MIXED), ("r:6", "null group_key")}
    assert [(x["expected_total"], x["right_total"], x["balanced"]) for x in r.proven.collect()] == [(5, 5, True)]
    marked = Reconciliation(spark, scenario, "S:1", "p", tables, on_mixed="mark")
    assert {x["match_key"]: x["mixed"] for x in marked.groups.collect()} == {"a": False, "b": True}


def test_broken_keys_become_rejects(spark):
    df = frame(spark, [row("LEFT", "k", 1, ref="x"), row("LEFT", "j", 1, group="g ")]).withColumn("group_key", F.when(F.col("match_key") != "k", F.col("group_key")))
    assert standardize(df).select("match_key", "group_key").collect() == [("j", "g")]
    assert [(x["raw_ref"], x["reason"]) for x in broken_rejects(df).collect()] == [("x", "match key without group key")]


def test_suppression_wins_over_retyping(spark):
    rows = [row("LEFT", "k", 10), row("RIGHT", "k", 8), row("LEFT", "t", 5), row("RIGHT", "t", 5, status="X")]
    retype = PolicyRule("type in ('AMOUNT_MISMATCH', 'STATUS_MISMATCH')", "retype", "TIMING", 200)
    assert types(run(spark, rows, Rule("POLICY", enabled=("STATUS_MISMATCH", "TIMING"), policies=(retype,)))) == {"k": None, "t": "TIMING"}
    later = PolicyRule("abs_delta > 1 and not multi_line", "retype", "MISSING", 1)
    assert types(run(spark, rows, Rule("POLICY", policies=(retype, later)))) == {"k": "MISSING", "t": "TIMING"}
    assert types(run(spark, rows, Rule("POLICY", abs_minor=2, policies=(later,)))) == {"k": None, "t": "STATUS_MISMATCH"}


def test_scenario_with_options_and_unknown_parts(spark):
    scenario = Scenario("S", (Segment("S", "A", "B", plain("l", options={"url": "u", "numPartitions": "4"}), plain("r")),)).validate()
    assert Scenario.from_json(scenario.to_json()) == scenario and scenario.segments[0].left.options["numPartitions"] == "4"
    with pytest.raises(ValueError, match="strategy"):
        Scenario("S", (Segment("S", "A", "B", plain("l"), plain("r"), strategy="none"),)).validate()
    with pytest.raises(ValueError, match="registered already"):
        register_evaluator("EXACT", None)


def test_jdbc_source_in_a_scenario(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no embedded database on the class path")
    left = ledger_table(spark, [(str(i), f"k{i}", "USD", i) for i in range(20)]).withColumn("n", F.col("amount_minor").cast("int"))
    left.write.format("jdbc").options(url=url, driver=driver, dbtable="ledger_rows").save()
    mapping = SourceMapping("ledger_rows", match_key="key", group_key="key", entry_type=None, biz_status=None, biz_time=None, posting_time=None)
    options = {"url": url, "driver": driver, "partitionColumn": "n", "lowerBound": "0", "upperBound": "20", "numPartitions": "4"}
    source = Source("jdbc", "ledger_rows", mapping, options)
    r = Reconciliation(spark, Scenario("S", (Segment("S", "A", "B", source, source),)), "S:1", "p")
    assert r._read[0].rdd.getNumPartitions() == 8 and r.records.count() == 40 and r.discrepancies.count() == 0


def test_csv_rows_by_line(spark, tmp_path):
    for name, rows in (("a.csv", 3), ("b.csv", 2)):
        (tmp_path / name).write_text("id,key,ccy,amount_minor\n" + "".join(f"{name}{i},k,USD,{i}\n" for i in range(rows)))
    mapping = SourceMapping("t", match_key="key", group_key="key", entry_type=None, biz_status=None, biz_time=None, posting_time=None)
    ctx = ReadContext("r", "s", "LEFT", "M")
    records, _ = read_csv_source(spark, str(tmp_path), mapping, ctx, lineage="line")
    assert sorted(("/".join(r["raw_ref"].rsplit("/", 1)[1:]), r["signed_amount_minor"]) for r in records.collect()) == [("a.csv:2", 0), ("a.csv:3", 1), ("a.csv:4", 2), ("b.csv:2", 0), ("b.csv:3", 1)]
    with pytest.raises(ValueError, match="lineage"):
        read_csv_source(spark, str(tmp_path), mapping, ctx, lineage="place")
    with pytest.raises(ValueError, match="charsets"):
        read_csv_source(spark, str(tmp_path), mapping, ctx, lineage="line", charset="UTF-16LE")


LINES = SourceMapping("t", id="id", match_key="key", group_key="key", entry_type=None, biz_time=None, posting_time=None)
CTX = ReadContext("r", "s", "LEFT", "M")


def ranges(df):
    return sorted((r["raw_ref"].rsplit(":", 1)[1], r["biz_status"]) for r in df.collect())


def test_rows_of_several_lines(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('\ufeffid,key,ccy,amount_minor,biz_status\n1,k,USD,1,plain\n2,k,USD,1,"a ""quoted"" word,\n\nand more"\n\n3,k,USD,1,"one"\n4,k,USD,x,"bad\n"\n5,k\n6,k,USD,1,"open\n7,k,USD,1,lost\n8,k,USD,1,lost\n')
    records, rejects = read_csv_source(spark, str(path), LINES, CTX, lineage="line", multi_line=True)
    assert ranges(records) == [("2", "plain"), ("3-5", 'a "quoted" word,\n\nand more'), ("7", "one")]
    got = sorted((r["raw_ref"].rsplit(":", 1)[1], r["reason"].split(":")[0]) for r in rejects.collect())
    assert got == [("10", "row does not fit the header"), ("11", "a quote that no line closes; nothing is read behind it"), ("8-9", "not a signed long")]
    by_id, _ = read_csv_source(spark, str(path), LINES, CTX, multi_line=True)
    assert {r["biz_status"] for r in by_id.collect()} >= {"plain", 'a "quoted" word,\n\nand more', "one"}


def test_one_file_of_many_blocks(spark, tmp_path):
    """Rows may begin and end in any block; the numbers are those of reading the file line by line."""
    import csv
    import random

    rng, want, line = random.Random(5), [], 2
    with open(tmp_path / "big.csv", "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "key", "ccy", "amount_minor", "biz_status"])
        for i in range(4000):
            n = rng.choice([0, 0, 0, 1, 2, 40])
            text = "".join(rng.choice(['x" ', "y,", "z"]) + "\n" for _ in range(n)) + "e"
            w.writerow([i, "k", "USD", i, text])
            want.append((str(line) if n == 0 else f"{line}-{line + n}", i))
            line += n + 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    try:
        records, rejects = read_csv_source(spark, str(tmp_path / "big.csv"), LINES, CTX, lineage="line", multi_line=True)
        assert spark.read.text(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 10
        assert sorted((r["raw_ref"].rsplit(":", 1)[1], r["signed_amount_minor"]) for r in records.collect()) == sorted(want) and rejects.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_filters_and_expressions(spark, tmp_path):
    path = tmp_path / "m.csv"
    head = "id,order no,ccy,amount_minor,tenant,posted\n"
    rows = ["1,O1,usd,1,T1,2026-08-17T00:00:00Z", "2,O2,usd,2,T2,2026-08-17T00:00:00Z", "3,O3,usd,3,T1,2026-08-18T00:00:01Z", "4,O4,usd,4,T1,", "5,O5,usd,5,T1,soon", "6,O6,usd,6,,2026-08-17T00:00:00Z", "7,,usd,7,T1,2026-08-17T00:00:00Z", "8,O8"]
    path.write_text(head + "\n".join(rows) + "\n")
    mapping = SourceMapping("m", group_key=None, match_expr="concat(`order no`, '/', id)", group_expr="lower(`order no`)", entry_type=None, biz_status=None, biz_time=None, posting_time="posted", tenant="tenant")
    for lineage in ("id", "line"):
        records, rejects = read_csv_source(spark, str(path), mapping, ReadContext("r", "s", "LEFT", "M", cutoff="2026-08-18", tenant_id="T1"), lineage=lineage)
        assert [(r["match_key"], r["group_key"], r["signed_amount_minor"]) for r in records.collect()] == [("O1/1", "o1", 1)]
        assert sorted(r["reason"] for r in rejects.collect()) == ["group_key is required", "not an instant: soon", "row does not fit the header"]
    source = Source("csv-file", str(path), mapping)
    assert Scenario("S", (Segment("S", "A", "B", source, source),)).validate()
    with pytest.raises(ValueError, match="keys"):
        bare = Source("csv-file", str(path), SourceMapping("m"))
        Scenario("S", (Segment("S", "A", "B", bare, bare),)).validate()


def test_session_windows_group_as_the_batch_does(spark):
    df = frame(spark, E2E).withColumn("biz_time", F.lit(DAY).cast("timestamp"))
    names = ["match_key", "left_count", "right_count", "left_sum", "right_sum", "left_copies", "right_copies", "left_currency", "presence", "left_base"]
    batch = sorted(map(tuple, match_groups(df).select(*names).collect()), key=repr)
    assert sorted(map(tuple, windowed_groups(df, gap="1 hour").select(*names).collect()), key=repr) == batch
    assert sorted(map(tuple, windowed_groups(df).select(*names).collect()), key=repr) == batch


def test_discrepancies_need_two_exchanges(spark):
    from ledgermatch.plans import demo

    plan = with_discrepancy_ids(demo.run(spark, "/root/testdata/sf0.001").discrepancies)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan and "Python" not in plan


def test_rows_of_several_lines_are_put_together_across_small_parts(spark, tmp_path):
    """Parts of two lines, within which rows begin, end and lie whole; the lines are not joined by file and a row is parsed once."""
    (tmp_path / "in").mkdir()
    for name, unclosed in (("a", False), ("b", True)):
        rows = [f'{i},k,USD,{i},"' + "\n".join(['q""x'] * (i % 6 + 1)) + '"' if i % 3 else f"{i},k,USD,{i},plain" for i in range(50)]
        (tmp_path / "in" / f"{name}.csv").write_text("id,key,ccy,amount_minor,biz_status\n" + "\n".join(rows) + ('\n99,k,USD,1,"open\n100,k,USD,1,z\n' if unclosed else "\n"))
    path = f"file://{tmp_path}/in"
    small, large = (sorted(map(tuple, csv_rows(spark, path, part_bits=b).collect())) for b in (1, 18))
    assert small == large and len(small) == 103 and sum(not r[4] for r in small) == 1
    at = {r[0].rsplit("/", 1)[1]: 2 for r in small}
    for file, first, last, text, closed in small:  # no line is lost or in two rows
        if first > 1 and closed:
            assert first == at[file.rsplit("/", 1)[1]] and text.count("\n") == last - first
            at[file.rsplit("/", 1)[1]] = last + 1
    mapping = SourceMapping("orders", match_key="key", group_key="key", entry_type=None, biz_time=None, posting_time=None)
    for multi_line in (False, True):
        records, rejects = read_csv_source(spark, path, mapping, ReadContext("r", "S", "LEFT", "ORDERS"), lineage="line", multi_line=multi_line)
        plan = records._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_csv(") == 1
    assert records.count() == 100 and rejects.count() == 1
    assert "SortMergeJoin" not in with_line_numbers(spark, path)._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_need_no_references_or_run_ids(spark):
    from ledgermatch.plans import demo

    plan = demo.run(spark, "/root/testdata/sf0.001").discrepancies.select("fingerprint")._jdf.queryExecution().optimizedPlan().toString()
    steps = [x for x in plan.splitlines() if "Aggregate [" in x]
    assert len(steps) == 2 and not any("min(raw_ref" in x or "run_id" in x for x in steps)
    assert "filter(array" not in plan  # interpreted, for each row


def test_fingerprints_of_null_keys(spark):
    rows = [row("LEFT", None, 5, ref="a:b:1", group="G"), row("RIGHT", None, 7, ref="c", group="G"), row("LEFT", "K", 5, ref="d", group="G")]
    got = {r["left_ref"] or r["right_ref"]: r["fingerprint"] for r in run(spark, rows).collect()}
    mark = lambda kind, slot: spark.range(1).select(fingerprint("S", "2026-08-17", F.lit("S"), F.lit(kind), F.lit("G"), F.lit(slot), F.lit(None).cast("string"))).first()[0]
    assert got == {"a:b:1": mark("MISSING", "a:b:1"), "c": mark("EXTRA", "c"), "d": mark("MISSING", "K")}


def test_hashes_of_short_and_long_keys(spark):
    keys = ["", "O1", "~" * 8, "b" * 9, "~" * 16, "~" * 17, "é漢" * 4, "é漢" * 9, "\0a", "a\0"]

    def code(key):
        h = 0
        for c in key:
            h = (h * 31 + ord(c)) % 2**32
        return h - 2**32 if h >= 2**31 else h

    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", string_hash(F.col("k")).alias("h"))
    assert {r["k"]: r["h"] for r in got.collect()} == {k: code(k) for k in keys}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1  # for keys over 16 characters only
