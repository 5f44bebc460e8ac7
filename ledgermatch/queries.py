"""Registered queries of the reconciliation operators, each over whole tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.keys import strip_trailing, sub_index_of
from .operators import entitlement, ledger, outbox, text_index, views
from .operators.classify import EVALUATORS, PolicyRule, Roles, Rule, classify, discrepancies, register_evaluator
from .operators.conserve import conservation_report
from .operators.match import broken_rejects, identity_keys, match_groups, register_strategy
from .plans import demo
from .plans.demo import classified_sql, records_sql
from .plans.pipeline import Reconciliation, write_run
from .plans.scenario import Scenario, Segment, Source, benefit_cash_three_way, entitlement_fulfillment
from .sources.mapping import ReadContext, SourceMapping
from .sources.readers import read_csv_source, read_table_source, register_source
from .sources.bucketed import store_bucketed
from .sources.sinks import with_discrepancy_ids
from .sources.work import work_path
from .streaming import batches, events as ev, keyed, reconcile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table that is written once and read by all that follows, as a run's are."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _written_path(df: DataFrame) -> str:
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return path


def _found(spark, sf_dir, **options) -> DataFrame:
    """The demo run's discrepancies, stored."""
    return _stored(demo.run(spark, sf_dir, **options).discrepancies, "discrepancies")


def _dealt(df: DataFrame) -> DataFrame:
    """A ledger stored by fingerprint."""
    return store_bucketed(df, f"ledger_{uuid.uuid4().hex}", buckets=16, path=work_path(df.sparkSession, "ledger"))


def _types(classified: DataFrame) -> DataFrame:
    return classified.groupBy("segment_id", F.coalesce("type", F.lit("CLEAN")).alias("type")).agg(F.count("*").alias("n_groups"), F.sum("left_sum").alias("sum_left"), F.sum("right_sum").alias("sum_right"))


_TYPES = "select segment_id, coalesce(type, 'CLEAN') as type, count(*) as n_groups, sum(left_sum)::bigint as sum_left, sum(right_sum)::bigint as sum_right from cl group by all"


@query(classified_sql() + _TYPES)
def recon_three_way_types(spark, sf_dir):
    """JN1-JN4, AG1-AG3, CL1: groups and sums by segment and type."""
    return _types(demo.run(spark, sf_dir).classified)


@query(classified_sql() + "select segment_id, match_key, null_ref, group_key, left_count, right_count, left_sum, right_sum, left_currency, right_currency, left_ref, right_ref, left_status, right_status, left_copies, right_copies, presence from cl")
def recon_match_groups(spark, sf_dir):
    """JN1, JN2, AG1, AG2, CL7: all match groups."""
    return demo.run(spark, sf_dir).groups.select("segment_id", "match_key", "null_ref", "group_key", "left_count", "right_count", "left_sum", "right_sum", "left_currency", "right_currency", "left_ref", "right_ref", "left_status", "right_status", "left_copies", "right_copies", "presence")


def _uuid(name: str) -> str:
    """SQL of the version-3 id of a name."""
    m = f"md5({name})"
    variant = f"printf('%02x', (('0x' || substr({m}, 17, 2))::int & 63) | 128)"
    return f"substr({m}, 1, 8) || '-' || substr({m}, 9, 4) || '-3' || substr({m}, 14, 3) || '-' || {variant} || substr({m}, 19, 2) || '-' || substr({m}, 21, 12)"


_ID = _uuid(f"'{demo.RUN}|' || fingerprint")


@query(classified_sql() + f"select segment_id, fingerprint, {_ID} as discrepancy_id, type, stage, match_key, group_key, currency, expected, actual, delta, left_ref, right_ref from cl where type is not null")
def recon_discrepancies(spark, sf_dir):
    """CL6, SNK2: discrepancies with ids and with fingerprints that no run changes."""
    return with_discrepancy_ids(demo.run(spark, sf_dir).discrepancies).drop("run_id")


_REPORT = """, sd as (
  select segment_id, left_currency as currency, 'L' as s, left_sum as a, case when presence = 'BOTH' and type is null then 'matched_left' when type = 'CURRENCY_MISMATCH' then 'currency_left' when type = 'BRIDGE_BROKEN' then 'bridge_left' else type end as acc from cl where left_count > 0
  union all select segment_id, right_currency, 'R', right_sum, case when type = 'CURRENCY_MISMATCH' then 'currency_right' when presence = 'BOTH' then 'matched_right' when type = 'BRIDGE_BROKEN' then 'bridge_right' else 'extra' end from cl where right_count > 0),
rp as (select segment_id, currency, coalesce(sum(a) filter (s = 'L'), 0)::bigint as expected_total, coalesce(sum(a) filter (s = 'R'), 0)::bigint as right_total,
  coalesce(sum(a) filter (acc = 'matched_left'), 0)::bigint as matched_left, coalesce(sum(a) filter (acc = 'MISSING'), 0)::bigint as missing, coalesce(sum(a) filter (acc = 'AMOUNT_MISMATCH'), 0)::bigint as amount,
  coalesce(sum(a) filter (acc = 'GROUP_SUM_MISMATCH'), 0)::bigint as group_sum, coalesce(sum(a) filter (acc = 'TIMING'), 0)::bigint as timing, coalesce(sum(a) filter (acc = 'STATUS_MISMATCH'), 0)::bigint as status,
  coalesce(sum(a) filter (acc = 'DUPLICATE'), 0)::bigint as duplicate, coalesce(sum(a) filter (acc = 'extra'), 0)::bigint as extra, coalesce(sum(a) filter (acc = 'matched_right'), 0)::bigint as matched_right,
  coalesce(sum(a) filter (acc in ('currency_left', 'currency_right')), 0)::bigint as currency_mismatch, coalesce(sum(a) filter (acc in ('bridge_left', 'bridge_right')), 0)::bigint as bridge_broken,
  coalesce(sum(case when s = 'L' then a else -a end) filter (acc in ('bridge_left', 'bridge_right')), 0)::bigint as bridge_net from sd group by segment_id, currency)
"""
_REPORT_COLUMNS = ["segment_id", "currency", "expected_total", "right_total", "matched_left", "missing", "amount", "group_sum", "timing", "status", "duplicate", "extra", "matched_right", "currency_mismatch", "bridge_broken"]


@query(classified_sql() + _REPORT + "select " + ", ".join(_REPORT_COLUMNS) + ", 0::bigint as left_residual, 0::bigint as right_residual, true as balanced from rp")
def recon_conservation_report(spark, sf_dir):
    """AG5, SNK3: accounts and residuals by segment and currency."""
    return demo.run(spark, sf_dir).report.select(*_REPORT_COLUMNS, "left_residual", "right_residual", "balanced")


@query(f"with {records_sql()} select segment_id, currency, coalesce(sum(amt) filter (side = 'LEFT'), 0)::bigint as expected_total, coalesce(sum(amt) filter (side = 'RIGHT'), 0)::bigint as right_total, true as balanced from records group by segment_id, currency")
def recon_proven_totals(spark, sf_dir):
    """The report against independent sums of the records."""
    return demo.run(spark, sf_dir).proven.select("segment_id", "currency", "expected_total", "right_total", "balanced")


@query(classified_sql() + _REPORT + "select currency, bool_or(segment_id like 'SEG1%') as first_balanced, bool_or(segment_id like 'SEG2%') as second_balanced, sum(bridge_broken)::bigint as bridge_broken, count(*) = 2 as consistent from rp group by currency")
def recon_three_way_rollup(spark, sf_dir):
    """AG6, ST2."""
    out = views.three_way_rollup(demo.run(spark, sf_dir).report, "SEG1_MKT_ACCT", "SEG2_ACCT_CHANNEL")
    return out.select("currency", F.coalesce("first_balanced", F.lit(False)).alias("first_balanced"), F.coalesce("second_balanced", F.lit(False)).alias("second_balanced"), "bridge_broken", "consistent")


_TOLERANT = "case when raw_type = 'TIMING' then null when raw_type = 'AMOUNT_MISMATCH' and (abs(delta) <= 50 or abs(delta) * 10000 <= 1 * abs(expected)) then null else raw_type end"
_ENABLED = ("AMOUNT_MISMATCH", "BRIDGE_BROKEN", "CURRENCY_MISMATCH", "DUPLICATE", "EXTRA", "GROUP_SUM_MISMATCH", "MISSING", "STATUS_MISMATCH")


@query(classified_sql(_TOLERANT) + _TYPES)
def recon_tolerance(spark, sf_dir):
    """CL2, CL3: tolerances in minor units and basis points, with a type disabled."""
    return _types(demo.run(spark, sf_dir, rule=Rule("TOLERANCE", _ENABLED, 50, 1)).classified)


@query(classified_sql(_TOLERANT) + _TYPES)
def recon_policy_defaults(spark, sf_dir):
    """CL4: the default policies say the same as the tolerance evaluator."""
    return _types(demo.run(spark, sf_dir, rule=Rule("POLICY", _ENABLED, 50, 1)).classified)


@query(classified_sql("case when raw_type = 'GROUP_SUM_MISMATCH' and abs(delta) <= 100 then 'AMOUNT_MISMATCH' when raw_type = 'STATUS_MISMATCH' then null else raw_type end") + "select segment_id, type, fingerprint, delta from cl where type is not null")
def recon_policy_rules(spark, sf_dir):
    """CL4: suppression and retyping, which changes the fingerprint."""
    rules = (PolicyRule("type = 'GROUP_SUM_MISMATCH' and abs(delta) <= 100", "retype", "AMOUNT_MISMATCH", 10), PolicyRule("type = 'STATUS_MISMATCH'", "suppress"))
    return demo.run(spark, sf_dir, rule=Rule("POLICY", policies=rules)).discrepancies.select("segment_id", "type", "fingerprint", "delta")


@query(f"with {records_sql()} select segment_id, side, raw_ref, 'invalid money: currency ' || currency as reason from rejects")
def recon_rejects(spark, sf_dir):
    """SRC1, SRC5, SNK1, PRJ8."""
    return demo.run(spark, sf_dir).rejects.select("segment_id", "side", "raw_ref", "reason")


_HASH = "list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint), lambda a, b: (a * 31 + b) % 4294967296)"
_FLOOR = "(((case when h >= 2147483648 then h - 4294967296 else h end) % 64) + 64) % 64"


@query(f"with {records_sql()}, hs as (select *, {_HASH.format('group_key')} as h from records) select segment_id, side, raw_ref, match_key, group_key, ({_FLOOR})::int as bucket from hs")
def recon_standardized(spark, sf_dir):
    """PRJ1, PRJ2, PRJ4-PRJ6: stripped keys and buckets of all records."""
    return demo.run(spark, sf_dir).records.select("segment_id", "side", "raw_ref", "match_key", "group_key", "bucket")


@query(f"""with {records_sql()}, hs as (select *, {_HASH.format('group_key')} as h from records), bk as (select segment_id, ({_FLOOR})::int as bucket, count(*) as n from hs group by all)
select segment_id, bucket, n, max(n) over (partition by segment_id) as largest, n > 1.5 * avg(n) over (partition by segment_id) and n >= 10 as hot from bk""")
def recon_bucket_skew(spark, sf_dir):
    """AG9."""
    return views.bucket_skew(demo.run(spark, sf_dir).records, factor=1.5, least=10).select("segment_id", "bucket", "n", "largest", "hot")


def _scramble(x: str, factor: str, shift: int) -> str:
    y = f"xor({x}, {x} >> {shift})"
    return f"(({y}::hugeint * {factor}) % 4294967296)::bigint"


@query(f"""with h0 as (select o_orderkey as k, {_HASH.format("('O' || o_orderkey)")} as h from orders), h1 as (select k, {_scramble('h', '2146121005', 16)} as h from h0), h2 as (select k, {_scramble('h', '2221713035', 15)} as h from h1),
h3 as (select k, xor(h, h >> 16) as h from h2) select k as o_orderkey, (((case when h >= 2147483648 then h - 4294967296 else h end) % 8 + 8) % 8)::int as sub from h3""")
def recon_sub_index(spark, sf_dir):
    """PRJ7."""
    key = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    return _orders(spark, sf_dir).select("o_orderkey", sub_index_of(F.lit(None).cast("string"), key, 8).alias("sub"))


@query("""with k as (select user_id::varchar as match_key, count(distinct event_type) as n_groups from events group by 1)
select 'EVENTS' as segment_id, match_key, n_groups from k where n_groups > 1 order by n_groups desc, segment_id, match_key limit 101""")
def recon_refine_violations(spark, sf_dir):
    """AG10: users as match keys with several event types as group keys; the report lists the worst hundred."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return views.refine_violations(e.select(F.lit("EVENTS").alias("segment_id"), F.col("user_id").cast("string").alias("match_key"), F.col("event_type").alias("group_key")))


def _plain_records(spark, sf_dir) -> DataFrame:
    """Orders against their lines, one to many."""
    money = lambda c: F.round(F.col(c) * 100).cast("long")
    none = lambda t: F.lit(None).cast(t)
    left = _orders(spark, sf_dir).select(F.lit("LEFT").alias("side"), F.col("o_orderkey").cast("string").alias("match_key"), money("o_totalprice").alias("signed_amount_minor"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("raw_ref"))
    right = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("RIGHT"), F.col("l_orderkey").cast("string"), money("l_extendedprice"), F.concat_ws(":", F.lit("l"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))
    return left.union(right).select(F.lit("r").alias("run_id"), F.lit("LINES").alias("segment_id"), "side", "match_key", F.col("match_key").alias("group_key"), F.lit("USD").alias("currency"), "signed_amount_minor", none("long").alias("base_amount_minor"), F.lit("ISSUE").alias("entry_type"), none("string").alias("biz_status"), none("timestamp").alias("posting_time"), "raw_ref")


@query("""with r as (select 'L' as s, o_orderkey as k, round(o_totalprice * 100)::bigint as a from orders union all select 'R', l_orderkey, round(l_extendedprice * 100)::bigint from lineitem),
e as (select s, k, a, count(*) as n from r group by all), g as (select k, coalesce(sum(n) filter (s = 'L'), 0) as ln, coalesce(sum(n) filter (s = 'R'), 0) as rn, coalesce(sum(n * a) filter (s = 'L'), 0) as ls, coalesce(sum(n * a) filter (s = 'R'), 0) as rs, max(n) > 1 as dup from e group by k)
select case when rn = 0 then 'MISSING' when ln = 0 then 'EXTRA' when dup then 'DUPLICATE' when (ln > 1 or rn > 1) and ls <> rs then 'GROUP_SUM_MISMATCH' when ln > 1 or rn > 1 then 'CLEAN' when ls <> rs then 'AMOUNT_MISMATCH' else 'CLEAN' end as type,
count(*) as n_groups, sum(ls)::bigint as sum_left, sum(rs)::bigint as sum_right from g group by 1""")
def recon_one_to_many(spark, sf_dir):
    """JN1 on natural data: an order against all its lines."""
    groups = match_groups(identity_keys(_plain_records(spark, sf_dir)))
    return _types(classify(groups, {"LINES": Roles("ORDERS", "LINES")}, Rule(), scenario="LINES", period="all")).drop("segment_id")


@query("""with g as (select o_orderkey as k, round(o_totalprice * 100)::bigint as a from orders), c as (select *, k % 3 = 0 as fx, k % 11 <> 0 as based, k % 7 as d from g)
select case when fx and based and d <= 3 then 'CLEAN' when fx and based then 'FX_RATE_DIFF' when fx then 'CURRENCY_MISMATCH' else 'CLEAN' end as type, count(*) as n_groups, sum(a)::bigint as sum_left, sum(a)::bigint as sum_right from c group by 1""")
def recon_fx(spark, sf_dir):
    """CL1 rows 5 to 7, AG4: base amounts within and beyond a tolerance."""
    k, a = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    both = F.explode(F.array(F.struct(F.lit("LEFT").alias("side"), F.lit("USD").alias("currency"), F.when(k % 11 != 0, a).alias("base")), F.struct(F.lit("RIGHT").alias("side"), F.when(k % 3 == 0, "EUR").otherwise("USD").alias("currency"), F.when(k % 11 != 0, a + k % 7).alias("base"))))
    rows = _orders(spark, sf_dir).select(k.cast("string").alias("match_key"), a.alias("signed_amount_minor"), both.alias("x"))
    records = rows.select(F.lit("r").alias("run_id"), F.lit("FX").alias("segment_id"), "x.side", "match_key", F.col("match_key").alias("group_key"), "x.currency", "signed_amount_minor", F.col("x.base").alias("base_amount_minor"), F.lit("ISSUE").alias("entry_type"), F.lit(None).cast("string").alias("biz_status"), F.lit(None).cast("timestamp").alias("posting_time"), F.concat_ws(":", "x.side", "match_key").alias("raw_ref"))
    return _types(classify(match_groups(records), {"FX": Roles("MARKETING", "CHANNEL")}, Rule(fx_tolerance=3), scenario="FX", period="all")).drop("segment_id")


_TWO_RUNS = classified_sql() + ", x1 as (select fingerprint as f from cl where type is not null), x2 as (select f2.fingerprint as f from (" + classified_sql(dropped=7) + "select fingerprint from cl where type is not null) f2)"


@query(_TWO_RUNS + " select coalesce(x1.f, x2.f) as fingerprint, case when x2.f is null then 'vanished' when x1.f is null then 'new' else 'relinked' end as change from x1 full join x2 on x1.f = x2.f")
def recon_run_difference(spark, sf_dir):
    """ST4: fingerprints of two runs of which the second lacks some accounting rows."""
    return ledger.run_difference(*[_dealt(demo.run(spark, sf_dir, dropped=d).discrepancies.select("fingerprint")) for d in (0, 7)])


_DISPOSED = "case when substr(fingerprint, 1, 1) < '4' then 'RESOLVED' when substr(fingerprint, 1, 1) < '6' then 'CLOSED' when substr(fingerprint, 1, 1) = '6' then 'SUPPRESSED' when substr(fingerprint, 1, 1) = '7' then 'REOPENED' when substr(fingerprint, 1, 1) = '8' then 'STALE' end"


def _dispositions(d: DataFrame) -> DataFrame:
    return d.select("fingerprint", F.expr(_DISPOSED).alias("status"), F.expr("cast(ascii(substr(fingerprint, 2, 1)) % 4 as bigint)").alias("version"), F.lit("RUN0").alias("last_seen_run"), F.lit(None).cast("timestamp").alias("updated_at")).where("status is not null")


@query(_TWO_RUNS + f""", dp as (select x1.f as fingerprint, {_DISPOSED.replace('fingerprint', 'x1.f')} as status, (ascii(substr(x1.f, 2, 1)) % 4)::bigint as version from x1)
select fingerprint, case when status <> 'STALE' and x2.f is null then 'STALE' else status end as status, version + case when status <> 'STALE' and x2.f is null then 1 else 0 end as version,
case when status <> 'STALE' and x2.f is not null then 'RUN1' else 'RUN0' end as last_seen_run, case when status <> 'STALE' and x2.f is null then 'stale:' || fingerprint || ':' || version end as audit_key, case when status <> 'STALE' and x2.f is null then 'priorStatus=' || status || ',runId=RUN1' end as audit_payload from dp left join x2 on fingerprint = x2.f where status is not null""")
def recon_converge_dispositions(spark, sf_dir):
    """LC3, LC4, WN3, JN5."""
    # Fingerprints are stored before dispositions are made of them: each mention of one would hash it again.
    first, second = [_dealt(demo.run(spark, sf_dir, dropped=d).discrepancies.select("fingerprint")) for d in (0, 7)]
    return ledger.converge_dispositions(_dispositions(first), second, "RUN1")


@query(classified_sql() + f", d as (select fingerprint, {_DISPOSED} as s from cl where type is not null) select count(*) as n, count(*) filter (s is null or s = 'REOPENED') as n_open, count(*) filter (s = 'RESOLVED') as n_resolved, count(*) filter (s = 'CLOSED') as n_closed, count(*) filter (s = 'SUPPRESSED') as n_suppressed from d")
def recon_dashboard(spark, sf_dir):
    """AG8, JN6."""
    d = _dealt(demo.run(spark, sf_dir).discrepancies.select("fingerprint"))
    return views.dashboard_counts(d, _dealt(_dispositions(d)))


@query(classified_sql() + "select type, count(*) as n from cl where type is not null group by type")
def recon_type_counts(spark, sf_dir):
    """AG8."""
    return views.type_counts(demo.run(spark, sf_dir).discrepancies)


@query(classified_sql() + f", d as (select fingerprint, {_DISPOSED} as s from cl where type is not null) select '{demo.RUN}' as run_id, count(*) as n_discrepancies, count(*) filter (s is null or s = 'REOPENED') as n_open, true as balanced from d")
def recon_run_summary(spark, sf_dir):
    """AG7, LC2."""
    r = demo.run(spark, sf_dir)
    classified = _stored(r.classified, "classified")
    d, report = discrepancies(classified), conservation_report(classified)
    runs = ledger.finished(d.select("run_id").distinct(), report).where("status = 'COMPLETED'")
    return views.run_summary(runs.select("run_id"), d, _dispositions(d), report)


@query(classified_sql() + """select 'ledger:' || fingerprint as idempotency_key, 'ledger' as handler, null::bigint as amount_minor from cl where type is not null
union all select 'alert:' || fingerprint, 'alert', null from cl where type is not null and fingerprint >= '8'
union all select 'reversal-suggestion:' || fingerprint, 'reversal', delta from cl where type in ('AMOUNT_MISMATCH', 'GROUP_SUM_MISMATCH') and delta <> 0""")
def recon_handlers(spark, sf_dir):
    """LC6-LC9, SNK4, ST3: all handlers' rows, where some alerts exist already."""
    d = _found(spark, sf_dir)
    out = ledger.handle(d, {"alert": ledger.alert_outbox(d.where("fingerprint < '8'"))})
    pick = lambda n: out[n].select("idempotency_key", F.lit(n).alias("handler"), (F.col("amount_minor") if n == "reversal" else F.lit(None).cast("long")).alias("amount_minor"))
    return pick("ledger").union(pick("alert")).union(pick("reversal"))


_STATES = "case o_orderkey % 7 when 1 then 'RESOLVED' when 2 then 'CLOSED' when 3 then 'SUPPRESSED' when 4 then 'REOPENED' when 5 then 'STALE' end"
_ACTIONS = "case o_orderkey % 4 when 0 then 'RESOLVE' when 1 then 'CLOSE' when 2 then 'SUPPRESS' else 'REOPEN' end"


@query(f"""with o as (select o_orderkey as k, {_STATES} as st, {_ACTIONS} as a from orders), s as (select *, coalesce(st, 'OPEN') as cur, case when st is null then -1 else k % 3 end as v, case a when 'RESOLVE' then 'RESOLVED' when 'CLOSE' then 'CLOSED' when 'SUPPRESS' then 'SUPPRESSED' else 'REOPENED' end as goal from o),
r as (select *, case when k % 29 = 0 then 'invalid' when k % 31 = 0 then 'not_found' when k % 5 = 0 and v <> 0 then 'conflict' when goal = cur then 'noop' when a = 'REOPEN' and cur in ('RESOLVED', 'CLOSED', 'SUPPRESSED') or a = 'CLOSE' and cur <> 'CLOSED' or a in ('RESOLVE', 'SUPPRESS') and cur in ('OPEN', 'REOPENED', 'STALE') then 'accepted' else 'illegal' end as outcome from s)
select 'F' || k as fingerprint, a as action, outcome, case when outcome = 'accepted' then (v + 1)::bigint end as new_version, case when outcome = 'accepted' then 'manual:' || a || ':F' || k || ':' || (v + 1) end as audit_key from r""")
def recon_apply_dispositions(spark, sf_dir):
    """LC5."""
    o = _orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("fingerprint"), F.expr(_STATES).alias("status"), F.expr(_ACTIONS).alias("action"))
    k = F.col("o_orderkey")
    state = o.where("status is not null").select("fingerprint", "status", (k % 3).cast("long").alias("version"))
    requests = o.select("fingerprint", "action", F.when(k % 29 == 0, " ").otherwise("op").alias("operator"), F.lit("n").alias("note"), F.when(k % 5 == 0, F.lit(0)).cast("long").alias("expected_version"), k.alias("at"))
    return ledger.apply_dispositions(state, requests, o.where(k % 31 != 0)).select("fingerprint", "action", "outcome", "new_version", "audit_key")


@query("""with r as (select o_orderkey as k, case when o_orderkey % 53 = 0 then ' ' else 'S' || o_custkey % 5 end as sc, case when o_orderkey % 59 = 0 then 'soon' else strftime(o_orderdate, '%Y-%m-%d') end as p, case when o_orderkey % 61 = 0 then 5000 else 64 end as b from orders),
c as (select *, case when trim(sc) = '' then 'scenario is required' when p = 'soon' then 'period is not a date' when b > 4096 then 'buckets must be 1 to 4096' end as reason from r),
t as (select sc, p, 2 as top from r where k % 10 = 1 group by all), n as (select c.*, case when reason is null then coalesce(top, 0) + row_number() over (partition by c.sc, c.p, reason is null order by k) end as seq from c left join t on c.sc = t.sc and c.p = t.p)
select k as request_id, seq as sequence_no, case when reason is null then sc || ':' || p || ':' || seq end as run_id, reason from n""")
def recon_plan_runs(spark, sf_dir):
    """LC1, WN2: sequences of launch requests, after those of existing runs."""
    k = F.col("o_orderkey")
    r = _orders(spark, sf_dir).select(k.alias("request_id"), F.when(k % 53 == 0, " ").otherwise(F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string"))).alias("scenario"), F.when(k % 59 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("period"), F.when(k % 61 == 0, 5000).otherwise(64).alias("buckets"))
    runs = r.where(F.col("request_id") % 10 == 1).select("scenario", "period", F.lit(2).cast("long").alias("sequence_no")).distinct()
    return ledger.plan_runs(r, runs).select("request_id", "sequence_no", "run_id", "reason")


def _runs(spark, sf_dir) -> DataFrame:
    """A run for each order: the customer's group is the scenario, the month the period."""
    k = F.col("o_orderkey")
    status = F.when(k % 13 == 0, "FAILED").when(k % 7 == 0, "REPORT_IMBALANCE").otherwise("COMPLETED")
    return _orders(spark, sf_dir).select(F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("scenario"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), k.alias("sequence_no"), F.concat(F.lit("R"), k.cast("string")).alias("run_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderdate").cast("timestamp").alias("started_at"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(k % 600).cast("int"))).alias("finished_at"))


_RUNS = "with runs as (select 'S' || o_custkey % 5 as scenario, strftime(o_orderdate, '%Y-%m') as period, o_orderkey as sequence_no, 'R' || o_orderkey as run_id, case when o_orderkey % 13 = 0 then 'FAILED' when o_orderkey % 7 = 0 then 'REPORT_IMBALANCE' else 'COMPLETED' end as status, o_orderdate as created_at, o_orderkey % 600 as seconds from orders) "


@query(_RUNS + "select scenario, period, max(sequence_no) as sequence_no from runs group by all")
def recon_latest_runs(spark, sf_dir):
    """WN1."""
    return ledger.latest_runs(_runs(spark, sf_dir)).select("scenario", "period", "sequence_no")


@query(_RUNS + "select run_id, scenario, period, sequence_no from runs where scenario = 'S1' and status = 'COMPLETED' order by created_at desc, sequence_no desc, run_id desc limit 20 offset 20")
def recon_list_runs(spark, sf_dir):
    """SO1: the second page."""
    return views.list_runs(_runs(spark, sf_dir), scenario="S1", status="COMPLETED", page=1)[0].select("run_id", "scenario", "period", "sequence_no")


@query(_RUNS + "select scenario, status, count(*) as n, count(*) filter (status = 'FAILED') as n_failed, sum(seconds)::bigint as seconds from runs group by all")
def recon_run_metrics(spark, sf_dir):
    """AG11."""
    return views.run_metrics(_runs(spark, sf_dir))


@query(classified_sql() + f"select fingerprint, type, disposition from (select fingerprint, type, coalesce({_DISPOSED}, 'none') as disposition, {_ID} as discrepancy_id from cl where type = 'AMOUNT_MISMATCH' and {_DISPOSED} is null and (lower({_ID}) like '%c1_%' or lower(fingerprint) like '%c1_%' or lower(group_key) like '%c1_%' or lower(match_key) like '%c1_%' or lower(left_ref) like '%c1_%' or lower(right_ref) like '%c1_%')) order by discrepancy_id desc limit 50")
def recon_list_discrepancies(spark, sf_dir):
    """SO2: the first page of open amount mismatches that hold a text."""
    d = with_discrepancy_ids(_found(spark, sf_dir)).withColumn("updated_at", F.lit("2026-08-17").cast("timestamp"))
    runs = spark.createDataFrame([(demo.RUN, demo.SCENARIO, demo.PERIOD)], "run_id string, scenario string, period string")
    page, _ = views.list_discrepancies(views.enriched(d, _dispositions(d), runs), text="C1_", status="OPEN", type="AMOUNT_MISMATCH", size=50)
    return page.select("fingerprint", "type", F.coalesce("disposition", F.lit("none")).alias("disposition"))


@query(classified_sql() + f"select fingerprint, discrepancy_id from (select fingerprint, {_ID} as discrepancy_id, row_number() over (order by {_ID} desc) as nth from cl where type is not null) where nth > 300 and nth <= 350")
def recon_deep_page(spark, sf_dir):
    """SO2: a page far back, all of whose rows have one time; counts by cell find it. A page's size is the limit."""
    d = with_discrepancy_ids(_found(spark, sf_dir)).withColumns({"updated_at": F.lit("2026-08-17").cast("timestamp"), "disposed_at": F.lit(None).cast("timestamp"), "disposition": F.lit(None).cast("string")})
    return views.list_discrepancies(d, page=6, size=50)[0].select("fingerprint", "discrepancy_id")


@query(classified_sql() + f"""select fingerprint, pattern from cl, (select unnest(['c1_0', '1234', 'i%77', 'A-9']) as pattern) where type is not null and (lower({_ID}) like '%' || lower(pattern) || '%' or fingerprint like '%' || lower(pattern) || '%' or lower(group_key) like '%' || lower(pattern) || '%'
or coalesce(lower(match_key) like '%' || lower(pattern) || '%', false) or coalesce(lower(left_ref) like '%' || lower(pattern) || '%', false) or coalesce(lower(right_ref) like '%' || lower(pattern) || '%', false))""")
def recon_text_search(spark, sf_dir):
    """SO2: texts with wildcards looked up by an index of grams."""
    path = work_path(spark, "index")
    text_index.write_index(with_discrepancy_ids(demo.run(spark, sf_dir).discrepancies), path, parts=16)
    return reduce(DataFrame.union, [text_index.search(spark, path, p).select("fingerprint", F.lit(p).alias("pattern")) for p in ("c1_0", "1234", "i%77", "A-9")])


@query(f"with {records_sql()} select side, match_key, raw_ref from records where segment_id = 'SEG1_MKT_ACCT' and group_key = 'O100'")
def recon_group_records(spark, sf_dir):
    """SO3."""
    return views.group_records(demo.run(spark, sf_dir).records, demo.RUN, "SEG1_MKT_ACCT", "O100").select("side", "match_key", "raw_ref")


@query(classified_sql() + "select fingerprint, 1 as n_actions, (case when type in ('AMOUNT_MISMATCH', 'GROUP_SUM_MISMATCH') and delta <> 0 then 1 else 0 end) as n_reversals, 1 as n_alerts from cl where type is not null")
def recon_discrepancy_detail(spark, sf_dir):
    """SO4."""
    d = _found(spark, sf_dir)
    h = {n: t.withColumn("created_at", F.lit("2026-08-17").cast("timestamp")) for n, t in ledger.handle(d).items()}
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}")
    out = views.discrepancy_detail(d, h["ledger"], h["reversal"], h["alert"])
    return out.select("fingerprint", *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).alias(f"n_{c}") for c in ("actions", "reversals", "alerts")])


@query(classified_sql() + ", rk as (select segment_id, type, fingerprint, delta, row_number() over (partition by segment_id, type order by abs(delta) desc, fingerprint) as rank from cl where type is not null) select segment_id, type, fingerprint, delta, rank::int as rank from rk where rank <= 20")
def recon_worst_groups(spark, sf_dir):
    """The largest differences of each type."""
    return views.worst_groups(demo.run(spark, sf_dir).classified).select("segment_id", "type", "fingerprint", "delta", "rank")


_ALERT = "case o_orderkey % 4 when 0 then 'PENDING' when 1 then 'FAILED' when 2 then 'SENT' else 'PENDING' end"


@query(f"""with a as (select o_orderkey as k, {_ALERT} as st, (o_orderkey % 7)::int as att from orders)
select 'alert:' || k as idempotency_key, case when st <> 'SENT' and k % 3 = 0 then 'SENT' when st <> 'SENT' and k % 3 = 1 then 'FAILED' else st end as status, (att + case when st <> 'SENT' and k % 3 = 1 then 1 else 0 end)::int as attempt, st = 'PENDING' or st = 'FAILED' and att < 5 as due from a""")
def recon_alerts(spark, sf_dir):
    """LC10: which alerts are due, and their state after delivery."""
    k = F.col("o_orderkey")
    key = F.concat(F.lit("alert:"), k.cast("string")).alias("idempotency_key")
    a = _orders(spark, sf_dir).select(key, F.expr(_ALERT).alias("status"), (k % 7).cast("int").alias("attempt"), F.col("o_orderdate").alias("created_at"), k)
    results = a.where(k % 3 != 2).select("idempotency_key", (k % 3 == 0).alias("ok"))
    due = ledger.alerts_due(a).select("idempotency_key", F.lit(True).alias("due"))
    return ledger.alerts_after(a, results).join(due, "idempotency_key", "left").select("idempotency_key", "status", "attempt", F.coalesce("due", F.lit(False)).alias("due"))


@query("""with s as (select o_orderkey as k, case when o_orderkey % 5 = 4 then 'EXECUTED' else 'SUGGESTED' end as st from orders), d as (select *, case when st = 'SUGGESTED' and k % 3 = 0 then 'CONFIRMED' when st = 'SUGGESTED' and k % 3 = 1 then 'DISCARDED' else st end as s2 from s),
e as (select *, case when s2 = 'CONFIRMED' and k % 2 = 0 then 'EXECUTED' when s2 = 'CONFIRMED' and k % 7 = 0 then 'EXECUTION_FAILED' else s2 end as s3 from d)
select 'reversal-suggestion:' || k as idempotency_key, s3 as status, ((s2 <> st)::int + (s3 <> s2)::int)::bigint as version from e""")
def recon_reversals(spark, sf_dir):
    """LC11."""
    k = F.col("o_orderkey")
    s = _orders(spark, sf_dir).select(k, F.concat(F.lit("reversal-suggestion:"), k.cast("string")).alias("idempotency_key"), F.when(k % 5 == 4, "EXECUTED").otherwise("SUGGESTED").alias("status"), F.lit(None).cast("string").alias("note"), F.lit(0).cast("long").alias("version"))
    decided = ledger.decide_reversals(s, s.where(k % 3 != 2).select("idempotency_key", (k % 3 == 0).alias("approved"), F.lit("n").alias("note")))
    results = s.where((k % 2 == 0) | (k % 7 == 0)).select("idempotency_key", (k % 2 == 0).alias("ok"))
    return ledger.settle_reversals(decided, results).select("idempotency_key", "status", "version")


_REM = "case o_orderkey % 5 when 0 then 'PROPOSED' when 1 then 'APPROVED' when 2 then 'DISPATCHING' when 3 then 'UNKNOWN' else 'SUCCEEDED' end"
_STEP = "case o_orderkey % 6 when 0 then 'APPROVE' when 1 then 'REJECT' when 2 then 'DISPATCH' when 3 then 'SUCCEEDED' when 4 then 'FAILED' else 'UNKNOWN' end"


@query(f"""with r as (select o_orderkey as k, {_REM} as st, {_STEP} as a, o_orderkey % 11 = 0 as manual from orders), g as (select *, case a when 'APPROVE' then 'APPROVED' when 'REJECT' then 'REJECTED' when 'DISPATCH' then 'DISPATCHING' else a end as goal from r)
select 'S' || k as suggestion_id, a as action, case when a = 'APPROVE' and k % 13 = 0 then 'invalid' when goal = st then 'noop' when manual and a = 'APPROVE' then 'illegal' when st = 'PROPOSED' and a in ('APPROVE', 'REJECT') or st = 'APPROVED' and a = 'DISPATCH' or st in ('DISPATCHING', 'UNKNOWN') and a in ('SUCCEEDED', 'FAILED', 'UNKNOWN') then 'accepted' else 'illegal' end as outcome from g""")
def recon_remediation(spark, sf_dir):
    """LC12."""
    k = F.col("o_orderkey")
    o = _orders(spark, sf_dir).select(k, F.concat(F.lit("S"), k.cast("string")).alias("suggestion_id"))
    state = o.select("suggestion_id", F.expr(_REM).alias("status"), F.lit(0).cast("long").alias("version"), F.when(k % 11 == 0, "MANUAL_REVIEW").otherwise("REISSUE").alias("action"))
    requests = o.select("suggestion_id", F.expr(_STEP).alias("action"), F.lit(None).cast("long").alias("expected_version"), k.alias("at"), F.when(k % 13 == 0, " ").otherwise("REF").alias("approval_ref"))
    return ledger.step_remediations(state, requests).select("suggestion_id", "action", "outcome")


_HELD = """with c as (select o_orderkey as k, (1 + o_orderkey % 12)::int as att, case o_orderkey % 5 when 0 then 'PUBLISHED' when 1 then 'DEAD' else 'SENDING' end as st, case when o_orderkey % 5 > 1 then 'w' || o_orderkey % 3 end as own from orders),
r as (select *, st = 'SENDING' and own = 'w1' as mine, k % 2 = 0 as ok from c)"""


def _held(spark, sf_dir):
    """Commands of which most are held by one of three workers, and worker w1's results for all of them."""
    k, now = F.col("o_orderkey"), F.lit("2026-08-17").cast("timestamp")
    status = F.when(k % 5 == 0, "PUBLISHED").when(k % 5 == 1, "DEAD").otherwise("SENDING")
    none = lambda kind: F.lit(None).cast(kind)
    commands = _orders(spark, sf_dir).select(
        k, F.lit("T").alias("tenant_id"), F.concat(F.lit("C"), k.cast("string")).alias("command_id"), F.concat(F.lit("S"), k.cast("string")).alias("suggestion_id"), status.alias("status"), (1 + k % 12).cast("int").alias("attempt"),
        none("timestamp").alias("next_attempt"), F.when(k % 5 > 1, F.concat(F.lit("w"), (k % 3).cast("string"))).alias("lease_owner"), F.when(k % 5 > 1, now + F.expr("interval 1 minute")).alias("lease_until"), none("timestamp").alias("published_at"), none("string").alias("last_error"), now.alias("created_at"),
    )
    results = commands.select("tenant_id", "command_id", F.lit("w1").alias("worker"), (k % 2 == 0).alias("ok"), F.lit("e").alias("error"), now.alias("at"))
    return commands, results, now


@query(_HELD + """ select 'C' || k as command_id, case when not mine then st when ok then 'PUBLISHED' when att >= 10 then 'DEAD' else 'FAILED' end as status, att as attempt, case when mine then null else own end as lease_owner,
case when mine and not ok then least(300, (2 ^ least(att, 8)))::bigint end as wait, case when not mine then 'lost' when ok then 'published' when att >= 10 then 'dead' else 'failed' end as outcome from r""")
def recon_command_outbox(spark, sf_dir):
    """LC13: publication, backoff and dead letters; results count only from the worker that holds the lease."""
    commands, results, now = _held(spark, sf_dir)
    after, outcomes = outbox.settle_commands(commands, results, now)
    wait = F.unix_timestamp("next_attempt") - F.unix_timestamp(now)
    return after.join(outcomes.select("command_id", "outcome"), "command_id").select("command_id", "status", "attempt", "lease_owner", wait.alias("wait"), "outcome")


@query(_HELD + """, s as (select *, case k % 4 when 3 then 'REJECTED' else 'APPROVED' end as sug from r), t as (select *, mine and ok and sug = 'APPROVED' as gone from s)
select 'C' || k as command_id, case when not mine then st when gone then 'PUBLISHED' when att >= 10 then 'DEAD' else 'FAILED' end as status, case when gone then 'DISPATCHING' else sug end as suggestion, case when gone then 1 else 0 end::bigint as version,
case when mine and not gone then case when ok then 'the suggestion can''t be dispatched: illegal' else 'e' end end as last_error from t""".replace("k % 4 when 3", "(k // 2) % 4 when 3"))
def recon_relay(spark, sf_dir):
    """LC13, LC12: a published command dispatches its suggestion in the same step, or counts as failed."""
    commands, results, now = _held(spark, sf_dir)
    k = F.col("o_orderkey")
    suggestions = _orders(spark, sf_dir).select(F.concat(F.lit("S"), k.cast("string")).alias("suggestion_id"), F.when(F.floor(k / 2) % 4 == 3, "REJECTED").otherwise("APPROVED").alias("status"), F.lit(0).cast("long").alias("version"))
    after, dispatched, _ = outbox.relay(commands, suggestions, results, now)
    return after.join(dispatched.withColumnsRenamed({"status": "suggestion"}), "suggestion_id").select("command_id", "status", "suggestion", "version", "last_error")


_OBSERVED = """select 'T' || k % 3 as tenant_id, 'I' || k as issue_id, role, event, sku, q, st, ref from (select *, unnest([{'role': 'EXPECTED', 'event': 'e' || k, 'sku': p, 'q': 1 + k % 5, 'st': 'EXPECTED', 'ref': null, 'keep': k % 17 <> 0},
 {'role': 'INTERNAL', 'event': 'i' || k, 'sku': p, 'q': 1 + k % 5, 'st': case when k % 19 = 0 then 'REVERSED' else 'ISSUED' end, 'ref': 'r' || k, 'keep': k % 11 <> 0},
 {'role': 'INTERNAL', 'event': 'i' || k, 'sku': p, 'q': 1 + k % 5, 'st': 'ISSUED', 'ref': 'r' || k, 'keep': k % 23 = 0 and k % 19 <> 0},
 {'role': 'PROVIDER', 'event': 'p' || k, 'sku': case when k % 29 = 0 then 'other' else p end, 'q': 1 + k % 5 + case when k % 31 = 0 then 1 else 0 end, 'st': case when k % 37 = 0 then 'UNKNOWN' when k % 41 = 0 then 'FAILED' else 'ISSUED' end, 'ref': case when k % 43 = 0 then 'x' else 'r' || k end, 'keep': k % 13 <> 0}], recursive := true) from (select o_orderkey as k, o_orderpriority as p from orders)) where keep"""


_ENTITLEMENT = f"""with ob as ({_OBSERVED}), ev as (select tenant_id, issue_id, role, event, count(*) as n, sum(case when st in ('REVERSED', 'FAILED') then 0 else q end) as q from ob group by all),
g as (select tenant_id, issue_id, count(*) filter (role = 'INTERNAL') as i_n, count(*) filter (role = 'PROVIDER') as p_n, coalesce(sum(q) filter (role = 'EXPECTED'), 0) as e, coalesce(sum(q) filter (role = 'INTERNAL'), 0) as i, coalesce(sum(q) filter (role = 'PROVIDER'), 0) as p,
 coalesce(max(n) filter (role = 'INTERNAL') > 1, false) as ir, coalesce(max(n) filter (role = 'PROVIDER') > 1, false) as pr from ev group by all),
s as (select tenant_id, issue_id, count(distinct sku) as skus, count(distinct st) filter (role <> 'EXPECTED' and st <> 'UNKNOWN') as sts, count(*) filter (role <> 'EXPECTED' and st = 'UNKNOWN') as unk,
 list_sort(list(distinct ref) filter (role = 'INTERNAL')) as irf, list_sort(list(distinct ref) filter (role = 'PROVIDER')) as prf from ob group by all),
l as (select tenant_id, issue_id, list_filter([case when i_n = 0 and e > 0 then 'MISSING_INTERNAL' end, case when p_n = 0 and e > 0 then 'MISSING_PROVIDER' end, case when e = 0 and i > 0 then 'EXTRA_INTERNAL' end, case when e = 0 and p > 0 then 'EXTRA_PROVIDER' end, case when ir then 'DUPLICATE_INTERNAL' end, case when pr then 'DUPLICATE_PROVIDER' end,
 case when not (e = i and i = p) then 'QUANTITY_MISMATCH' end, case when skus > 1 then 'SKU_MISMATCH' end, case when sts > 1 then 'STATUS_MISMATCH' end, case when irf is not null and prf is not null and irf <> prf then 'PROVIDER_REFERENCE_MISMATCH' end, case when unk > 0 then 'UNKNOWN' end], lambda x: x is not null) as labels from g join s using (tenant_id, issue_id))
select tenant_id, issue_id, case when len(labels) = 0 then 'CLEAN' else array_to_string(labels, ',') end as labels from l"""


def _observations(spark, sf_dir) -> DataFrame:
    """Observations of three roles for every order."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    text = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    row = lambda role, event, sku, q, st, ref, keep: F.when(keep, F.struct(F.lit(role).alias("role"), text(event, k).alias("event_id"), sku.alias("sku_id"), q.cast("long").alias("quantity"), st.alias("status"), ref.cast("string").alias("provider_ref")))
    q, r = 1 + k % 5, text("r", k)
    rows = F.array(
        row("EXPECTED", "e", p, q, F.lit("EXPECTED"), F.lit(None), k % 17 != 0), row("INTERNAL", "i", p, q, F.when(k % 19 == 0, "REVERSED").otherwise("ISSUED"), r, k % 11 != 0), row("INTERNAL", "i", p, q, F.lit("ISSUED"), r, (k % 23 == 0) & (k % 19 != 0)),
        row("PROVIDER", "p", F.when(k % 29 == 0, "other").otherwise(p), q + (k % 31 == 0).cast("int"), F.when(k % 37 == 0, "UNKNOWN").when(k % 41 == 0, "FAILED").otherwise("ISSUED"), F.when(k % 43 == 0, "x").otherwise(r), k % 13 != 0),
    )
    return _orders(spark, sf_dir).select(text("T", k % 3).alias("tenant_id"), text("I", k).alias("issue_id"), F.explode(F.array_compact(rows)).alias("x")).select("tenant_id", "issue_id", "x.*", F.concat_ws(":", "issue_id", "x.role").alias("raw_ref"))


@query(_ENTITLEMENT)
def recon_entitlement(spark, sf_dir):
    """JN7, CL8: labels of every issue."""
    valid, _ = entitlement.split_observations(_observations(spark, sf_dir))
    return entitlement.entitlement_labels(entitlement.entitlement_groups(valid)).select("tenant_id", "issue_id", F.array_join("labels", ",").alias("labels"))


def _event_json(spark, sf_dir, only: int | None = None) -> DataFrame:
    """The events table as fulfillment events: some cash, some broken, some sent again with equal or other content; ``only`` those sent a time, as far as one is named."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    cash = k % 4 == 0
    fact = F.when(k % 3 == 0, "EXPECTED").when(k % 3 == 1, "INTERNAL").otherwise("PROVIDER")

    def body(quantity):
        payload = F.struct(
            fact.alias("factType"), F.when(cash, "CASH").otherwise("GOODS").alias("benefitType"), F.concat(F.lit("A"), k.cast("string")).alias("awardItemNo"), F.concat(F.lit("O"), F.col("user_id").cast("string")).alias("awardOrderNo"),
            F.when(~cash, F.col("event_type")).alias("skuId"), F.when(~cash, quantity.cast("long")).alias("quantity"), F.lit("SUCCEEDED").alias("status"), F.when(cash | (k % 41 == 0), "EUR").alias("currency"), F.when(cash, (k % 1000).cast("long")).alias("amountMinor"), F.when(cash, "ISSUE").alias("entryType"),
        )
        return F.to_json(F.struct(F.concat(F.lit("ev"), k.cast("string")).alias("eventId"), F.concat(F.lit("FULFILLMENT_"), F.when(k % 37 == 0, "X").otherwise(fact)).alias("eventType"), F.when(k % 43 == 0, "2.0").otherwise("1.1").alias("schemaVersion"), F.lit("T1").alias("tenantId"), F.lit("2026-08-17T00:00:00Z").alias("occurredAt"), payload.alias("payload")))

    sent = [(F.lit(True), body(k % 7 + 1)), (k % 97 == 0, body(k % 7 + 1)), ((k % 89 == 0) & ~cash, body(k % 7 + 2))]
    if only is not None:
        when, value = sent[only]
        return e.where(when).select(F.lit(only).alias("seen"), value.alias("value"))
    times = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(i).alias("seen"), value.alias("value"))) for i, (when, value) in enumerate(sent)]))
    return e.select(F.explode(times).alias("x")).select("x.*")


_EVENTS = """with b as (select event_id as k, event_id % 4 = 0 as cash, case event_id % 3 when 0 then 'EXPECTED' when 1 then 'INTERNAL' else 'PROVIDER' end as fact from events),
ev as (select *, 0 as seen from b union all select *, 1 from b where k % 97 = 0 union all select *, 2 from b where k % 89 = 0 and not cash),
r as (select *, case when k % 43 = 0 then 'schemaVersion is not 1' when k % 37 = 0 then 'eventType and factType differ' when not cash and k % 41 = 0 then 'an entitlement event has currency or amount' end as reason,
 case when cash and fact = 'INTERNAL' then 'CASH_EXPECTED' when cash and fact = 'PROVIDER' then 'CASH_CHANNEL' when not cash then 'ENTITLEMENT_' || fact end as t from ev),
f as (select *, case when reason is null then t end as target from r) """


@query(_EVENTS + "select 'ev' || k as event_id, target, reason, cash and fact = 'EXPECTED' as skipped from f")
def recon_routed_events(spark, sf_dir):
    """SM5, SRC6: target or reject reason of every event."""
    return ev.routed(_event_json(spark, sf_dir)).select("event_id", "target", "reason", "skipped")


@query(_EVENTS + "select 'ev' || k as event_id, target, case when seen = 0 then 'claimed' when seen = 1 then 'replay' else 'conflict' end as outcome from f where target is not null")
def recon_claimed_events(spark, sf_dir):
    """SM4: replays and conflicts."""
    rows = ev.routed(_event_json(spark, sf_dir), carry=["seen"]).where("target is not null")
    inbox = spark.createDataFrame([], ev.INBOX)
    return ev.claim(rows, inbox, "c").select("event_id", "target", "outcome")


@query()
def recon_csv_source(spark, sf_dir):
    """SRC2, SRC3: the marketing ledger written as CSV, some amounts spoilt, and read again."""
    path = work_path(spark, "csv")
    m = demo.ledgers(spark, sf_dir)["marketing"]
    instant = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    m = m.select("id", "order_no", "issue_id", "ccy", F.when(F.col("id").endswith("97"), "not-long").otherwise(F.col("amount_minor").cast("string")).alias("amount_minor"), "entry_type", "biz_status", instant("biz_time"), instant("posting_time"))
    m.write.option("header", True).csv(path)
    ctx = ReadContext(demo.RUN, "SEG1_MKT_ACCT", "LEFT", "MARKETING")
    records, rejects = read_csv_source(spark, path, SourceMapping("marketing", match_key="issue_id", group_key="order_no"), ctx)
    good = records.select(strip_trailing(F.col("match_key")).alias("match_key"), "group_key", "currency", "signed_amount_minor", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(rejects.select(F.lit(None).cast("string").alias("match_key"), F.lit(None).cast("string").alias("group_key"), F.lit(None).cast("string").alias("currency"), F.lit(None).cast("long").alias("signed_amount_minor"), "reason"))


ORACLE_SQL["recon_csv_source"] = f"with {records_sql()} select case when id like '%97' then null else issue_id end as match_key, case when id like '%97' then null else order_no end as group_key, case when id like '%97' then null else ccy end as currency, case when id like '%97' then null else amt end as signed_amount_minor, case when id like '%97' then 'not a signed long: not-long' end as reason from marketing"


@query()
def recon_stream(spark, sf_dir):
    """SM1, SM2: the ledgers' records as a file stream with daily windows; a last record far ahead closes them all."""
    root = work_path(spark, "stream")
    r = demo.run(spark, sf_dir)
    records = r.records.where("biz_time is not null").drop("bucket")
    last = records.limit(1).withColumns({"biz_time": F.lit("2999-01-01").cast("timestamp"), "raw_ref": F.lit("end"), "match_key": F.lit("end"), "group_key": F.lit("end")})
    records.write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    roles = {s.id: s.roles() for s in r.scenario.segments}
    for part in (None, last):
        if part is not None:
            part.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(schema).parquet(f"{root}/in")
        reconcile.reconcile_windows(source, f"{root}/t", roles, Rule(), scenario=demo.SCENARIO, period=demo.PERIOD, checkpoint=f"{root}/check", by="year").awaitTermination()
    return spark.read.parquet(f"{root}/t/discrepancies").select("segment_id", "fingerprint", "type", "match_key", "group_key", "currency", "expected", "actual", "delta")


ORACLE_SQL["recon_stream"] = classified_sql() + "select segment_id, fingerprint, type, match_key, group_key, currency, expected, actual, delta from cl where type is not null"


@query(_EVENTS + """select 'fact' as part, target as what, count(*) as n from f where target is not null and seen = 0 group by all
union all select 'reject', coalesce(reason, 'conflicting content'), count(*) from f where reason is not null or target is not null and seen = 2 group by all""")
def recon_event_stream(spark, sf_dir):
    """SM4, SM5 over three micro-batches: the events, replays and conflicts among them later; the inbox is state. Each claimed event is stored once, and no reject is lost."""
    root = work_path(spark, "events")
    for seen in range(3):
        _event_json(spark, sf_dir, seen).select("value").write.mode("append").text(f"{root}/in")
        ev.ingest_stream(spark.readStream.schema("value string").text(f"{root}/in"), f"{root}/out", f"{root}/check").awaitTermination()
    stored, refused = (spark.read.parquet(f"{root}/out/{t}") for t in ("facts", "rejects"))
    return stored.groupBy(F.lit("fact").alias("part"), F.col("target").alias("what")).agg(F.count("*").alias("n")).unionByName(refused.groupBy(F.lit("reject").alias("part"), F.col("reason").alias("what")).agg(F.count("*").alias("n")))


def _end(records: DataFrame) -> DataFrame:
    """A record far ahead, which closes every window and lets every timer run out."""
    return records.limit(1).withColumns({"biz_time": F.lit("2999-01-01").cast("timestamp"), "raw_ref": F.lit("end"), "match_key": F.lit("end"), "group_key": F.lit("end")})


@query(ORACLE_SQL["recon_match_groups"])
def recon_keyed_stream(spark, sf_dir):
    """SM7: groups come out when they balance or when their timers run out, over a restart; the last of each is the batch run's."""
    root = work_path(spark, "keyed")
    keyed.use_rocksdb(spark)
    records = demo.run(spark, sf_dir).records.select(*reconcile.GROUPED)
    size = None
    for part in (records, _end(records)):
        part.write.mode("append").option("compression", "zstd").parquet(f"{root}/in")
        source = spark.readStream.schema(records.schema).parquet(f"{root}/in")
        # The stream keeps for life what it began with.
        size = size or keyed.sized(spark.read.parquet(f"{root}/in").count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
        batches.run_batches(keyed.keyed_groups(source, slots=size[0]), lambda df, i: batches.write_batch(df, f"{root}/groups", i), f"{root}/check", partitions=size[1]).awaitTermination()
    out = keyed.latest_groups(spark.read.parquet(f"{root}/groups"))
    return out.select("segment_id", "match_key", "null_ref", "group_key", "left_count", "right_count", "left_sum", "right_sum", "left_currency", "right_currency", "left_ref", "right_ref", "left_status", "right_status", "left_copies", "right_copies", "presence")


@query(f"""with {records_sql()}, r as (select *, raw_ref like '%7' as untimed, case when raw_ref like 'marketing:m2-%' then 'CHF' else currency end as ccy from records), t as (select * from r where not untimed),
m as (select segment_id, match_key, null_ref from t group by all having count(distinct case when side = 'LEFT' then ccy end) > 1 or count(distinct case when side = 'RIGHT' then ccy end) > 1),
x as (select t.*, m.segment_id is not null as mixed from t left join m on t.segment_id = m.segment_id and t.match_key is not distinct from m.match_key and t.null_ref is not distinct from m.null_ref)
select 'no event time' as part, segment_id, count(*)::bigint as n from r where untimed group by all union all select case when mixed then 'several currencies on one side of its group' else 'grouped' end, segment_id, count(*)::bigint from x group by all""")
def recon_lossless_stream(spark, sf_dir):
    """AG3, SM1 in micro-batches: every row is in a group or among the rejects, those without a time and those of mixed groups included."""
    root = work_path(spark, "lossless")
    r = demo.run(spark, sf_dir)
    records = r.records.drop("bucket").withColumns({"biz_time": F.when(~F.col("raw_ref").endswith("7"), F.col("biz_time")), "currency": F.when(F.col("raw_ref").startswith("marketing:m2-"), "CHF").otherwise(F.col("currency"))})
    roles = {s.id: s.roles() for s in r.scenario.segments}
    schema = batches.ddl(records)
    for part in (records, _end(records)):
        part.write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(records.schema).parquet(f"{root}/in")
        reconcile.land(source, f"{root}/t", f"{root}/check-land", by="year").awaitTermination()
        reconcile.reconcile_landed(spark, f"{root}/t", schema, roles, Rule(), scenario=demo.SCENARIO, period=demo.PERIOD, checkpoint=f"{root}/check").awaitTermination()
    groups = reconcile.current_groups(spark, f"{root}/t").groupBy(F.lit("grouped").alias("part"), "segment_id").agg(F.sum(F.col("left_count") + F.col("right_count")).alias("n"))
    return groups.unionByName(reconcile.all_rejects(spark, f"{root}/t").groupBy(F.col("reason").alias("part"), "segment_id").agg(F.count("*").alias("n")))


@query(classified_sql() + "select segment_id, match_key, null_ref, left_count, right_count, left_sum, right_sum, type, fingerprint from cl")
def recon_late_repair(spark, sf_dir):
    """SM2: a third of the rows comes after its windows have closed; the repair recomputes the groups that lack rows, and all equals the batch run."""
    root = work_path(spark, "late")
    r = demo.run(spark, sf_dir)
    records = r.records.select(*reconcile.GROUPED)
    late = F.crc32(F.col("raw_ref").cast("binary")) % 3 == 0
    roles = {s.id: s.roles() for s in r.scenario.segments}
    schema = batches.ddl(records)
    rest = {"scenario": demo.SCENARIO, "period": demo.PERIOD}
    for part in (records.where(~late), _end(records), records.where(late)):
        part.write.mode("append").option("compression", "zstd").parquet(f"{root}/in")
        source = spark.readStream.schema(records.schema).parquet(f"{root}/in")
        reconcile.land(source, f"{root}/t", f"{root}/check-land", by="year").awaitTermination()
        reconcile.reconcile_landed(spark, f"{root}/t", schema, roles, Rule(), checkpoint=f"{root}/check", **rest).awaitTermination()
    reconcile.repair(spark, f"{root}/t", schema, roles, Rule(), name="one", **rest)
    return reconcile.current_groups(spark, f"{root}/t").select("segment_id", "match_key", "null_ref", "left_count", "right_count", "left_sum", "right_sum", "type", "fingerprint")


# Written runs.

_REPORT_KEY = "segment_id || '|' || currency"


@query(classified_sql() + _REPORT + f"""select 'discrepancies' as part, {_ID} as key, delta as value from cl where type is not null
union all select 'report', {_REPORT_KEY}, expected_total from rp union all select 'rejects', raw_ref, null from rejects
union all select 'records', 'all', count(*) from records union all select 'status', 'COMPLETED', null
union all select 'ledger', 'ledger:' || fingerprint, null from cl where type is not null""")
def recon_written_run(spark, sf_dir):
    """SNK1-SNK5, LC2, LC6: a run's tables as written and read back."""
    t = write_run(demo.run(spark, sf_dir), work_path(spark, "run"))
    row = lambda part, key, value=None: [F.lit(part).alias("part"), key.alias("key"), (F.lit(None) if value is None else value).cast("long").alias("value")]
    parts = [
        t["discrepancies"].select(*row("discrepancies", F.col("discrepancy_id"), F.col("delta"))), t["report"].where("balanced").select(*row("report", F.concat_ws("|", "segment_id", "currency"), F.col("expected_total"))),
        t["rejects"].select(*row("rejects", F.col("raw_ref"))), t["records"].agg(F.count("*").alias("n")).select(*row("records", F.lit("all"), F.col("n"))), t["status"].select(*row("status", F.col("status"))), t["ledger"].select(*row("ledger", F.col("idempotency_key"))),
    ]
    return reduce(DataFrame.union, parts)


@query(_TWO_RUNS + " select 'discrepancies' as part, f as key from x1 union all select 'ledger', 'ledger:' || f from (select f from x1 union select f from x2)")
def recon_rerun(spark, sf_dir):
    """LC3, SNK4, SNK5: a run carried out twice, the first time without some rows; machine tables are replaced, ledgers grow."""
    root = work_path(spark, "rerun")
    write_run(demo.run(spark, sf_dir, dropped=7), root)
    t = write_run(demo.run(spark, sf_dir), root)
    return t["discrepancies"].select(F.lit("discrepancies").alias("part"), F.col("fingerprint").alias("key")).union(t["ledger"].select(F.lit("ledger"), "idempotency_key"))


@query(_TWO_RUNS + f""", dp as (select x1.f as fingerprint, {_DISPOSED.replace('fingerprint', 'x1.f')} as status, 0::bigint as version, case when ascii(substr(x1.f, 3, 1)) % 2 = 0 then 'MINE' else 'OTHER' end as scenario from x1),
rs as (select * from (values ('RUN1'), ('RUN2')) t(run_id))
select run_id, fingerprint, case when run_id = 'RUN2' and scenario = 'MINE' and status <> 'STALE' and x2.f is null then 'STALE' else status end as status, version + case when run_id = 'RUN2' and scenario = 'MINE' and status <> 'STALE' and x2.f is null then 1 else 0 end as version,
case when run_id = 'RUN2' and scenario = 'MINE' and status <> 'STALE' and x2.f is not null then 'RUN2' else 'RUN0' end as last_seen_run from dp cross join rs left join x2 on fingerprint = x2.f where status is not null""")
def recon_converge_latest(spark, sf_dir):
    """LC4: two runs of a scenario and period, of which only the latest changes dispositions, and only those of its scenario."""
    first, second = [_dealt(demo.run(spark, sf_dir, dropped=d).discrepancies.select("fingerprint")) for d in (0, 7)]
    scenario = F.when(F.ascii(F.substring("fingerprint", 3, 1)) % 2 == 0, "MINE").otherwise("OTHER")
    state = _dispositions(first).withColumns({"scenario": scenario, "period": F.lit("P"), "version": F.lit(0).cast("long")})
    runs = spark.createDataFrame([("RUN1", "MINE", "P", 1), ("RUN2", "MINE", "P", 2)], "run_id string, scenario string, period string, sequence_no long")
    out = [ledger.converge_dispositions(state, second, run, runs).select(F.lit(run).alias("run_id"), "fingerprint", "status", "version", "last_seen_run") for run in ("RUN1", "RUN2")]
    return out[0].union(out[1])


# Sources and guards.

@query("""select 'orders:' || o_orderkey as raw_ref, 'K' || o_orderkey as match_key, 'G' || o_orderkey // 4 as group_key, round(o_totalprice * 100)::bigint as amount from orders where o_orderkey % 3 = 1 and o_orderdate <= timestamp '1995-06-30 00:00:00'""")
def recon_filtered_source(spark, sf_dir):
    """PRJ9, PRJ10, EX2: rows of one tenant up to a cutoff, with keys from expressions."""
    k = F.col("o_orderkey")
    o = _orders(spark, sf_dir).select(k.alias("id"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("tenant_id"), F.lit("USD").alias("ccy"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_minor"), F.col("o_orderdate").alias("posting_time"))
    mapping = SourceMapping("orders", entry_type=None, biz_status=None, biz_time=None, tenant="tenant_id", match_expr="concat('K', id)", group_expr="concat('G', cast(floor(id / 4) as string))")
    records, _ = read_table_source(o, mapping, ReadContext("r", "S", "LEFT", "ORDERS", cutoff="1995-06-30", tenant_id="T1"))
    return records.select("raw_ref", "match_key", "group_key", F.col("signed_amount_minor").alias("amount"))


@query(ORACLE_SQL["recon_filtered_source"].replace("'orders:' || o_orderkey", "o_orderkey::varchar"))
def recon_csv_filtered(spark, sf_dir):
    """SRC2, PRJ9, PRJ10, EX2: the same filters and keys over CSV files."""
    path = work_path(spark, "csv-filtered")
    k = F.col("o_orderkey")
    o = _orders(spark, sf_dir).select(k.alias("id"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("tenant_id"), F.lit(" usd").alias("ccy"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_minor"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("posting_time"))
    o.write.option("header", True).csv(path)
    mapping = SourceMapping("orders", entry_type=None, biz_status=None, biz_time=None, tenant="tenant_id", match_expr="concat('K', id)", group_expr="concat('G', cast(floor(cast(id as bigint) / 4) as string))")
    records, _ = read_csv_source(spark, path, mapping, ReadContext("r", "S", "LEFT", "ORDERS", cutoff="1995-06-30", tenant_id="T1"))
    return records.select(F.substring_index("raw_ref", ":", -1).alias("raw_ref"), "match_key", "group_key", F.col("signed_amount_minor").alias("amount"))


@query("""select o_orderkey % 4 + 1 as n_lines, count(*) as n_rows, sum(round(o_totalprice * 100)::bigint)::bigint as amount, sum((o_orderkey % 4) * 5 + 2)::bigint as sum_status, true as gapless from orders group by 1""")
def recon_csv_ranges(spark, sf_dir):
    """SRC3: rows with quoted line ends, of one to four lines, put together across tasks and named by their first and last line."""
    path = work_path(spark, "csv-ranges")
    k = F.col("o_orderkey")
    status = F.concat(F.repeat(F.lit('a"b,\n'), (k % 4).cast("int")), F.lit("xy"))
    _orders(spark, sf_dir).select(k.alias("id"), k.alias("key"), F.lit("USD").alias("ccy"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_minor"), status.alias("biz_status")).write.option("header", True).option("escape", '"').csv(path)
    mapping = SourceMapping("orders", match_key="key", group_key="key", entry_type=None, biz_time=None, posting_time=None)
    records, _ = read_csv_source(spark, path, mapping, ReadContext("r", "S", "LEFT", "ORDERS"), lineage="line", multi_line=True)
    parts = F.split(F.substring_index("raw_ref", ":", -1), "-")
    rows = records.select(F.substring_index("raw_ref", ":", 2).alias("file"), parts[0].cast("long").alias("lo"), F.get(parts, F.size(parts) - 1).cast("long").alias("hi"), "signed_amount_minor", F.length("biz_status").alias("n_status"))
    files = rows.groupBy("file").agg((F.max("hi") == F.sum(F.col("hi") - F.col("lo") + 1) + 1).alias("whole")).agg(F.bool_and("whole").alias("gapless"))
    out = rows.groupBy((F.col("hi") - F.col("lo") + 1).alias("n_lines")).agg(F.count("*").alias("n_rows"), F.sum("signed_amount_minor").alias("amount"), F.sum("n_status").alias("sum_status"))
    return out.crossJoin(F.broadcast(files))  # files has one row


@query("""with l as (select 'l-' || o_orderkey as id, o_orderkey as k, 'USD' as ccy, round(o_totalprice * 100)::bigint as a from orders union all select 'l2-' || o_orderkey, o_orderkey, 'EUR', 5 from orders where o_orderkey % 10 = 0),
r as (select 'r-' || o_orderkey as id, o_orderkey as k, 'USD' as ccy, round(o_totalprice * 100)::bigint as a from orders)
select 'reject' as part, 'left:' || id as key, 'several currencies on one side of its group' as reason, null::bigint as amount from l where k % 10 = 0 union all select 'reject', 'right:' || id, 'several currencies on one side of its group', null from r where k % 10 = 0
union all select 'reject', 'o:' || o_orderkey, 'match key without group key', null from orders where o_orderkey % 9 = 0 union all select 'total', 'USD', null, sum(a)::bigint from l where k % 10 <> 0""")
def recon_quarantine(spark, sf_dir):
    """AG3, PRJ5: records of groups with mixed currencies, and match keys without a group key, become rejects; the report holds without them."""
    k, amount = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    row = lambda p, ccy, a: F.struct(F.concat(F.lit(p), k.cast("string")).alias("id"), F.lit(ccy).alias("ccy"), a.alias("amount_minor"))
    table = lambda *rows: _orders(spark, sf_dir).select(k.cast("string").alias("key"), F.explode(F.array_compact(F.array(*rows))).alias("x")).select("key", "x.*")
    mapping = lambda name: SourceMapping(name, match_key="key", group_key="key", entry_type=None, biz_status=None, biz_time=None, posting_time=None)
    scenario = Scenario("MIXED", (Segment("S", "ORDERS", "PAYMENTS", Source("memory", "left", mapping("left")), Source("memory", "right", mapping("right"))),))
    tables = {"left": table(row("l-", "USD", amount), F.when(k % 10 == 0, row("l2-", "EUR", F.lit(5).cast("long")))), "right": table(row("r-", "USD", amount))}
    r = Reconciliation(spark, scenario, "MIXED:1", "all", tables, on_mixed="quarantine")
    broken = _plain_records(spark, sf_dir).where("side = 'LEFT'").withColumn("group_key", F.when(F.col("match_key").cast("long") % 9 != 0, F.col("group_key"))).withColumn("payload", F.lit(None).cast("string"))
    none = F.lit(None).cast("long").alias("amount")
    rejects = r.rejects.select(F.lit("reject").alias("part"), F.col("raw_ref").alias("key"), "reason", none).union(broken_rejects(broken).select(F.lit("reject"), "raw_ref", "reason", none))
    return rejects.union(r.proven.where("balanced").select(F.lit("total"), "currency", F.lit(None).cast("string"), "expected_total"))


_WINNING = "case when raw_type = 'AMOUNT_MISMATCH' then null when raw_type = 'STATUS_MISMATCH' then 'TIMING' when raw_type = 'DUPLICATE' and delta <> 0 then 'GROUP_SUM_MISMATCH' else raw_type end"


@query(classified_sql(_WINNING) + "select segment_id, type, fingerprint, delta from cl where type is not null")
def recon_policy_suppression(spark, sf_dir):
    """CL4: a disabled type stays suppressed although a rule of higher salience retypes it; facts in predicates."""
    enabled = tuple(t for t in (*_ENABLED, "TIMING") if t != "AMOUNT_MISMATCH")
    rules = (PolicyRule("type in ('AMOUNT_MISMATCH', 'STATUS_MISMATCH')", "retype", "TIMING", 200), PolicyRule("multi_line and type = 'DUPLICATE' and abs_delta > 0", "retype", "GROUP_SUM_MISMATCH", 5))
    return demo.run(spark, sf_dir, rule=Rule("POLICY", enabled, policies=rules)).discrepancies.select("segment_id", "type", "fingerprint", "delta")


if "ONE_SIDED" not in EVALUATORS:
    register_evaluator("ONE_SIDED", lambda groups, rule: F.when(F.col("presence") != "BOTH", F.col("type")))


@query(classified_sql("case when presence <> 'BOTH' then raw_type end") + "select 'notice:' || fingerprint as idempotency_key, type from cl where type is not null")
def recon_registered_parts(spark, sf_dir):
    """EX3-EX5: an evaluator and a handler of the user's own, with the registered match strategy."""
    d = demo.run(spark, sf_dir, rule=Rule("ONE_SIDED")).discrepancies
    notice = ("notice", lambda d: d.select(F.concat(F.lit("notice:"), "fingerprint").alias("idempotency_key"), "type"))
    return ledger.handle(d, handlers=[notice])["notice"]


@query(classified_sql(only="o_orderkey % 3 = 1") + _TYPES)
def recon_benefit_cash(spark, sf_dir):
    """EX7, PRJ10: the three-way scenario of one tenant's cash tables."""
    scenario = benefit_cash_three_way("T1")
    tables = dict(zip(("recon_ods_cash_expected", "recon_ods_cash_accounting", "recon_ods_cash_channel"), demo.ledgers(spark, sf_dir).values()))
    number = F.regexp_extract("id", "-([0-9]+)$", 1).cast("long")
    tables = {n: t.withColumn("tenant_id", F.concat(F.lit("T"), (number % 3).cast("string"))) for n, t in tables.items()}
    return _types(Reconciliation(spark, scenario, "BENEFIT_CASH_3WAY:1", demo.PERIOD, tables).classified)


@query(ORACLE_SQL["recon_entitlement"].replace("from l", "from l where tenant_id = 'T1'"))
def recon_entitlement_scenario(spark, sf_dir):
    """EX7: the entitlement scenario of one tenant, run through its sources: a table for each role."""
    obs, root = _observations(spark, sf_dir), work_path(spark, "sides")
    for role in ("EXPECTED", "INTERNAL", "PROVIDER"):
        obs.where(F.col("role") == role).drop("role").write.parquet(f"{root}/{role}")
    scenario = entitlement_fulfillment("parquet", "T1", tuple(f"{root}/{role}" for role in ("EXPECTED", "INTERNAL", "PROVIDER")))
    return scenario.reconcile(spark)[0].select("tenant_id", "issue_id", F.array_join("labels", ",").alias("labels"))


@query(f"with {records_sql()} select count(*) as n, count(*) as n_refs, true as gapless from marketing")
def recon_csv_lines(spark, sf_dir):
    """SRC3: a ledger in CSV files, its rows named by file and line."""
    path = work_path(spark, "csv")
    demo.ledgers(spark, sf_dir)["marketing"].select("id", "order_no", "issue_id", "ccy", F.col("amount_minor").cast("string").alias("amount_minor")).repartition(3).write.option("header", True).csv(path)
    mapping = SourceMapping("marketing", match_key="issue_id", group_key="order_no", entry_type=None, biz_status=None, biz_time=None, posting_time=None)
    records, _ = read_csv_source(spark, path, mapping, ReadContext(demo.RUN, "SEG1_MKT_ACCT", "LEFT", "MARKETING"), lineage="line")
    parts = records.select("raw_ref", F.regexp_extract("raw_ref", "^(.*):([0-9]+)$", 1).alias("file"), F.regexp_extract("raw_ref", ":([0-9]+)$", 1).cast("long").alias("number"))
    # A reference is a file and a number, so the references of a file are as many as its distinct numbers: the bits set in bitmaps of 32,768 numbers each.
    bits = parts.groupBy("file", F.bitmap_bucket_number("number").alias("bucket")).agg(F.count("*").alias("n"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("number"))).alias("n_refs"), F.min("number").alias("lo"), F.max("number").alias("hi"))
    files = bits.groupBy("file").agg(F.sum("n").alias("n"), F.sum("n_refs").alias("n_refs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return files.agg(F.sum("n").alias("n"), F.sum("n_refs").alias("n_refs"), F.bool_and((F.col("lo") == 2) & (F.col("hi") - 1 == F.col("n"))).alias("gapless"))


def _read_priority_lines(spark, path, mapping, ctx):
    """A reader of our own: lines of id=amount."""
    parts = F.split("value", "=")
    rows = spark.read.text(path).select(parts[0].alias("id"), parts[0].alias("key"), F.lit("USD").alias("ccy"), parts[1].cast("long").alias("amount_minor"))
    return read_table_source(rows, mapping, ctx)


def _match_without_case(records: DataFrame) -> DataFrame:
    """A strategy of our own: keys that differ in case only match."""
    return match_groups(records.withColumns({"match_key": F.lower("match_key"), "group_key": F.lower("group_key")}), on_mixed="mark")


register_source("priority-lines", _read_priority_lines)
register_strategy("without-case", _match_without_case)


@query("""select case when o_orderkey % 7 = 0 then 'AMOUNT_MISMATCH' else 'CLEAN' end as type, count(*) as n_groups, sum(round(o_totalprice * 100)::bigint)::bigint as sum_left, sum(round(o_totalprice * 100)::bigint + case when o_orderkey % 7 = 0 then 1 else 0 end)::bigint as sum_right from orders group by 1""")
def recon_own_reader_and_strategy(spark, sf_dir):
    """EX1, EX3: a registered reader and a registered match strategy in a run."""
    path, k = work_path(spark, "lines"), F.col("o_orderkey")
    amount = F.round(F.col("o_totalprice") * 100).cast("long")
    _orders(spark, sf_dir).select(F.concat(F.lit("K"), k.cast("string"), F.lit("="), (amount).cast("string"))).write.text(path)
    right = _orders(spark, sf_dir).select(F.concat(F.lit("k"), k.cast("string")).alias("id"), F.concat(F.lit("k"), k.cast("string")).alias("key"), F.lit("USD").alias("ccy"), (amount + F.when(k % 7 == 0, 1).otherwise(0)).alias("amount_minor"))
    bare = {"match_key": "key", "group_key": "key", "entry_type": None, "biz_status": None, "biz_time": None, "posting_time": None}
    sides = Source("priority-lines", path, SourceMapping("lines", **bare)), Source("parquet", _written_path(right), SourceMapping("right", **bare))
    r = Reconciliation(spark, Scenario("OWN", (Segment("OWN", "MARKETING", "CHANNEL", *sides, strategy="without-case"),)), "OWN:1", "p")
    return _types(r.classified).drop("segment_id")


# Views and lifecycles.

@query(_RUNS + "select status, count(*) as n from runs group by status")
def recon_run_status_counts(spark, sf_dir):
    """AG8."""
    return views.run_status_counts(_runs(spark, sf_dir))


@query(_RUNS + "select run_id, scenario, period from runs order by created_at desc, sequence_no desc, run_id desc limit 5")
def recon_latest_five(spark, sf_dir):
    """AG8: the five latest runs."""
    return views.list_runs(_runs(spark, sf_dir), size=5)[0].select("run_id", "scenario", "period")


@query(_RUNS + "select count(*) as total from runs where status = 'FAILED'")
def recon_run_totals(spark, sf_dir):
    """SO1: the total that goes with a page."""
    return views.list_runs(_runs(spark, sf_dir), status="FAILED")[1]


@query(classified_sql() + _REPORT + "select segment_id, currency, expected_total, right_total from rp order by segment_id, currency")
def recon_run_detail(spark, sf_dir):
    """SO5."""
    return views.run_detail(demo.run(spark, sf_dir).report, demo.RUN).select("segment_id", "currency", "expected_total", "right_total")


@query("select 'S' || o_custkey % 50 as code, max(o_orderkey)::bigint as version, max(o_orderkey) % 2 = 0 as enabled from orders group by 1 order by 1")
def recon_scenario_list(spark, sf_dir):
    """SO6."""
    s = _orders(spark, sf_dir).groupBy(F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string")).alias("code")).agg(F.max("o_orderkey").cast("long").alias("version"))
    return views.scenario_list(s.withColumn("enabled", F.col("version") % 2 == 0))


@query("select 'F' || o_orderkey as fingerprint, (o_orderkey % 4)::bigint as version, 's' || o_orderkey % 4 as status from orders")
def recon_latest_dispositions(spark, sf_dir):
    """WN3: the newest row of each key in a log of one to four versions."""
    k = F.col("o_orderkey")
    log = _orders(spark, sf_dir).select(F.concat(F.lit("F"), k.cast("string")).alias("fingerprint"), F.explode(F.sequence(F.lit(0).cast("long"), (k % 4).cast("long"))).alias("version"))
    return ledger.latest(log.withColumn("status", F.concat(F.lit("s"), F.col("version").cast("string"))), ["fingerprint"])


_COMMANDS = """with c0 as (select o_orderkey as k, 'C' || o_orderkey as command_id, case o_orderkey % 4 when 0 then 'PENDING' when 1 then 'FAILED' when 2 then 'SENDING' else 'PUBLISHED' end as status, case when o_orderkey % 5 = 0 then null else o_orderkey % 7 - 3 end as late, o_orderdate as created_at from orders),
c as (select *, status = 'SENDING' and k % 8 < 4 as expired from c0), d as (select *, (status in ('PENDING', 'FAILED') or expired) and coalesce(late <= 0, true) as due from c),
t as (select *, due and row_number() over (partition by due order by created_at, command_id) <= 100 as taken from d) """


def _commands(spark, sf_dir):
    """Commands of all statuses; a fifth has no time of a next attempt, and half of the leases have run out."""
    k, now = F.col("o_orderkey"), F.lit("2026-08-17").cast("timestamp")
    status = F.when(k % 4 == 0, "PENDING").when(k % 4 == 1, "FAILED").when(k % 4 == 2, "SENDING").otherwise("PUBLISHED")
    shifted = lambda hours: now + F.make_dt_interval(hours=hours.cast("int"))
    lease = F.when(k % 4 == 2, F.when(k % 8 < 4, shifted(F.lit(-1))).otherwise(shifted(F.lit(1))))
    return _orders(spark, sf_dir).select(
        F.lit("T").alias("tenant_id"), F.concat(F.lit("C"), k.cast("string")).alias("command_id"), status.alias("status"), F.lit(0).alias("attempt"), F.when(k % 5 != 0, shifted(k % 7 - 3)).alias("next_attempt"),
        F.when(k % 4 == 2, "other").alias("lease_owner"), lease.alias("lease_until"), F.col("o_orderdate").alias("created_at"),
    ), now


@query(_COMMANDS + "select command_id, status from c where status in ('PENDING', 'FAILED') and coalesce(late <= 0, true) order by created_at, command_id limit 100")
def recon_due_commands(spark, sf_dir):
    """LC13: what is due, commands without a time of a next attempt among them; the limit is the size of a relay pass."""
    commands, now = _commands(spark, sf_dir)
    return outbox.due(commands, now).select("command_id", "status")


@query(_COMMANDS + "select command_id, case when expired then 'FAILED' else status end as status, case when status = 'SENDING' and not expired then 'other' end as lease_owner from c")
def recon_expired_leases(spark, sf_dir):
    """LC13: a lease that has run out makes its command fail, without an owner."""
    commands, now = _commands(spark, sf_dir)
    return outbox.release_expired(commands, now).select("command_id", "status", "lease_owner")


@query(_COMMANDS + """select command_id, case when taken then 'SENDING' when expired then 'FAILED' else status end as status, taken::int as attempt, case when taken then 'me' when status = 'SENDING' and not expired then 'other' end as lease_owner,
case when taken then 60 when status = 'SENDING' and not expired then 3600 end::bigint as lease_seconds from t""")
def recon_claim_commands(spark, sf_dir):
    """LC13: a worker's pass takes what is due, expired leases among it, for a minute."""
    commands, now = _commands(spark, sf_dir)
    out = outbox.claim_commands(commands, "me", now)
    return out.select("command_id", "status", "attempt", "lease_owner", (F.unix_timestamp("lease_until") - F.unix_timestamp(now)).alias("lease_seconds"))


@query("""select 'reversal-exec-' || case when o_orderkey % 2 = 0 then 'ok:' else 'fail:' end || 'R' || o_orderkey as idempotency_key, 'F' || o_orderkey as fingerprint, case when o_orderkey % 2 = 0 then 'executed ref=' else 'execution failed: ' end || 'x' || o_orderkey as payload
from orders where o_orderkey % 3 = 0""")
def recon_reversal_audit(spark, sf_dir):
    """LC11: audit rows of executions, failed ones included."""
    k = F.col("o_orderkey")
    s = _orders(spark, sf_dir).select(k, F.concat(F.lit("R"), k.cast("string")).alias("idempotency_key"), F.concat(F.lit("F"), k.cast("string")).alias("fingerprint"), F.when(k % 3 == 0, "CONFIRMED").otherwise("SUGGESTED").alias("status"))
    results = s.select("idempotency_key", (k % 2 == 0).alias("ok"), F.concat(F.lit("x"), k.cast("string")).alias("reference"))
    return ledger.reversal_audit(s, results).select("idempotency_key", "fingerprint", "payload")


# Streams.

@query("""with r as (select o_orderkey as k, case o_orderkey % 4 when 0 then 'DISPATCHING' when 1 then 'UNKNOWN' when 2 then 'SUCCEEDED' else 'PROPOSED' end as st, case when o_orderkey % 3 = 0 then 'FAILED' else 'SUCCEEDED' end as a from orders)
select 'e' || k as event_id, case when k % 11 = 0 then 'rejected' when k % 17 = 0 then 'replay' when k % 19 = 0 then 'conflict' when k % 13 = 0 then 'acknowledged' when k % 23 = 0 then 'not_found' when st = a then 'noop' when st in ('DISPATCHING', 'UNKNOWN') then 'accepted' else 'illegal' end as outcome from r""")
def recon_result_events(spark, sf_dir):
    """SM6: result events through the inbox to the remediation lifecycle."""
    k = F.col("o_orderkey")
    text = lambda p, c=None: F.concat(F.lit(p), (k if c is None else c).cast("string"))
    o = _orders(spark, sf_dir)
    status = F.when(k % 4 == 0, "DISPATCHING").when(k % 4 == 1, "UNKNOWN").when(k % 4 == 2, "SUCCEEDED").otherwise("PROPOSED")
    state = o.select(text("S").alias("suggestion_id"), status.alias("status"), F.lit(0).cast("long").alias("version"), F.lit("REISSUE").alias("action"))
    commands = o.where(k % 23 != 0).select(text("T", k % 3).alias("tenant_id"), text("c").alias("command_id"), text("S").alias("suggestion_id"))
    payload = F.struct(text("c").alias("externalCommandId"), F.when(k % 3 == 0, "FAILED").otherwise("SUCCEEDED").alias("status"))
    kind = F.when(k % 13 == 0, "REMEDIATION_DISPATCHED").otherwise("REMEDIATION_RESULT")
    events = o.select(k, F.to_json(F.struct(text("e").alias("eventId"), kind.alias("eventType"), F.when(k % 11 == 0, "2").otherwise("1.0").alias("schemaVersion"), text("T", k % 3).alias("tenantId"), payload.alias("payload"))).alias("value"))
    seen = events.where((k % 17 == 0) | (k % 19 == 0)).select(text("T", k % 3).alias("tenant_id"), F.lit("recon-benefit-remediation-result-v1").alias("consumer"), text("e").alias("event_id"), F.when(k % 17 == 0, F.sha2("value", 256)).otherwise("other").alias("hash"))
    return ev.settle_results(events, state, commands, seen.where("event_id is not null"))[1]


@query(_EVENTS.replace("else 'PROVIDER' end as fact", "else 'ACCOUNTING' end as fact").replace("cash and fact = 'PROVIDER' then 'CASH_CHANNEL'", "cash and fact = 'ACCOUNTING' then 'CASH_ACCOUNTING'").replace("when not cash and k % 41", "when not cash and fact = 'ACCOUNTING' then 'factType is not known' when not cash and k % 41") + "select 'ev' || k as event_id, target, reason from f where seen = 0")
def recon_direct_replay(spark, sf_dir):
    """SM5: a replay by hand, which may fill the accounting table."""
    raw = _event_json(spark, sf_dir).where("seen = 0").withColumn("value", F.replace("value", F.lit("PROVIDER"), F.lit("ACCOUNTING")))
    return ev.routed(raw, direct=True).select("event_id", "target", "reason")


@query(classified_sql() + "select fingerprint, kind, case kind when 'sliding' then 2 else 1 end::bigint as n_windows from cl, (select unnest(['sliding', 'session']) as kind) where type is not null")
def recon_stream_windows(spark, sf_dir):
    """SM3: sliding windows of two days, in which every group comes twice, and sessions of one hour."""
    root = work_path(spark, "windows")
    r = demo.run(spark, sf_dir)
    records = r.records.select(*reconcile.GROUPED)
    records.write.option("compression", "zstd").parquet(f"{root}/in")
    last = records.limit(1).withColumns({"biz_time": F.lit("2999-01-01").cast("timestamp"), "raw_ref": F.lit("end"), "match_key": F.lit("end"), "group_key": F.lit("end")})
    last.write.mode("append").parquet(f"{root}/in")
    roles = {s.id: s.roles() for s in r.scenario.segments}
    source = spark.readStream.schema(records.schema).parquet(f"{root}/in")
    out = []
    for kind, window in (("sliding", {"size": "2 days", "slide": "1 day"}), ("session", {"gap": "1 hour"})):
        reconcile.reconcile_windows(source, f"{root}/{kind}", roles, Rule(), scenario=demo.SCENARIO, period=demo.PERIOD, checkpoint=f"{root}/check-{kind}", by="year", **window).awaitTermination()
        out.append(spark.read.parquet(f"{root}/{kind}/discrepancies").groupBy("fingerprint").agg(F.lit(kind).alias("kind"), F.count("*").alias("n_windows")))
    return out[0].union(out[1])


@query(f"with {records_sql()} select segment_id, side, raw_ref from records")
def recon_kept_raw(spark, sf_dir):
    """SM2: every input row is kept, whatever the watermark."""
    root = work_path(spark, "raw")
    records = demo.run(spark, sf_dir).records.drop("bucket")
    records.write.parquet(f"{root}/in")
    reconcile.keep_raw(spark.readStream.schema(records.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/check").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("segment_id", "side", "raw_ref")
