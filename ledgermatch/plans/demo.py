"""Three ledgers derived from the orders table by fixed rules, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.classify import Rule
from .pipeline import Reconciliation
from .scenario import marketing_three_way

SCENARIO, PERIOD, RUN = "MARKETING_3WAY", "2026-08-17", "MARKETING_3WAY:2026-08-17:1"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amt"), F.when(k % 5 == 0, "EUR").otherwise("USD").alias("base_ccy"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("at"), F.concat(F.lit("O"), F.floor(k / 4).cast("string")).alias("order_no"), F.concat(F.lit("I"), k.cast("string")).alias("issue"), F.concat(F.lit("C"), k.cast("string")).alias("serial"),
    )


def _later(k: Column) -> Column:
    return F.when(k % 37 == 0, F.col("at") + F.expr("interval 1 day")).otherwise(F.col("at"))


def ledgers(spark: SparkSession, sf_dir: str, *, dropped: int = 0) -> dict[str, DataFrame]:
    """marketing, accounting and channel; ``dropped`` > 0 leaves out the accounting rows of the keys that it divides."""
    b, k = _base(spark, sf_dir), F.col("k")
    status = F.when(k % 31 == 0, "X").otherwise(F.col("status"))
    shared = [F.col("at").alias("biz_time")]
    rows = F.array(
        F.struct(F.lit("m-").alias("p"), F.col("amt").alias("a"), F.lit("ISSUE").alias("e")),
        F.when(k % 19 == 0, F.struct(F.lit("m2-").alias("p"), F.col("amt").alias("a"), F.lit("ISSUE").alias("e"))),
        F.when(k % 23 == 0, F.struct(F.lit("m3-").alias("p"), F.lit(-100).cast("long").alias("a"), F.lit("REFUND").alias("e"))),
    )
    # The absent ones are left out behind explode: array_compact is interpreted, and keeps explode from being compiled.
    marketing = b.where(k % 41 != 0).withColumn("x", F.explode(rows)).where("x is not null").select(
        F.concat("x.p", k.cast("string")).alias("id"), "order_no", F.when(k % 11 == 0, F.concat("issue", F.lit("  "))).otherwise(F.col("issue")).alias("issue_id"), F.col("base_ccy").alias("ccy"),
        F.col("x.a").alias("amount_minor"), F.col("x.e").alias("entry_type"), F.col("status").alias("biz_status"), *shared, F.col("at").alias("posting_time"),
    )
    less = F.when(k % 17 == 0, -100)
    accounting = b.where((k % 13 != 0) & (F.lit(True) if not dropped else k % dropped != 0)).select(
        F.concat(F.lit("a-"), k.cast("string")).alias("id"), "order_no", F.when(k % 43 != 0, F.col("issue")).alias("issue_id"), F.col("serial").alias("channel_serial_no"),
        F.when(k % 29 == 0, "JPY").when(k % 101 == 0, "US").otherwise(F.col("base_ccy")).alias("ccy"), (F.col("amt") + less.otherwise(0)).alias("amount_minor"), F.lit("ISSUE").alias("entry_type"), status.alias("biz_status"), *shared, _later(k).alias("posting_time"),
    )
    channel = b.where(k % 47 != 0).select(
        F.concat(F.lit("c-"), k.cast("string")).alias("id"), F.col("serial").alias("channel_serial_no"), F.when(k % 29 == 0, "JPY").otherwise(F.col("base_ccy")).alias("ccy"),
        (F.col("amt") + less.when(k % 53 == 0, 1).otherwise(0)).alias("amount_minor"), F.lit("ISSUE").alias("entry_type"), status.alias("biz_status"), *shared, _later(k).alias("posting_time"),
    )
    return {"marketing": marketing, "accounting": accounting, "channel": channel}


def run(spark: SparkSession, sf_dir: str, *, rule: Rule | None = None, run_id: str = RUN, dropped: int = 0) -> Reconciliation:
    from dataclasses import replace

    scenario = marketing_three_way()
    if rule is not None:
        scenario = replace(scenario, segments=tuple(replace(s, rule=rule) for s in scenario.segments))
    return Reconciliation(spark, scenario, run_id, PERIOD, ledgers(spark, sf_dir, dropped=dropped))


def records_sql(dropped: int = 0, only: str = "true") -> str:
    """Common table expressions b, marketing, accounting, channel, raw, rejects and records."""
    extra = f" and k % {dropped} <> 0" if dropped else ""
    return f"""
b as (select o_orderkey as k, cast(round(o_totalprice * 100) as bigint) as amt, case when o_orderkey % 5 = 0 then 'EUR' else 'USD' end as base_ccy, o_orderstatus as st,
      cast(o_orderdate as timestamp) as ts, 'O' || cast(o_orderkey // 4 as varchar) as order_no, 'I' || o_orderkey as issue, 'C' || o_orderkey as serial from orders where {only}),
m0 as (select 'm-' || k as id, amt as a, 'ISSUE' as e, * from b where k % 41 <> 0 union all select 'm2-' || k, amt, 'ISSUE', * from b where k % 41 <> 0 and k % 19 = 0
       union all select 'm3-' || k, -100, 'REFUND', * from b where k % 41 <> 0 and k % 23 = 0),
marketing as (select id, order_no, rtrim(issue || case when k % 11 = 0 then '  ' else '' end) as issue_id, base_ccy as ccy, a as amt, e as entry_type, st, ts as posted from m0),
accounting as (select 'a-' || k as id, order_no, case when k % 43 <> 0 then issue end as issue_id, serial, case when k % 29 = 0 then 'JPY' when k % 101 = 0 then 'US' else base_ccy end as ccy,
       amt + case when k % 17 = 0 then -100 else 0 end as amt, 'ISSUE' as entry_type, case when k % 31 = 0 then 'X' else st end as st, ts + case when k % 37 = 0 then interval 1 day else interval 0 day end as posted from b where k % 13 <> 0{extra}),
channel as (select 'c-' || k as id, serial, case when k % 29 = 0 then 'JPY' else base_ccy end as ccy, amt + case when k % 17 = 0 then -100 when k % 53 = 0 then 1 else 0 end as amt,
       'ISSUE' as entry_type, case when k % 31 = 0 then 'X' else st end as st, ts + case when k % 37 = 0 then interval 1 day else interval 0 day end as posted from b where k % 47 <> 0),
raw as (select 'SEG1_MKT_ACCT' as segment_id, 'LEFT' as side, issue_id as match_key, order_no as group_key, ccy as currency, amt, entry_type, st, posted, 'marketing:' || id as raw_ref from marketing
  union all select 'SEG1_MKT_ACCT', 'RIGHT', issue_id, order_no, ccy, amt, entry_type, st, posted, 'accounting:' || id from accounting
  union all select 'SEG2_ACCT_CHANNEL', 'LEFT', serial, serial, ccy, amt, entry_type, st, posted, 'accounting:' || id from accounting
  union all select 'SEG2_ACCT_CHANNEL', 'RIGHT', serial, serial, ccy, amt, entry_type, st, posted, 'channel:' || id from channel),
rejects as (select * from raw where length(currency) <> 3),
records as (select *, case when match_key is null then side || ':' || raw_ref end as null_ref from raw where length(currency) = 3)"""


GROUPS_SQL = """,
eq as (select segment_id, match_key, null_ref, side, currency, entry_type, amt, count(*) as n, sum(amt) as s, min(group_key) as group_key, min(raw_ref) as ref, min(st) as st, min(posted) as posted
       from records group by all),
gr as (select segment_id, match_key, null_ref, min(group_key) as group_key,
  coalesce(sum(n) filter (side = 'LEFT'), 0)::bigint as left_count, coalesce(sum(n) filter (side = 'RIGHT'), 0)::bigint as right_count,
  coalesce(sum(s) filter (side = 'LEFT'), 0)::bigint as left_sum, coalesce(sum(s) filter (side = 'RIGHT'), 0)::bigint as right_sum,
  min(currency) filter (side = 'LEFT') as left_currency, min(currency) filter (side = 'RIGHT') as right_currency,
  min(ref) filter (side = 'LEFT') as left_ref, min(ref) filter (side = 'RIGHT') as right_ref, min(st) filter (side = 'LEFT') as left_status, min(st) filter (side = 'RIGHT') as right_status,
  min(posted) filter (side = 'LEFT') as left_posted, min(posted) filter (side = 'RIGHT') as right_posted,
  coalesce(max(n) filter (side = 'LEFT') > 1, false) as left_copies, coalesce(max(n) filter (side = 'RIGHT') > 1, false) as right_copies
  from eq group by segment_id, match_key, null_ref),
cl0 as (select *, case when right_count = 0 then 'LEFT_ONLY' when left_count = 0 then 'RIGHT_ONLY' else 'BOTH' end as presence,
  case when right_count = 0 and segment_id = 'SEG1_MKT_ACCT' then 'BRIDGE_BROKEN' when right_count = 0 then 'MISSING'
       when left_count = 0 and segment_id = 'SEG2_ACCT_CHANNEL' then 'BRIDGE_BROKEN' when left_count = 0 then 'EXTRA'
       when left_currency <> right_currency then 'CURRENCY_MISMATCH' when left_copies or right_copies then 'DUPLICATE'
       when (left_count > 1 or right_count > 1) and left_sum <> right_sum then 'GROUP_SUM_MISMATCH' when left_count > 1 or right_count > 1 then null
       when left_sum <> right_sum then 'AMOUNT_MISMATCH' when left_status <> right_status then 'STATUS_MISMATCH' when cast(left_posted as date) <> cast(right_posted as date) then 'TIMING' end as raw_type from gr),
"""


def classified_sql(kept: str = "raw_type", dropped: int = 0, only: str = "true") -> str:
    """A with clause up to ``cl``, the classified groups; ``kept`` is the type that the rule leaves of raw_type."""
    return f"""with {records_sql(dropped, only)}{GROUPS_SQL}
cl1 as (select *, case when left_count > 0 then left_sum else 0 end as expected, case when right_count > 0 then right_sum else 0 end as actual,
  case when raw_type in ('CURRENCY_MISMATCH', 'STATUS_MISMATCH', 'TIMING') then 0 else left_sum - right_sum end as delta from cl0),
cl as (select * exclude (kind), kind as type, case when kind = 'BRIDGE_BROKEN' then left(segment_id, 4) end as stage,
  case when raw_type is null or raw_type = 'CURRENCY_MISMATCH' then null else coalesce(left_currency, right_currency) end as currency,
  case when kind is not null then sha256('{SCENARIO}|{PERIOD}|' || segment_id || '|' || kind || '|' || group_key || '|' || coalesce(match_key, case when left_count > 0 then left_ref else right_ref end) || '|' || case when kind = 'BRIDGE_BROKEN' then left(segment_id, 4) else '∅' end) end as fingerprint
  from (select *, {kept} as kind from cl1))
"""
