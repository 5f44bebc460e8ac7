"""Reconciliation of a stream of records by event-time windows, with the same grouping and classification as in batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.classify import Roles, Rule, classify
from ..operators.match import BY_KEY, COPY, GROUP, MIXED, as_rejects, copy_columns, guarded, side_columns, with_null_refs, with_presence
from ..schema import REJECTS
from ..sources.sinks import exists
from .batches import ddl, drop_batch, freed_shuffles, is_written, read_batches, run_batches, write_batch

UNTIMED = "no event time"
#: The columns of a record that its group is made of.
GROUPED = ["run_id", "segment_id", "side", "match_key", "group_key", "currency", "signed_amount_minor", "base_amount_minor", "entry_type", "biz_status", "biz_time", "posting_time", "raw_ref"]
_FOUND = ["segment_id", "fingerprint", "type", "match_key", "group_key", "currency", "expected", "actual", "delta"]


def time_window(time: str, size: str, slide: str | None = None, gap: str | None = None) -> Column:
    """Tumbling, sliding (``slide``) or session (``gap``) windows of event time."""
    return F.session_window(time, gap) if gap else F.window(time, size, slide) if slide else F.window(time, size)


def windowed_groups(records: DataFrame, *, watermark: str = "1 hour", size: str = "1 day", slide: str | None = None, gap: str | None = None, on_mixed: str = "fail", known: DataFrame | None = None) -> DataFrame:
    """Match groups of every window of ``biz_time``, by the aggregations of the batch run: copies first, then groups.

    With ``gap`` windows are sessions of a group. The engine takes no second aggregation above session windows, so there copies are gathered
    within the group's one aggregation. On a stream the rows of a window come when the watermark passes its end. Rows later than the
    watermark are dropped by the engine without a trace in its progress figures, and rows without a time are in no window: ``land`` keeps the former and rejects
    the latter, ``reconcile_landed`` rejects what 'quarantine' would leave out here, and ``repair`` brings late rows in. ``known`` (window, the group's columns, m,
    revision), for fixed windows of tables, are former results: groups come with the most of their m and revision, and without a join.
    """
    rows = with_null_refs(records).withWatermark("biz_time", watermark)
    window = time_window("biz_time", size, slide, gap).alias("window")
    if gap:
        return guarded(with_presence(_session_groups(rows, window)), on_mixed)
    panes = None if rows.isStreaming or not slide else _panes(size, slide)
    if panes:
        return guarded(with_presence(_sliding_groups(rows, *panes, known)), on_mixed)
    # Keys first, as rows are compared by the start of the first column before all else, and windows are few.
    copies = rows.groupBy(*BY_KEY, window, *COPY).agg(*copy_columns())
    if known is not None:
        copies = copies.unionByName(known, allowMissingColumns=True)
    return guarded(with_presence(copies.groupBy(*BY_KEY, "window").agg(*side_columns(), *_former(known))), on_mixed)


def _panes(size: str, slide: str) -> tuple[int, int] | None:
    """Size and slide in microseconds, where the one is a multiple of the other."""
    try:
        whole, step = (int(pd.Timedelta(t).value) // 1000 for t in (size, slide))
    except ValueError:
        return None
    return (whole, step) if step > 0 and whole % step == 0 else None


def _former(known: DataFrame | None) -> list[Column]:
    return [] if known is None else [F.max("m").alias("m"), F.max("revision").alias("revision")]


def _sliding_groups(rows: DataFrame, size: int, slide: int, known: DataFrame | None) -> DataFrame:
    """Groups of sliding windows, which consist of panes as long as a slide. Copies are counted by pane, and become rows of each window only where they have been dealt.

    They are dealt by key and block of windows: a pane goes to a second block only where its windows begin in two.
    """
    span = 8 * size  # a block's length, by the begins of its windows
    floor = lambda t, step: t - F.pmod(t, F.lit(step))
    pane, block, first = F.col("pane"), F.col("block"), F.col("pane") - F.lit(size - slide)
    copies = rows.withColumn("pane", floor(F.unix_micros("biz_time"), slide)).groupBy(*BY_KEY, "pane", *COPY).agg(*copy_columns())
    dealt = copies.withColumn("block", F.explode(F.array_distinct(F.array(floor(first, span), floor(pane, span))))).repartition(*BY_KEY, "block")
    begins = F.sequence(F.greatest(first, block), F.least(pane, block + F.lit(span - slide)), F.lit(slide))
    again = [F.sum("n").alias("n"), *[F.min(c).alias(c) for c in ("group_key", "ref", "status", "posted")], F.sum("base").alias("base"), F.sum("n_base").alias("n_base")]
    by = [*BY_KEY, "block", "begin"]
    copies = dealt.withColumn("begin", F.explode(begins)).groupBy(*by, *COPY).agg(*again)
    if known is not None:
        begin = F.unix_micros("window.start")
        copies = copies.unionByName(known.withColumns({"begin": begin, "block": floor(begin, span)}).drop("window"), allowMissingColumns=True)
    groups = copies.groupBy(*by).agg(*side_columns(), *_former(known))
    window = F.struct(F.timestamp_micros("begin").alias("start"), F.timestamp_micros(F.col("begin") + F.lit(size)).alias("end"))
    return groups.withColumn("window", window).drop("block", "begin")


def _session_groups(rows: DataFrame, window: Column) -> DataFrame:
    columns = [F.min("group_key").alias("group_key")]
    for side, p in (("LEFT", "left"), ("RIGHT", "right")):
        here = F.col("side") == side
        of = lambda c, here=here: F.when(here, F.col(c))
        kinds = F.collect_set(F.when(here, F.struct("currency", "entry_type", "signed_amount_minor")))
        columns += [
            F.count_if(here).alias(f"{p}_count"), F.coalesce(F.sum(of("signed_amount_minor")), F.lit(0)).alias(f"{p}_sum"), F.min(of("currency")).alias(f"{p}_currency"), F.max(of("currency")).alias(f"{p}_last_currency"),
            F.min(of("raw_ref")).alias(f"{p}_ref"), F.min(of("biz_status")).alias(f"{p}_status"), F.min(of("posting_time")).alias(f"{p}_posted"), (F.size(kinds) < F.count_if(here)).alias(f"{p}_copies"),
            F.when(F.count(of("base_amount_minor")) == F.count_if(here), F.sum(of("base_amount_minor"))).alias(f"{p}_base"),
        ]
    return rows.groupBy(window, *GROUP).agg(*columns)


def _watermarks(batch: DataFrame, root: str, batch_id: int, delay: str) -> tuple:
    """The watermark before a micro-batch and the one after it, which is kept below ``root``/marks; None, where no record has come."""
    spark = batch.sparkSession
    at = read_batches(spark, f"{root}/marks", "newest timestamp").where(F.col("batch").cast("long") < batch_id)
    write_batch(batch.agg(F.max("biz_time").alias("newest")), f"{root}/marks", batch_id)
    own = spark.read.schema("newest timestamp").parquet(f"{root}/marks/batch={batch_id}")
    behind = F.max("newest") - F.expr(f"interval {delay}")
    low = at.agg(behind.alias("w")).first()["w"]
    high = own.agg(behind.alias("w")).first()["w"]
    return low, high if low is None else low if high is None else max(low, high)


def _near(raw: DataFrame, low, high, size: str) -> DataFrame:
    """The landed records that may be in windows that end behind ``low`` and not behind ``high``; other years' parts are not read."""
    near = raw.where((F.col("biz_time") < F.lit(high)) & (F.col("part") <= F.to_date(F.lit(high))))
    if low is None:
        return near
    since = F.lit(low) - F.expr(f"interval {size}")
    return near.where((F.col("biz_time") >= since) & (F.col("part") >= F.to_date(F.date_trunc("year", since))))


def _closing(raw: DataFrame, low, high, *, size: str = "1 day", slide: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """The groups of the windows that end behind ``low`` and not behind ``high``, from landed records."""
    if high is None or low == high:
        return windowed_groups(raw.where(F.lit(False)), size=size, slide=slide, on_mixed="mark", known=None if known is None else known.where(F.lit(False)))
    end = F.col("window.end")
    inside = (end <= F.lit(high)) & (F.lit(True) if low is None else end > F.lit(low))
    return windowed_groups(_near(raw, low, high, size), size=size, slide=slide, on_mixed="mark", known=None if known is None else known.where(inside)).where(inside)


#: Windows are grouped in parts of about so many records, one after the other, so the files of a shuffle don't grow with what a batch closes.
AT_ONCE = 30_000_000


def _spans(raw: DataFrame, low, high, path: str, name: int | str, *, size: str = "1 day", slide: str | None = None) -> list[tuple[str, object, object]]:
    """The time from ``low`` to ``high`` in spans in which windows end, each with a name for its folder. They are kept below ``path``, so what is done again has the same."""
    spark = raw.sparkSession
    if not is_written(spark, path, name):
        if high is None or low == high:
            return [(str(name), low, high)]
        bounds, held = [low], 0
        for t, n in _near(raw, low, high, size).groupBy(F.date_trunc("hour", "biz_time").alias("t")).count().orderBy("t").collect():
            if held and held + n > AT_ONCE and (low is None or t > low):
                bounds.append(t)
                held = 0
            held += n
        write_batch(spark.createDataFrame([(t,) for t in [*bounds, high]], "at timestamp").coalesce(1), path, name)
    bounds = [r["at"] for r in spark.read.schema("at timestamp").parquet(f"{path}/batch={name}").orderBy(F.asc_nulls_first("at")).collect()]
    return [(f"{name}-{i}" if i else str(name), *span) for i, span in enumerate(zip(bounds, bounds[1:]))]


def _closing_sessions(batch: DataFrame, root: str, batch_id: int, low, high, gap: str, classified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The groups of sessions that end not behind ``high`` and are mixed or not clean, classified. The records of sessions that are still open are kept below ``root``/open, for the next batch."""
    spark = batch.sparkSession
    schema = ddl(batch)
    before = read_batches(spark, f"{root}/open", schema).where(F.col("batch").cast("long") < batch_id)
    last = before.agg(F.max(F.col("batch").cast("long"))).first()[0]
    rows = batch if low is None else batch.where(F.col("biz_time") + F.expr(f"interval {gap}") > F.lit(low))
    if last is not None:
        rows = rows.unionByName(before.where(F.col("batch").cast("long") == last).drop("batch"))
    still = F.lit(True) if high is None else F.col("window.end") > F.lit(high)
    groups = classified(windowed_groups(rows, gap=gap, on_mixed="mark")).where(still | F.col("type").isNotNull() | F.col("mixed"))
    write_batch(groups.select("window", "run_id", "null_ref", "mixed", *_FOUND), f"{root}/sessions", batch_id)
    found = spark.read.parquet(f"{root}/sessions/batch={batch_id}")
    keys = found.where(still).select("window", *[F.col(c).alias(f"__{c}") for c in GROUP])
    same = (F.col("biz_time") >= F.col("window.start")) & (F.col("biz_time") < F.col("window.end"))
    for c in GROUP:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    write_batch(with_null_refs(rows).join(keys, same, "left_semi").drop("null_ref"), f"{root}/open", batch_id)
    return found.where(~still)


def reconcile_windows(records: DataFrame, root: str, roles: dict[str, Roles], rule: Rule, *, scenario: str, period: str, checkpoint: str, by: str = "month", on_mixed: str = "fail", watermark: str = "1 hour", size: str = "1 day", slide: str | None = None, gap: str | None = None) -> StreamingQuery:
    """The discrepancies of closed windows go to ``root``/discrepancies by micro-batch; clean groups are left out.

    Records are landed below ``root``/raw, parted ``by`` time, and a window is grouped once, by the batch run's aggregations, when the watermark has passed its
    end. So no record is state of the engine, and a batch reads the parts in which windows close. Records without a time are in no window, and
    later ones than their window's end come to no discrepancy (``land``, ``reconcile_landed`` and ``repair`` bring them in).
    """
    part = F.to_date(F.date_trunc(by, "biz_time"))
    # What a discrepancy is made of; of references that is those that stand for a key.
    needed = records.select(*[F.when(F.col("match_key").isNull(), F.col(c)).alias(c) if c == "raw_ref" else c for c in GROUPED])
    schema = ddl(needed)

    def classified(groups: DataFrame) -> DataFrame:
        return classify(groups, roles, rule, scenario=scenario, period=period)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        timed = batch.where("biz_time is not null")
        low, high = _watermarks(timed, root, batch_id, watermark)
        if gap:
            if not is_written(spark, f"{root}/discrepancies", batch_id):
                found = guarded(_closing_sessions(timed, root, batch_id, low, high, gap, classified), on_mixed)
                write_batch(found.where("type is not null").select(F.col("window.start").alias("window_start"), *_FOUND), f"{root}/discrepancies", batch_id)
            drop_batch(spark, f"{root}/sessions", batch_id)
            return
        write_batch(timed.withColumn("part", part).hint("rebalance", "part"), f"{root}/raw", batch_id, ["part"])
        raw = landed(spark, root, schema)
        for name, begin, end in _spans(raw, low, high, f"{root}/spans", batch_id, size=size, slide=slide):
            found = classified(guarded(_closing(raw, begin, end, size=size, slide=slide), on_mixed))
            write_batch(found.where("type is not null").select(F.col("window.start").alias("window_start"), *_FOUND), f"{root}/discrepancies", name)

    return run_batches(needed, each, checkpoint)


def keep_raw(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every input row, late ones included."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Nothing gets lost: what arrives is landed first, and is later in a group or among the rejects.

def land(records: DataFrame, root: str, checkpoint: str, *, by: str = "month") -> StreamingQuery:
    """Keep every record with an event time below ``root``/raw, late ones included, and reject the others.

    Both tables have a folder for each micro-batch, written once, so a batch that is done again neither loses nor doubles rows. The raw table is parted ``by`` day ('day'
    suits streams whose event times are near each other), week, month, quarter or year of event time, so that repairs read little.
    """
    part = F.to_date(F.date_trunc(by, "biz_time"))

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(as_rejects(batch.where("biz_time is null"), UNTIMED), f"{root}/rejects-untimed", batch_id)
        write_batch(batch.where("biz_time is not null").withColumn("part", part).hint("rebalance", "part"), f"{root}/raw", batch_id, ["part"])

    return run_batches(records, each, checkpoint)


def landed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return read_batches(spark, f"{root}/raw", f"{schema}, part date")


def _in_groups(raw: DataFrame, groups: DataFrame) -> DataFrame:
    """The raw records in the windows of ``groups``; parts behind the last and before the first window's year are not read."""
    span = groups.agg(F.trunc(F.min("window.start"), "year").alias("lo"), F.to_date(F.max("window.end")).alias("hi")).first()
    if span["lo"] is None:
        return raw.limit(0)
    keys = groups.select("window", *[F.col(c).alias(f"__{c}") for c in GROUP]).distinct()
    same = (F.col("biz_time") >= F.col("window.start")) & (F.col("biz_time") < F.col("window.end"))
    for c in GROUP:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    near = raw.where(F.col("part").between(F.lit(span["lo"]), F.lit(span["hi"])))
    return with_null_refs(near).join(keys, same, "left_semi")


def reconcile_landed(spark: SparkSession, root: str, schema: str, roles: dict[str, Roles], rule: Rule, *, scenario: str, period: str, checkpoint: str, **window) -> StreamingQuery:
    """Classify the windows of what has been landed: closed groups, clean ones included, go to ``root``/groups, and the records of groups
    with several currencies on a side to ``root``/rejects-mixed, each by micro-batch.

    The stream of landed records moves the watermark; the groups of the windows that it closes are made from the landed table, in the batch run's way.
    """
    if window.get("gap"):
        raise ValueError("sessions come from reconcile_windows; landed records are in fixed windows")
    delay = window.pop("watermark", "1 hour")
    window.pop("gap", None)
    source = spark.readStream.schema(f"{schema}, batch string, part date").parquet(f"{root}/raw")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        low, high = _watermarks(batch, root, batch_id, delay)
        raw = landed(spark, root, schema)
        # One table, in which mixed groups are marked: readers of groups pass over them, and repairs know what they held.
        for name, begin, end in _spans(raw, low, high, f"{root}/spans", batch_id, **window):
            groups = classify(_closing(raw, begin, end, **window), roles, rule, scenario=scenario, period=period).withColumn("revision", F.lit(0))
            write_batch(groups, f"{root}/groups", name)
            mixed = spark.read.schema(groups.schema).parquet(f"{root}/groups/batch={name}").where("mixed")
            write_batch(as_rejects(_in_groups(raw, mixed), MIXED), f"{root}/rejects-mixed", name)

    return run_batches(source, each, checkpoint)


def _results(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Classified groups as written, the mixed among them."""
    return read_batches(spark, f"{root}/{table}", ddl(spark.read.parquet(f"{root}/groups"), "batch"))


def _same_group(a: DataFrame, b: DataFrame) -> list[Column]:
    return [a[c].eqNullSafe(b[c]) for c in ("window", *GROUP)]


def current_groups(spark: SparkSession, root: str) -> DataFrame:
    """The classified groups of all closed windows, as last corrected."""
    first = _results(spark, root, "groups").where("not mixed").drop("batch")
    if not exists(spark, f"{root}/corrections"):
        return first
    fixed = _results(spark, root, "corrections").where("not mixed").drop("batch")
    newest = F.row_number().over(Window.partitionBy(*BY_KEY, "window").orderBy(F.desc("revision")))
    # A window closes once, so its groups are there once; only corrections repeat.
    fixed = fixed.withColumn("__n", newest).where("__n = 1").drop("__n")
    return first.join(fixed.select("window", *GROUP), _same_group(first, fixed), "left_anti").unionByName(fixed)


def repair(spark: SparkSession, root: str, schema: str, roles: dict[str, Roles], rule: Rule, *, scenario: str, period: str, name: str, watermark: str = "1 hour", **window) -> DataFrame:
    """Bring late records in: recompute the groups whose closed windows lack landed records, and publish them as ``root``/corrections.

    A window is closed once the newest landed record is a watermark behind its end. Counts by window tell from which to which windows rows are lacking; their groups are
    made anew, the known counts going along in the same aggregation, and those whose counts differ are corrected. ``name`` names the repair, and a repair of a name is
    published once. Groups that become mixed are rejected as a whole, and their former results stay.
    """
    if window.get("gap"):
        raise ValueError("late records may join sessions; repair fixed windows")
    size, slide = window.get("size", "1 day"), window.get("slide")
    raw = landed(spark, root, schema)
    with freed_shuffles(spark):
        known = [_results(spark, root, t).select("window", *GROUP, (F.col("left_count") + F.col("right_count")).alias("m"), "revision") for t in ("groups", "corrections")]
        known = known[0].unionByName(known[1])
        low = high = None
        if not is_written(spark, f"{root}/repairs", name) and not is_written(spark, f"{root}/corrections", name):
            closed = F.col("window.end") <= F.lit(raw.agg(F.max("biz_time")).first()[0]) - F.expr(f"interval {watermark}")
            # Landed records only become more, and so do the counts of a group from revision to revision.
            newest = known if not exists(spark, f"{root}/corrections") else known.groupBy(*BY_KEY, "window").agg(F.max("m").alias("m"))
            there = raw.groupBy(time_window("biz_time", size, slide).alias("window")).agg(F.count("*").alias("n")).where(closed)
            held = newest.groupBy(F.col("window").alias("__window")).agg(F.sum("m").alias("m"))
            lacking = there.join(held, F.col("window") == F.col("__window"), "left").where(F.col("n") > F.coalesce("m", F.lit(0)))
            low, high = lacking.agg(F.min("window.start"), F.max("window.end")).first()
        outs = []
        for part, begin, end in _spans(raw, low, high, f"{root}/repairs", name, size=size, slide=slide):
            again = _closing(raw, begin, end, size=size, slide=slide, known=known)
            again = again.where((F.col("left_count") + F.col("right_count")) > F.coalesce("m", F.lit(0))).withColumn("revision", F.coalesce("revision", F.lit(-1)) + 1).drop("m")
            fixed = classify(again, roles, rule, scenario=scenario, period=period)
            write_batch(fixed, f"{root}/corrections", part)
            outs.append(spark.read.schema(fixed.schema).parquet(f"{root}/corrections/batch={part}"))
            write_batch(as_rejects(_in_groups(raw, outs[-1].where("mixed")), MIXED), f"{root}/rejects-late-mixed", part)
    return reduce(DataFrame.unionByName, outs).where("not mixed")


def all_rejects(spark: SparkSession, root: str) -> DataFrame:
    """What was rejected while landing and reconciling."""
    tables = ["rejects-untimed", "rejects-mixed", "rejects-late-mixed"]
    out = spark.createDataFrame([], f"{REJECTS}, batch string")
    for t in tables:
        out = out.unionByName(read_batches(spark, f"{root}/{t}", REJECTS)) if exists(spark, f"{root}/{t}") else out
    return out.drop("batch")
