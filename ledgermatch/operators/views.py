"""Read views of a ledger: roll-ups, summaries, quality checks and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def three_way_rollup(report: DataFrame, first: str, second: str) -> DataFrame:
    """By run and currency over two segments: both balanced, and the bridges' sum."""
    of = lambda s, v: F.max(F.when(F.col("segment_id") == s, v))
    rows = report.where(F.col("segment_id").isin(first, second))
    out = rows.groupBy("run_id", "currency").agg(of(first, F.col("balanced")).alias("first_balanced"), of(second, F.col("balanced")).alias("second_balanced"), F.sum("bridge_broken").alias("bridge_broken"))
    return out.withColumn("consistent", F.coalesce(F.col("first_balanced") & F.col("second_balanced"), F.lit(False))).orderBy("run_id", "currency")


def overall_consistency(rollup: DataFrame) -> DataFrame:
    """By run whether every currency is consistent; runs without reports have no row."""
    return rollup.groupBy("run_id").agg(F.bool_and("consistent").alias("consistent"))


def open_for_counts(status: Column) -> Column:
    """Open on the dashboard: no disposition, or reopened."""
    return status.isNull() | (status == "REOPENED")


def open_for_filters(status: Column) -> Column:
    """Open in list filters: no disposition."""
    return status.isNull()


def run_summary(runs: DataFrame, discrepancies: DataFrame, dispositions: DataFrame, report: DataFrame) -> DataFrame:
    """Runs with the numbers of discrepancies and open ones, and whether the report is balanced (null without one)."""
    d = discrepancies.join(dispositions.select("fingerprint", "status"), "fingerprint", "left")
    counts = d.groupBy("run_id").agg(F.count("*").alias("n_discrepancies"), F.count_if(open_for_counts(F.col("status"))).alias("n_open"))
    balanced = report.groupBy("run_id").agg(F.bool_and("balanced").alias("balanced"))
    out = runs.join(counts, "run_id", "left").join(balanced, "run_id", "left")
    return out.withColumns({"n_discrepancies": F.coalesce("n_discrepancies", F.lit(0)), "n_open": F.coalesce("n_open", F.lit(0))})


def dashboard_counts(discrepancies: DataFrame, dispositions: DataFrame) -> DataFrame:
    """One row: open, resolved, closed and suppressed discrepancies."""
    s = F.col("status")
    d = discrepancies.join(dispositions.select("fingerprint", "status"), "fingerprint", "left")
    return d.agg(F.count("*").alias("n"), F.count_if(open_for_counts(s)).alias("n_open"), F.count_if(s == "RESOLVED").alias("n_resolved"), F.count_if(s == "CLOSED").alias("n_closed"), F.count_if(s == "SUPPRESSED").alias("n_suppressed"))


def type_counts(discrepancies: DataFrame) -> DataFrame:
    return discrepancies.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def latest_five(runs: DataFrame) -> DataFrame:
    return list_runs(runs, size=5)[0]


def bucket_skew(records: DataFrame, *, by: str = "bucket", factor: float = 5.0, least: int = 1000) -> DataFrame:
    """Rows by bucket (or another column), the mean and largest of the segment, and whether a bucket is hot."""
    counts = records.groupBy("segment_id", by).agg(F.count("*").alias("n"))
    stats = counts.groupBy("segment_id").agg(F.avg("n").alias("mean"), F.max("n").alias("largest"))
    return counts.join(stats, "segment_id").withColumn("hot", (F.col("n") > F.col("mean") * factor) & (F.col("n") >= least))


def run_status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("n"))


def refine_violations(records: DataFrame, *, most: int = 100) -> DataFrame:
    """Match keys with several group keys, worst first; one row over ``most`` shows that there are more."""
    keys = records.where("match_key is not null").groupBy("segment_id", "match_key").agg(F.count_distinct("group_key").alias("n_groups"))
    return keys.where("n_groups > 1").orderBy(F.desc("n_groups"), "segment_id", "match_key").limit(most + 1)


def run_metrics(runs: DataFrame) -> DataFrame:
    """By scenario and status the runs, failures and seconds."""
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return runs.groupBy("scenario", "status").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FAILED").alias("n_failed"), F.sum(seconds).alias("seconds"))


def _checked_page(page: int, size: int) -> None:
    if not 1 <= size <= 100 or not 0 <= page <= 1_000_000:
        raise ValueError("pages hold 1 to 100 rows, and there are at most 1000001")


def _time_cells(time: Column) -> list[Column]:
    return [F.date_trunc(unit, time) for unit in ("year", "day", "hour", "minute", "second", "microsecond")]


def located(rows: DataFrame, cells: list[Column], skip: int, *, most: int = 10_000) -> tuple[DataFrame, int]:
    """(rows from some place on, rows to skip there), so that the place is ``most`` rows at most before the row number ``skip`` in falling order.

    ``cells`` are ever finer parts of the order. Rows are counted by cell, and then by finer cells within the one that the row is in: a few
    counts over ever fewer rows, none of which sorts any. Nulls come last.
    """
    inside = after = F.lit(True)
    for cell in cells:
        before, found = 0, None
        for c in rows.where(inside).groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).orderBy(F.desc("cell")).toLocalIterator():
            if before + c["n"] > skip:
                found = c
                break
            before += c["n"]
        if found is None:
            return rows.where(F.lit(False)), 0
        skip -= before
        here = cell.isNull() if found["cell"] is None else cell == F.lit(found["cell"])
        later = cell.isNull() if found["cell"] is None else F.coalesce(cell <= F.lit(found["cell"]), F.lit(True))
        after, inside = after & (~F.coalesce(inside, F.lit(False)) | later), F.coalesce(inside & here, F.lit(False))
        if found["n"] <= most:
            break
    return rows.where(after), skip


def _page(rows: DataFrame, order: list[Column], cells: list[Column], page: int, size: int, after: tuple | None, keys: list[Column]) -> DataFrame:
    """Page number ``page``, or the ``size`` rows behind ``after``. No task sorts more than the rows that it keeps of a page and its skip."""
    _checked_page(page, size)
    if after is not None:
        behind = F.lit(False)
        for k, v in reversed(list(zip(keys, after))):
            behind = (k < F.lit(v)) | ((k == F.lit(v)) & behind)
        return rows.where(behind).orderBy(*order).limit(size)
    skip = page * size
    if skip:
        rows, skip = located(rows, cells, skip)
    return rows.orderBy(*order).limit(skip + size).offset(skip)


def list_runs(runs: DataFrame, *, scenario: str | None = None, period: str | None = None, status: str | None = None, page: int = 0, size: int = 20, after: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of runs, newest first, and one row with the total. ``after`` (created_at, sequence_no, run_id) asks for the rows behind that one instead of a page by number."""
    for column, value in (("scenario", scenario), ("period", period), ("status", status)):
        if value is not None:
            runs = runs.where(F.col(column) == value)
    keys = [F.col("created_at"), F.col("sequence_no"), F.col("run_id")]
    return _page(runs, [F.desc("created_at"), F.desc("sequence_no"), F.desc("run_id")], _time_cells(keys[0]), page, size, after, keys), runs.agg(F.count("*").alias("total"))


def enriched(discrepancies: DataFrame, dispositions: DataFrame, runs: DataFrame) -> DataFrame:
    """Discrepancies with their dispositions' status and their runs' scenario and period."""
    d = dispositions.select("fingerprint", F.col("status").alias("disposition"), F.col("updated_at").alias("disposed_at"))
    r = runs.select("run_id", "scenario", "period")
    return discrepancies.join(d, "fingerprint", "left").join(r, "run_id")


#: The columns that a text is looked for in.
SEARCHED = ["discrepancy_id", "fingerprint", "group_key", "match_key", "left_ref", "right_ref"]


def holds_text(text: str) -> Column:
    """Whether one of the searched columns holds ``text``, without case, with % and _ as wildcards."""
    found = F.lit(False)
    for c in SEARCHED:
        found = found | F.coalesce(F.lower(c).like(f"%{text.lower()}%"), F.lit(False))
    return found


def list_discrepancies(rows: DataFrame, *, text: str | None = None, status: str | None = None, page: int = 0, size: int = 20, after: tuple | None = None, **equal: str | None) -> tuple[DataFrame, DataFrame]:
    """A page of enriched discrepancies, last changed first, ties by falling discrepancy id, and one row with the total.

    ``equal`` filters columns such as run_id, scenario, period, segment_id and type; ``text`` is looked for without case in ids, keys and
    references, with % and _ as wildcards (``text_index`` finds it without reading all rows); status OPEN means no disposition. ``after`` (changed at, discrepancy id)
    asks for the rows behind that one instead of a page by number.
    """
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if status is not None:
        rows = rows.where(open_for_filters(F.col("disposition")) if status == "OPEN" else F.col("disposition") == status)
    if text:
        rows = rows.where(holds_text(text))
    changed = F.coalesce("disposed_at", "updated_at")
    cells = [*_time_cells(changed), *[F.substring("discrepancy_id", 1, n) for n in (2, 4, 6)]]
    return _page(rows, [F.desc(changed), F.desc("discrepancy_id")], cells, page, size, after, [changed, F.col("discrepancy_id")]), rows.agg(F.count("*").alias("total"))


def group_records(records: DataFrame, run_id: str, segment_id: str, group_key: str, *, most: int = 500) -> DataFrame:
    """Records of one group key, by side, match key (null last) and record; one row over ``most`` shows that there are more."""
    rows = records.where((F.col("run_id") == run_id) & (F.col("segment_id") == segment_id) & (F.col("group_key") == group_key))
    return rows.orderBy("side", F.asc_nulls_last("match_key"), "record_id").limit(most + 1)


def discrepancy_detail(discrepancies: DataFrame, actions: DataFrame, reversals: DataFrame, alerts: DataFrame) -> DataFrame:
    """Discrepancies with their actions, reversals and alerts as lists, newest first."""
    out = discrepancies
    for name, table in (("actions", actions), ("reversals", reversals), ("alerts", alerts)):
        lists = table.groupBy("fingerprint").agg(F.sort_array(F.collect_list(F.struct("created_at", "idempotency_key")), asc=False).alias(name))
        out = out.join(lists, "fingerprint", "left")
    return out


def run_detail(report: DataFrame, run_id: str) -> DataFrame:
    return report.where(F.col("run_id") == run_id).orderBy("segment_id", "currency")


def scenario_list(scenarios: DataFrame) -> DataFrame:
    return scenarios.select("code", "version", "enabled").orderBy("code")


def worst_groups(classified: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` largest differences of every segment and type."""
    rank = F.row_number().over(Window.partitionBy("segment_id", "type").orderBy(F.desc(F.abs("delta")), "fingerprint"))
    return classified.where("type is not null").withColumn("rank", rank).where(F.col("rank") <= k)
