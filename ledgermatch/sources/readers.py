"""Readers of table and CSV sources. Each gives (records, rejects): rejected rows never stop the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from ..schema import ENTRY_TYPES
from .mapping import ReadContext, SourceMapping

#: 2026-08-17T00:00:00Z and fractions of seconds.
_INSTANT = r"^[+-]?\d{4,}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?Z$"


def _column(name: str | None, kind: str) -> Column:
    return F.col(f"`{name}`").cast(kind) if name else F.lit(None).cast(kind)


def _key(expression: str | None, name: str | None) -> Column:
    return F.expr(expression).cast("string") if expression else _column(name, "string")


def _split(rows: DataFrame, reason: Column, payload: Column, ctx: ReadContext) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("reason", reason)
    context = [F.lit(ctx.run_id).alias("run_id"), F.lit(ctx.segment_id).alias("segment_id"), F.lit(ctx.side).alias("side")]
    rejects = marked.where("reason is not null").select(*context, "raw_ref", F.substring("reason", 1, 128).alias("reason"), payload.alias("payload"))
    records = marked.where("reason is null").select(
        *context, F.lit(ctx.role).alias("source_role"), "match_key", "group_key", "currency", "signed_amount_minor", "base_amount_minor",
        F.lit(None).cast("decimal(20,10)").alias("fx_rate"), F.lit(None).cast("timestamp").alias("fx_rate_time"), F.lit(None).cast("string").alias("fx_rate_source"),
        "entry_type", "biz_status", "biz_time", "posting_time", "raw_ref",
        F.concat_ws(":", F.lit(ctx.run_id), F.lit(ctx.segment_id), F.lit(ctx.side), "raw_ref").alias("record_id"),
    )
    return records, rejects


def visible(mapping: SourceMapping, ctx: ReadContext, posted: Column | None = None) -> Column:
    """Whether a row is among those that a read is for: of its tenant, posted up to its cutoff, where the mapping names these columns.

    Rows without a tenant or a time belong to no such read. ``posted`` tells how the time is told from the column.
    """
    found = F.lit(True)
    if mapping.tenant and ctx.tenant_id is not None:
        found = found & (F.col(f"`{mapping.tenant}`") == ctx.tenant_id)
    if ctx.cutoff and mapping.posting_time:
        found = found & ((F.col(f"`{mapping.posting_time}`").cast("timestamp") if posted is None else posted) <= F.lit(ctx.cutoff).cast("timestamp"))
    return found


def _checked(columns: list[str], mapping: SourceMapping, source: str) -> None:
    missing = [n for n in mapping.required() if n not in columns]
    if missing:
        raise ValueError(f"{source} has no columns {missing}")


def read_table_source(df: DataFrame, mapping: SourceMapping, ctx: ReadContext) -> tuple[DataFrame, DataFrame]:
    """Map a table's rows. Rejects rows without group key, currency or amount and currencies that are not three characters.

    Unknown and missing entry types become ISSUE; blank keys stay keys; the currency is taken as it is. The cutoff
    and the tenant are filters on source columns, so they reach the scan.
    """
    _checked(df.columns, mapping, f"source {mapping.table}")
    df = df.where(visible(mapping, ctx))
    kind = F.upper(F.trim(_column(mapping.entry_type, "string")))
    rows = df.select(
        F.concat(F.lit(mapping.table + ":"), _column(mapping.id, "string")).alias("raw_ref"), _key(mapping.match_expr, mapping.match_key).alias("match_key"), _key(mapping.group_expr, mapping.group_key).alias("group_key"),
        _column(mapping.currency, "string").alias("currency"), _column(mapping.amount, "long").alias("signed_amount_minor"), _column(mapping.base_amount, "long").alias("base_amount_minor"),
        F.when(kind.isin(ENTRY_TYPES), kind).otherwise(F.lit("ISSUE")).alias("entry_type"),
        _column(mapping.biz_status, "string").alias("biz_status"), _column(mapping.biz_time, "timestamp").alias("biz_time"), _column(mapping.posting_time, "timestamp").alias("posting_time"),
    )
    reason = (
        F.when(F.col("group_key").isNull(), F.lit("null group_key"))
        .when(F.col("currency").isNull(), F.lit("null currency"))
        .when(F.col("signed_amount_minor").isNull(), F.lit("null amount"))
        .when(F.length("currency") != 3, F.concat(F.lit("invalid money: currency "), F.col("currency")))
    )
    return _split(rows, reason, F.to_json(F.struct("match_key", "group_key", "currency", "signed_amount_minor")), ctx)


def read_csv_source(spark: SparkSession, path: str, mapping: SourceMapping, ctx: ReadContext, *, charset: str = "UTF-8", delimiter: str = ",", multi_line: bool = False, lineage: str = "id") -> tuple[DataFrame, DataFrame]:
    """Map CSV rows with a header. Currencies are trimmed and upper-cased, blank optional fields become null, amounts are signed longs.

    Keys may be expressions over the header's columns, all of which are strings; tenant and cutoff filter as in tables, but rows that do not fit the
    header or whose time is none are rejected, not passed over. Rejects rows without id, group key, currency or amount, with a bad
    amount, currency, entry type or time, and those with fewer fields than the header. A missing required header fails at once. Quotes in quoted
    values are doubled. Blank lines are no rows.

    Rows are named by file and id, or with ``lineage='line'`` by file and line, which shifts when lines are inserted. ``multi_line`` is for
    quoted line ends. By line they are put together across tasks (``csv_rows``) and named path:first-last; by id Spark's reader takes
    a file as one task, which UTF-16 needs, too.
    """
    if lineage not in ("id", "line"):
        raise ValueError("lineage is by id or by line")
    if lineage == "line" and charset.upper().startswith(("UTF-16", "UTF-32")):
        raise ValueError("lines are told apart in charsets whose line ends are single bytes")
    quoting = {"sep": delimiter, "mode": "PERMISSIVE", "escape": '"', "columnNameOfCorruptRecord": "__bad"}
    options = {**quoting, "header": True, "encoding": charset, "multiLine": multi_line}
    header = spark.read.options(**options).csv(path).columns
    _checked(header, mapping, path)
    schema = ", ".join(f"`{c}` string" for c in header) + ", `__bad` string"
    if lineage == "line":
        if multi_line:
            lines = csv_rows(spark, path, charset=charset)
        else:
            lines = with_line_numbers(spark, path, charset=charset).where(F.trim("line") != "").select("file", F.col("number").alias("first"), F.col("number").alias("last"), F.col("line").alias("text"), F.lit(True).alias("closed"))
        place = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
        # A row is parsed once: filters on its fields would be moved below a plain projection, with a parse for each field, but aren't moved below explode.
        raw = lines.where("first > 1").select(F.explode(F.array(F.from_csv("text", schema, quoting))).alias("row"), F.col("file").alias("__file"), place.alias("__line"), "closed", "text")
        raw = raw.select("row.*", "__file", "__line", F.col("closed").alias("__closed"), F.col("text").alias("__text")).withColumn("__bad", F.when(F.col("__closed"), F.col("__bad")).otherwise(F.col("__text"))).drop("__text")
    else:
        raw = spark.read.options(**options).schema(schema).csv(path).withColumns({"__file": F.col("_metadata.file_path"), "__line": F.lit(None).cast("string"), "__closed": F.lit(True)})
    field = lambda n: F.when(F.trim(F.col(f"`{n}`")) != "", F.col(f"`{n}`")) if n else F.lit(None).cast("string")

    def key(expression: str | None, name: str | None) -> Column:
        found = _key(expression, name)
        return F.when(F.trim(found) != "", found)

    amount, kind = F.trim(field(mapping.amount)), F.upper(F.trim(field(mapping.entry_type)))
    biz, posting = F.trim(field(mapping.biz_time)), F.trim(field(mapping.posting_time))
    long = lambda c: F.when(c.rlike(r"^[+-]?\d{1,19}$"), c.try_cast("bigint"))
    time = lambda c: F.when(c.rlike(_INSTANT), c.try_cast("timestamp"))
    # The test of __bad is written so that Spark's reader can't take it over: it would be asked before a row is known to be bad.
    unreadable = (F.coalesce("__bad", F.lit("")) != "") | (posting.isNotNull() & time(posting).isNull())
    raw = raw.where(unreadable | visible(mapping, ctx, time(posting)))
    rows = raw.select(
        "__closed", "__bad", amount.alias("__amount"), kind.alias("__kind"), biz.alias("__biz"), posting.alias("__posting"),
        field(mapping.id).alias("__id"), F.concat_ws(":", "__file", F.coalesce(F.col("__line").cast("string"), field(mapping.id), F.lit("?"))).alias("raw_ref"),
        key(mapping.match_expr, mapping.match_key).alias("match_key"), key(mapping.group_expr, mapping.group_key).alias("group_key"), F.upper(F.trim(field(mapping.currency))).alias("currency"),
        long(amount).alias("signed_amount_minor"), long(F.trim(field(mapping.base_amount))).alias("base_amount_minor"),
        F.coalesce(kind, F.lit("ISSUE")).alias("entry_type"), field(mapping.biz_status).alias("biz_status"), time(biz).alias("biz_time"), time(posting).alias("posting_time"),
    )
    absent = lambda c, name: (F.col(c).isNull(), F.lit(f"{name} is required"))
    checks = [
        (~F.col("__closed"), F.lit("a quote that no line closes; nothing is read behind it")),
        (F.col("__bad").isNotNull(), F.lit("row does not fit the header")), absent("__id", "id"), absent("group_key", "group_key"), absent("currency", "currency"), absent("__amount", "amount"),
        (F.col("signed_amount_minor").isNull(), F.concat(F.lit("not a signed long: "), F.col("__amount"))), (F.length("currency") != 3, F.concat(F.lit("invalid money: currency "), F.col("currency"))),
        (~F.col("entry_type").isin(ENTRY_TYPES), F.concat(F.lit("unknown entry_type: "), F.col("entry_type"))),
        (F.col("__posting").isNotNull() & F.col("posting_time").isNull(), F.concat(F.lit("not an instant: "), F.col("__posting"))),
    ]
    if mapping.biz_time:
        checks.append((F.col("biz_time").isNull(), F.concat(F.lit("not an instant: "), F.coalesce(F.col("__biz"), F.lit("")))))
    reason = F.coalesce(*[F.when(c, r) for c, r in checks])
    payload = F.coalesce("__bad", F.to_json(F.struct("match_key", "group_key", "currency", "__amount", "__kind", "__biz")))
    return _split(rows, reason, payload, ctx)


def _cut_lines(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """(file, block, at, line): the lines of text files, in the order of ``at`` within the block of a file that a task reads."""
    return spark.read.option("encoding", charset).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _earlier() -> WindowSpec:
    """The parts of a file before one, of which each has a row."""
    return Window.partitionBy("file").orderBy("block", "lo").rowsBetween(Window.unboundedPreceding, -1)


def with_line_numbers(spark: SparkSession, path: str, *, charset: str = "UTF-8") -> DataFrame:
    """(file, number, line) of text files, numbers from 1.

    Partitions are numbered in the order in which files are cut, so a line's number is its place in its partition and file, and the
    lines of the file that earlier partitions hold: one row for each file and partition, which is sent to all tasks, so that no line is moved or sorted.
    """
    lines = _cut_lines(spark, path, charset)
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("lo"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(_earlier()), F.lit(0))).select("file", "block", "lo", "before")
    return lines.join(F.broadcast(offsets), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("lo") + 1).alias("number"), "line")


#: Lines of a part, as a power of two: what a task sorts at once, and for how many lines a row is sent to all tasks.
_PART_BITS = 18


def csv_rows(spark: SparkSession, path: str, *, charset: str = "UTF-8", part_bits: int = _PART_BITS) -> DataFrame:
    """(file, first, last, text, closed): rows of CSV files as lines from ``first`` to ``last``, where quoted values may hold line ends.

    A line starts a row if an even number of quotes stands before it in the file. Parts of files (of at most 2**part_bits lines) count lines and quotes by themselves, and sums over the earlier
    parts (a row for each, sent to all tasks) tell each part how it begins; then only the lines of rows of several lines meet, by row. Line ends within a row are line feeds. If
    a file's quotes are odd in number, the row that the last one opens has only its first line and is not ``closed``, and nothing behind it is a row. Blank lines outside of quotes are no rows.

    A part is named by ``lo``, the number of its first line among all: lines are dealt and sorted by two numbers instead of by paths.
    """
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    lines = _cut_lines(spark, path, charset).withColumns({"quotes": quotes.cast("long"), "part": F.shiftright("at", part_bits)})
    sizes = lines.groupBy("file", "block", "part").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.sum("quotes").alias("q"))
    earlier = lambda c: F.coalesce(F.sum(c).over(_earlier()), F.lit(0))
    offsets = sizes.select("file", "block", "part", "lo", earlier("n").alias("lines_before"), earlier("q").alias("quotes_before"), (F.sum("q").over(Window.partitionBy("file")) % 2 == 1).alias("unclosed"))
    within = Window.partitionBy("lo").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("quotes_before") + F.coalesce(F.sum("quotes").over(within), F.lit(0))
    placed = lines.join(F.broadcast(offsets), ["file", "block", "part"])
    numbered = placed.select("file", "lo", "at", "line", "unclosed", (F.col("lines_before") + F.col("at") - F.col("lo") + 1).alias("number"), (before % 2 == 1).alias("inside"), ((before + F.col("quotes")) % 2 == 1).alias("open"))
    whole = numbered.where("not inside and not open and trim(line) != ''").select("file", F.col("number").alias("first"), F.col("number").alias("last"), F.col("line").alias("text"), F.lit(True).alias("closed"))
    parts = numbered.where("inside or open")
    starts = parts.where("not inside").groupBy("lo").agg(F.max("number").alias("start"))
    known = sizes.select("file", "block", "lo").join(starts, "lo", "left")
    carried = known.select("lo", F.last("start", True).over(_earlier()).alias("carried"), F.max("start").over(Window.partitionBy("file")).alias("final"))
    so_far = F.max(F.when(~F.col("inside"), F.col("number"))).over(Window.partitionBy("lo").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = parts.withColumn("own", so_far).join(F.broadcast(carried), "lo").withColumn("first", F.coalesce("own", "carried"))
    lost = F.col("unclosed") & (F.col("first") == F.col("final"))
    placed = placed.where(~lost | (F.col("number") == F.col("first"))).withColumn("closed", ~lost)
    joined = placed.groupBy("first", "file").agg(F.max("number").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n").alias("text"), F.bool_and("closed").alias("closed"))
    return whole.unionByName(joined)


#: Source types and their readers: fn(spark, location, mapping, ctx, **options) gives (records, rejects).
READERS: dict[str, Callable] = {}


def register_source(kind: str, reader: Callable) -> None:
    if kind in READERS:
        raise ValueError(f"source type {kind} is registered already")
    READERS[kind] = reader


def route_source(spark: SparkSession, kind: str, location, mapping: SourceMapping, ctx: ReadContext, **options) -> tuple[DataFrame, DataFrame]:
    """Read by source type; an unknown one fails."""
    if kind not in READERS:
        raise ValueError(f"unknown source type {kind}; known: {sorted(READERS)}")
    return READERS[kind](spark, location, mapping, ctx, **options)


#: Kinds of sources that are tables: fn(spark, location, **options) gives the table.
TABLES: dict[str, Callable] = {
    "memory": lambda spark, df: df, "db": lambda spark, name: spark.table(name), "parquet": lambda spark, path: spark.read.parquet(path),
    "jdbc": lambda spark, table, **options: spark.read.format("jdbc").option("dbtable", table).options(**options).load(),
}


def load_table(spark: SparkSession, kind: str, location, **options) -> DataFrame:
    if kind not in TABLES:
        raise ValueError(f"unknown kind of table {kind}; known: {sorted(TABLES)}")
    return TABLES[kind](spark, location, **options)


def _table_reader(kind: str) -> Callable:
    return lambda spark, location, mapping, ctx, **options: read_table_source(load_table(spark, kind, location, **options), mapping, ctx)


for _kind in TABLES:
    register_source(_kind, _table_reader(_kind))
register_source("csv-file", read_csv_source)


def both_sides(*reads: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All records and all rejects of several reads."""
    records, rejects = reads[0]
    for r, j in reads[1:]:
        records, rejects = records.unionByName(r), rejects.unionByName(j)
    return records, rejects
