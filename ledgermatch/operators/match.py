"""Standardized records and their match groups: one row for each key of a segment, whatever the number of its records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import bucket_of, strip_trailing
from ..schema import REJECT_COLUMNS

GROUP = ["run_id", "segment_id", "match_key", "null_ref"]
#: The order in which groups are sorted: keys differ most, runs least.
BY_KEY = ["match_key", "null_ref", "segment_id", "run_id"]
#: Why a record is rejected that reached matching.
BROKEN, MIXED = "match key without group key", "several currencies on one side of its group"


def stripped(records: DataFrame) -> DataFrame:
    return records.withColumns({"match_key": strip_trailing(F.col("match_key")), "group_key": strip_trailing(F.col("group_key"))})


def _broken() -> Column:
    return F.col("match_key").isNotNull() & F.col("group_key").isNull()


def standardize(records: DataFrame, *, buckets: int = 64, strict: bool = False) -> DataFrame:
    """Strip keys' trailing white space and add the bucket. A match key without a group key fails if ``strict``, else ``broken_rejects`` has its row."""
    # Stripping makes no key null, so the test comes before it: a filter on stripped keys would be moved below and strip them twice.
    if strict:
        out = stripped(records).withColumn("group_key", F.when(_broken(), F.raise_error(F.lit(BROKEN)).cast("string")).otherwise(F.col("group_key")))
    else:
        out = stripped(records.where(~_broken()))
    return out.withColumn("bucket", F.when(F.col("group_key").isNotNull(), bucket_of(F.col("group_key"), buckets)))


def as_rejects(records: DataFrame, reason: str) -> DataFrame:
    """Records in the form of rejects."""
    payload = F.to_json(F.struct("match_key", "group_key", "currency", "signed_amount_minor"))
    return records.withColumns({"reason": F.lit(reason), "payload": payload}).select(*REJECT_COLUMNS)


def broken_rejects(records: DataFrame) -> DataFrame:
    """The rejects of records that have a match key and no group key."""
    return as_rejects(stripped(records).where(_broken()), BROKEN)


def identity_keys(records: DataFrame) -> DataFrame:
    """The group key serves as match key."""
    return records.withColumn("match_key", F.col("group_key"))


def with_null_refs(records: DataFrame) -> DataFrame:
    """Records without a match key stand for themselves, by side and reference."""
    return records.withColumn("null_ref", F.when(F.col("match_key").isNull(), F.concat_ws(":", "side", "raw_ref")))


#: Records that agree in side and these are copies of each other.
COPY = ["side", "currency", "entry_type", "signed_amount_minor"]


def copy_columns() -> list[Column]:
    """What is kept of records that are copies of each other."""
    return [
        F.count("*").alias("n"), F.min("group_key").alias("group_key"), F.min("raw_ref").alias("ref"),
        F.min("biz_status").alias("status"), F.min("posting_time").alias("posted"), F.sum("base_amount_minor").alias("base"), F.count("base_amount_minor").alias("n_base"),
    ]


def side_columns() -> list[Column]:
    """What a group has of each side, from its copies."""
    columns: list[Column] = [F.min("group_key").alias("group_key")]
    for side, p in (("LEFT", "left"), ("RIGHT", "right")):
        of = lambda c, side=side: F.when(F.col("side") == side, F.col(c))
        columns += [
            F.coalesce(F.sum(of("n")), F.lit(0)).alias(f"{p}_count"), F.coalesce(F.sum(of("n") * F.col("signed_amount_minor")), F.lit(0)).alias(f"{p}_sum"), F.min(of("currency")).alias(f"{p}_currency"),
            F.max(of("currency")).alias(f"{p}_last_currency"), F.min(of("ref")).alias(f"{p}_ref"), F.min(of("status")).alias(f"{p}_status"), F.min(of("posted")).alias(f"{p}_posted"),
            F.coalesce(F.max(of("n")) > 1, F.lit(False)).alias(f"{p}_copies"),
            F.when(F.sum(of("n_base")) == F.sum(of("n")), F.sum(of("base"))).alias(f"{p}_base"),
        ]
    return columns


def with_presence(groups: DataFrame) -> DataFrame:
    """Adds ``mixed`` (a side has several currencies) and ``presence``."""
    mixed = (F.col("left_currency") != F.col("left_last_currency")) | (F.col("right_currency") != F.col("right_last_currency"))
    presence = F.when(F.col("right_count") == 0, "LEFT_ONLY").when(F.col("left_count") == 0, "RIGHT_ONLY").otherwise("BOTH")
    return groups.withColumns({"mixed": F.coalesce(mixed, F.lit(False)), "presence": presence}).drop("left_last_currency", "right_last_currency")


def guarded(groups: DataFrame, on_mixed: str = "fail") -> DataFrame:
    """Fails on a mixed group, however few columns are used later; 'mark' lets it pass, and 'quarantine' leaves it out."""
    if on_mixed == "mark":
        return groups
    if on_mixed == "quarantine":
        return groups.where("not mixed")
    if on_mixed != "fail":
        raise ValueError(f"unknown treatment of mixed currencies: {on_mixed}")
    error = F.raise_error(F.concat(F.lit("several currencies on one side of "), F.coalesce("match_key", "null_ref"))).cast("boolean")
    return groups.where(F.when(F.col("mixed"), error).otherwise(F.lit(True)))


def match_groups(records: DataFrame, *, on_mixed: str = "fail") -> DataFrame:
    """Full outer match of a segment's two sides by match key, as aggregates: records are never joined with one another.

    Records without a match key form groups of their own. Sums are exact and overflow fails. The first aggregation counts
    copies, before and after its exchange, so even the most frequent key leaves few rows; the second makes the groups. A side of several
    currencies fails, or is treated as in ``guarded``. Records of one run may come without ``run_id``, and so do their groups.
    """
    keyed = with_null_refs(records)
    by = [c for c in BY_KEY if c in keyed.columns]
    copies = keyed.groupBy(*by, *COPY).agg(*copy_columns())
    return guarded(with_presence(copies.groupBy(*by).agg(*side_columns())), on_mixed)


def mixed_rejects(records: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records outside mixed groups, and the rejects of those inside."""
    bad = groups.where("mixed").select(*[F.col(c).alias(f"__{c}") for c in GROUP])
    keyed = with_null_refs(records)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in GROUP]
    return keyed.join(bad, same, "left_anti").drop("null_ref"), as_rejects(keyed.join(bad, same, "left_semi"), MIXED)


#: Match strategies by name: fn(records) gives groups, with ``mixed`` marked.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_strategy(name: str, strategy: Callable[[DataFrame], DataFrame]) -> None:
    if name in STRATEGIES:
        raise ValueError(f"match strategy {name} is registered already")
    STRATEGIES[name] = strategy


def group_sum(records: DataFrame) -> DataFrame:
    return match_groups(records, on_mixed="mark")


register_strategy("group-sum", group_sum)
