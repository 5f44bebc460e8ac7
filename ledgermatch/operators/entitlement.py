"""Quantity reconciliation of entitlements in three roles, with any number of labels for each issue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values, in the order in which labels are listed.
LABELS = ["MISSING_INTERNAL", "MISSING_PROVIDER", "EXTRA_INTERNAL", "EXTRA_PROVIDER", "DUPLICATE_INTERNAL", "DUPLICATE_PROVIDER", "QUANTITY_MISMATCH", "SKU_MISMATCH", "STATUS_MISMATCH", "PROVIDER_REFERENCE_MISMATCH", "UNKNOWN"]

OBSERVED = ["tenant_id", "event_id", "issue_id", "sku_id", "quantity", "status", "provider_ref", "role", "raw_ref"]


def split_observations(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): text fields must not be blank, quantities must be positive."""
    blank = lambda c: F.coalesce(F.length(F.trim(F.col(c))), F.lit(0)) == 0
    reason = F.coalesce(*[F.when(blank(c), F.lit(f"{c} is required")) for c in ("tenant_id", "event_id", "issue_id", "sku_id", "status", "role", "raw_ref")], F.when(F.coalesce(F.col("quantity") <= 0, F.lit(True)), F.lit("quantity must be positive")))
    marked = observations.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def entitlement_groups(observations: DataFrame) -> DataFrame:
    """One row for each tenant and issue: counts, quantities and sets by role.

    Copies of an event are counted first, so that repeats show and hot issues shrink before they meet. Quantities leave out
    REVERSED and FAILED; overflow fails.
    """
    counted = ~F.col("status").isin("REVERSED", "FAILED")
    once = observations.groupBy("tenant_id", "issue_id", "role", "event_id", "sku_id", "status", "provider_ref").agg(F.count("*").alias("n"), F.sum(F.when(counted, F.col("quantity")).otherwise(0)).alias("quantity"))
    events = once.groupBy("tenant_id", "issue_id", "role", "event_id").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"), F.collect_set("sku_id").alias("skus"), F.collect_set("status").alias("statuses"), F.collect_set(F.when(F.length(F.trim("provider_ref")) > 0, F.col("provider_ref"))).alias("refs"))
    columns = []
    for role, p in (("EXPECTED", "e"), ("INTERNAL", "i"), ("PROVIDER", "p")):
        of = lambda c, role=role: F.when(F.col("role") == role, F.col(c))
        columns += [F.count(of("n")).alias(f"{p}_n"), F.coalesce(F.sum(of("quantity")), F.lit(0)).alias(f"{p}_quantity"), F.coalesce(F.max(of("n")) > 1, F.lit(False)).alias(f"{p}_repeats")]
        columns += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(of(c))))).alias(f"{p}_{c}") for c in ("skus", "statuses", "refs")]
    return events.groupBy("tenant_id", "issue_id").agg(*columns)


def entitlement_labels(groups: DataFrame) -> DataFrame:
    """Groups with ``labels`` in the fixed order, or CLEAN."""
    c = F.col
    e, i, p = c("e_quantity"), c("i_quantity"), c("p_quantity")
    skus = F.size(F.array_distinct(F.concat("e_skus", "i_skus", "p_skus")))
    states = F.array_distinct(F.concat("i_statuses", "p_statuses"))
    known = F.size(F.array_remove(states, "UNKNOWN"))
    conditions: list[Column] = [
        (c("i_n") == 0) & (e > 0), (c("p_n") == 0) & (e > 0), (e == 0) & (i > 0), (e == 0) & (p > 0), c("i_repeats"), c("p_repeats"),
        ~((e == i) & (i == p)), skus > 1, known > 1, (F.size("i_refs") > 0) & (F.size("p_refs") > 0) & (c("i_refs") != c("p_refs")), F.array_contains(states, "UNKNOWN"),
    ]
    labels = F.array_compact(F.array(*[F.when(x, F.lit(name)) for x, name in zip(conditions, LABELS)]))
    return groups.withColumn("labels", F.when(F.size(labels) == 0, F.array(F.lit("CLEAN"))).otherwise(labels))


def reconcile_entitlements(sides: dict[str, DataFrame], tenant_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(labelled groups, rejects) of the observations of the roles EXPECTED, INTERNAL and PROVIDER, of one tenant or all."""
    parts = [df.withColumn("role", F.lit(role)).select(*OBSERVED) for role, df in sides.items()]
    observed = reduce(DataFrame.unionByName, parts)
    if tenant_id is not None:
        observed = observed.where(F.col("tenant_id") == tenant_id)
    valid, rejects = split_observations(observed)
    return entitlement_labels(entitlement_groups(valid)), rejects
