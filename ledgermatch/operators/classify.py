"""Classification: each match group is clean or has exactly one discrepancy type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import fingerprint
from ..schema import TYPES


@dataclass(frozen=True)
class Roles:
    """Roles of a segment's sides; a side of the spine role makes a one-sided group a broken bridge."""

    left: str
    right: str
    spine: str | None = None
    stage: str | None = None


@dataclass(frozen=True)
class PolicyRule:
    """``action`` is 'suppress' or 'retype' where the SQL predicate holds; rules of higher salience come first."""

    predicate: str
    action: str
    to_type: str | None = None
    salience: int = 0


@dataclass(frozen=True)
class Rule:
    """``evaluator`` is EXACT, TOLERANCE, POLICY or a registered one; ``enabled`` None means all types."""

    evaluator: str = "EXACT"
    enabled: tuple[str, ...] | None = None
    abs_minor: int = 0
    bps: int = 0
    fx_tolerance: int | None = None
    window: tuple[str, str] | None = None
    policies: tuple[PolicyRule, ...] = field(default=())


def _by_segment(roles: dict[str, Roles], value) -> Column:
    out = F.lit(None).cast("string")
    for segment, r in roles.items():
        out = F.when(F.col("segment_id") == segment, F.lit(value(r)).cast("string")).otherwise(out)
    return out


def primary_type(groups: DataFrame, roles: dict[str, Roles], rule: Rule) -> DataFrame:
    """Adds type (null: clean), stage, expected, actual, delta and currency. The order of the conditions is the contract."""
    c = F.col
    left_only, right_only = c("presence") == "LEFT_ONLY", c("presence") == "RIGHT_ONLY"
    spine_right = F.coalesce(_by_segment(roles, lambda r: "y" if r.spine and r.right == r.spine else None) == "y", F.lit(False))
    spine_left = F.coalesce(_by_segment(roles, lambda r: "y" if r.spine and r.left == r.spine else None) == "y", F.lit(False))
    other_currency = c("left_currency") != c("right_currency")
    based = other_currency & c("left_base").isNotNull() & c("right_base").isNotNull()
    within = F.abs(c("left_base") - c("right_base")) <= F.lit(rule.fx_tolerance or 0)
    several, unequal = (c("left_count") > 1) | (c("right_count") > 1), c("left_sum") != c("right_sum")
    day = lambda t: F.floor(F.unix_timestamp(t) / 86400)
    timing = day(c("left_posted")) != day(c("right_posted"))
    if rule.window:
        low, high = (F.lit(t).cast("timestamp") for t in rule.window)
        timing = timing & c("left_posted").between(low, high) & c("right_posted").between(low, high)
    clean = F.lit(None).cast("string")
    kind = (
        F.when(left_only & spine_right, "BRIDGE_BROKEN").when(left_only, "MISSING")
        .when(right_only & spine_left, "BRIDGE_BROKEN").when(right_only, "EXTRA")
        .when(based & within, clean).when(based, "FX_RATE_DIFF").when(other_currency, "CURRENCY_MISMATCH")
        .when(c("left_copies") | c("right_copies"), "DUPLICATE")
        .when(several & unequal, "GROUP_SUM_MISMATCH").when(several, clean)
        .when(unequal, "AMOUNT_MISMATCH")
        .when(c("left_status") != c("right_status"), "STATUS_MISMATCH")
        .when(timing, "TIMING")
    )
    fx, money = c("type") == "FX_RATE_DIFF", c("type") == "CURRENCY_MISMATCH"
    flat = c("type").isin("CURRENCY_MISMATCH", "STATUS_MISMATCH", "TIMING")
    expected = F.when(fx, c("left_base")).when(c("presence") == "RIGHT_ONLY", F.lit(0)).otherwise(c("left_sum"))
    actual = F.when(fx, c("right_base")).when(c("presence") == "LEFT_ONLY", F.lit(0)).otherwise(c("right_sum"))
    out = groups.withColumn("type", kind)
    out = out.withColumns({
        "stage": F.when(c("type") == "BRIDGE_BROKEN", _by_segment(roles, lambda r: r.stage)),
        "expected": F.when(c("type").isNotNull(), expected).cast("long"), "actual": F.when(c("type").isNotNull(), actual).cast("long"),
        "currency": F.when(fx | money, F.lit(None)).when(c("type").isNotNull(), F.coalesce("left_currency", "right_currency")),
    })
    return out.withColumn("delta", F.when(flat, F.lit(0)).otherwise(c("expected") - c("actual")).cast("long"))


def _keep_enabled(kind: Column, enabled: tuple[str, ...] | None) -> Column:
    return kind if enabled is None else F.when(kind.isin(*enabled) if enabled else F.lit(False), kind)


def _tolerated(rule: Rule) -> Column:
    off = F.abs(F.col("delta"))
    close = (F.lit(rule.abs_minor > 0) & (off <= rule.abs_minor)) | (F.lit(rule.bps > 0) & (off * 10000 <= F.lit(rule.bps) * F.abs(F.col("expected"))))
    return F.coalesce((F.col("type") == "AMOUNT_MISMATCH") & close, F.lit(False))


def default_policies(rule: Rule) -> tuple[PolicyRule, ...]:
    """Policy rules that say the same as the exact and tolerance evaluators."""
    return PolicyRule("not type_enabled", "suppress", salience=100), PolicyRule("type = 'AMOUNT_MISMATCH' and within_amount_tolerance", "suppress", salience=90)


def _exact(groups: DataFrame, rule: Rule) -> Column:
    return _keep_enabled(F.col("type"), rule.enabled)


def _tolerance(groups: DataFrame, rule: Rule) -> Column:
    return F.when(~_tolerated(rule), _keep_enabled(F.col("type"), rule.enabled))


def _policy(groups: DataFrame, rule: Rule) -> Column:
    """Rules are applied by falling salience; a later retyping replaces an earlier one, and a suppression that holds wins over all of them.

    Predicates see the group's columns and the facts multi_line, type_enabled, within_amount_tolerance and abs_delta. A bad
    predicate fails here, when the plan is built.
    """
    kind, suppressed = F.col("type"), F.lit(False)
    for p in sorted((*rule.policies, *default_policies(rule)), key=lambda p: -p.salience):
        if p.action not in ("suppress", "retype") or p.action == "retype" and p.to_type not in TYPES:
            raise ValueError(f"bad policy {p}")
        groups.select(F.expr(p.predicate).cast("boolean"))
        holds = F.col("type").isNotNull() & F.coalesce(F.expr(p.predicate), F.lit(False))
        if p.action == "suppress":
            suppressed = suppressed | holds
        else:
            kind = F.when(holds, F.lit(p.to_type)).otherwise(kind)
    return F.when(~suppressed, kind)


def with_facts(groups: DataFrame, rule: Rule) -> DataFrame:
    """Groups with what policies may ask beside the groups' own columns."""
    return groups.withColumns({
        "multi_line": (F.col("left_count") > 1) | (F.col("right_count") > 1), "type_enabled": _keep_enabled(F.col("type"), rule.enabled).isNotNull(),
        "within_amount_tolerance": _tolerated(rule), "abs_delta": F.abs(F.col("delta")),
    })


FACTS = ["multi_line", "type_enabled", "within_amount_tolerance", "abs_delta"]
#: Evaluators by name: fn(groups with their types, rule) gives the type that is left (null: clean).
EVALUATORS: dict[str, Callable[[DataFrame, Rule], Column]] = {}


def register_evaluator(name: str, evaluator: Callable[[DataFrame, Rule], Column]) -> None:
    if name in EVALUATORS:
        raise ValueError(f"evaluator {name} is registered already")
    EVALUATORS[name] = evaluator


for _name, _evaluator in (("EXACT", _exact), ("TOLERANCE", _tolerance), ("POLICY", _policy)):
    register_evaluator(_name, _evaluator)


def classify(groups: DataFrame, roles: dict[str, Roles], rule: Rule, *, scenario: str, period: str) -> DataFrame:
    """Groups with the type that the rule's evaluator leaves, ``raw_type`` before it, and the discrepancy's fingerprint.

    A fingerprint holds no run, so it is the same in every run; groups without a match key stand in it by the reference of their record.
    An unknown evaluator fails, and so does a policy with a bad predicate, when the plan is built.
    """
    if rule.evaluator not in EVALUATORS:
        raise ValueError(f"unknown evaluator {rule.evaluator}; known: {sorted(EVALUATORS)}")
    out = with_facts(primary_type(groups, roles, rule).withColumn("raw_type", F.col("type")), rule)
    out = out.withColumn("type", EVALUATORS[rule.evaluator](out, rule)).drop(*FACTS)
    out = out.withColumn("stage", F.when(F.col("type") == "BRIDGE_BROKEN", F.col("stage")))
    # A group without a match key is one side's records of one reference, which stands behind the side in null_ref. It is taken from there, so that who asks for fingerprints only needs no minima of references.
    slot = F.coalesce("match_key", F.when(F.instr("null_ref", ":") > 0, F.substring("null_ref", F.instr("null_ref", ":") + 1, F.length("null_ref"))))
    mark = fingerprint(scenario, period, F.col("segment_id"), F.col("type"), F.col("group_key"), slot, F.col("stage"))
    return out.withColumn("fingerprint", F.when(F.col("type").isNotNull(), mark))


def discrepancies(classified: DataFrame) -> DataFrame:
    """The groups that are not clean, as rows of the discrepancy table."""
    return classified.where("type is not null").select("run_id", "segment_id", "fingerprint", "type", "stage", "match_key", "group_key", "currency", "expected", "actual", "delta", "left_ref", "right_ref")
