"""Declarative scenarios: ordered segments with roles, key fields, sources and rules, loadable from JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.classify import EVALUATORS, PolicyRule, Roles, Rule
from ..operators.entitlement import reconcile_entitlements
from ..operators.match import STRATEGIES
from ..schema import TYPES
from ..sources.mapping import SourceMapping
from ..sources.readers import load_table


@dataclass(frozen=True)
class Source:
    """``kind`` is a registered source type; ``location`` what it reads; ``mapping`` names its columns; ``options`` go to the reader,
    such as a JDBC source's url and partition bounds."""

    kind: str
    location: str
    mapping: SourceMapping
    options: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Segment:
    id: str
    left_role: str
    right_role: str
    left: Source
    right: Source
    spine_role: str | None = None
    stage: str | None = None
    rule: Rule = field(default_factory=Rule)
    strategy: str = "group-sum"

    def roles(self) -> Roles:
        return Roles(self.left_role, self.right_role, self.spine_role, self.stage or self.id)


@dataclass(frozen=True)
class Scenario:
    code: str
    segments: tuple[Segment, ...]
    version: int = 1
    enabled: bool = True
    tenant_id: str | None = None

    def validate(self) -> Scenario:
        """Fails on the first thing that would make the plan wrong."""
        if not self.code or not self.code.strip() or len(self.code) > 32:
            raise ValueError("a scenario code has 1 to 32 characters")
        if not self.segments:
            raise ValueError("a scenario needs a segment")
        ids = [s.id for s in self.segments]
        if len(set(ids)) < len(ids) or not all(ids):
            raise ValueError(f"segment ids must be distinct and not empty: {ids}")
        for s in self.segments:
            if s.spine_role and s.spine_role not in (s.left_role, s.right_role):
                raise ValueError(f"segment {s.id}: the spine role is on neither side")
            if s.left_role == s.right_role:
                raise ValueError(f"segment {s.id}: both sides have one role")
            if s.rule.evaluator not in EVALUATORS:
                raise ValueError(f"segment {s.id}: unknown evaluator {s.rule.evaluator}")
            if s.strategy not in STRATEGIES:
                raise ValueError(f"segment {s.id}: unknown match strategy {s.strategy}")
            if s.rule.abs_minor < 0 or s.rule.bps < 0 or (s.rule.fx_tolerance or 0) < 0:
                raise ValueError(f"segment {s.id}: tolerances must not be negative")
            if unknown := set(s.rule.enabled or ()) - set(TYPES):
                raise ValueError(f"segment {s.id}: unknown types {sorted(unknown)}")
            for source in (s.left, s.right):
                m = source.mapping
                if not (m.group_key or m.group_expr) or not (m.match_key or m.match_expr):
                    raise ValueError(f"segment {s.id}: sources need match and group keys, as columns or expressions")
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Scenario:
        raw = json.loads(text)

        def source(x: dict) -> Source:
            return Source(x["kind"], x["location"], SourceMapping(**x["mapping"]), x.get("options", {}))

        def rule(x: dict) -> Rule:
            x = dict(x)
            x["enabled"] = None if x.get("enabled") is None else tuple(x["enabled"])
            x["window"] = None if x.get("window") is None else tuple(x["window"])
            x["policies"] = tuple(PolicyRule(**p) for p in x.get("policies", ()))
            return Rule(**x)

        segments = tuple(Segment(**{**s, "left": source(s["left"]), "right": source(s["right"]), "rule": rule(s.get("rule", {}))}) for s in raw["segments"])
        return cls(raw["code"], segments, raw.get("version", 1), raw.get("enabled", True), raw.get("tenant_id")).validate()


def _chain(code: str, left: Source, spine: Source, right: Source, left_keys: tuple[str, str], right_keys: tuple[str, str], **options) -> Scenario:
    """Two segments that share a spine ledger, read twice with different keys."""
    from dataclasses import replace

    def keyed(s: Source, keys: tuple[str, str]) -> Source:
        return replace(s, mapping=replace(s.mapping, match_key=keys[0], group_key=keys[1]))

    first = Segment("SEG1_MKT_ACCT", "MARKETING", "ACCOUNTING", keyed(left, left_keys), keyed(spine, left_keys), "ACCOUNTING", "SEG1")
    second = Segment("SEG2_ACCT_CHANNEL", "ACCOUNTING", "CHANNEL", keyed(spine, right_keys), keyed(right, right_keys), "ACCOUNTING", "SEG2")
    return Scenario(code, (first, second), **options).validate()


def marketing_three_way(kind: str = "db", tables: tuple[str, str, str] = ("marketing", "accounting", "channel"), locations: tuple[str, str, str] | None = None) -> Scenario:
    a, b, c = (Source(kind, at, SourceMapping(table)) for table, at in zip(tables, locations or tables))
    return _chain("MARKETING_3WAY", a, b, c, ("issue_id", "order_no"), ("channel_serial_no", "channel_serial_no"))


def benefit_cash_three_way(tenant_id: str, kind: str = "db") -> Scenario:
    """The cash tables that events fill, restricted to one tenant."""
    tables = ("recon_ods_cash_expected", "recon_ods_cash_accounting", "recon_ods_cash_channel")
    a, b, c = (Source(kind, t, SourceMapping(t, tenant="tenant_id")) for t in tables)
    return _chain("BENEFIT_CASH_3WAY", a, b, c, ("issue_id", "order_no"), ("channel_serial_no", "channel_serial_no"), tenant_id=tenant_id)


@dataclass(frozen=True)
class EntitlementScenario:
    """Three observed sides of entitlements, which are reconciled by quantity instead of money."""

    code: str
    sides: tuple[Source, Source, Source]
    tenant_id: str | None = None

    def validate(self) -> EntitlementScenario:
        if len(self.sides) != 3:
            raise ValueError("an entitlement scenario has the sides EXPECTED, INTERNAL and PROVIDER")
        return self

    def reconcile(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(labelled groups, rejects) of the sides' tables; the tenant is a filter on their scans."""
        tables = {}
        for role, source in zip(("EXPECTED", "INTERNAL", "PROVIDER"), self.sides):
            df = load_table(spark, source.kind, source.location, **source.options)
            tables[role] = df.where(df[source.mapping.tenant] == self.tenant_id) if self.tenant_id is not None and source.mapping.tenant else df
        return reconcile_entitlements(tables)


def entitlement_fulfillment(kind: str = "db", tenant_id: str | None = None, locations: tuple[str, str, str] | None = None) -> EntitlementScenario:
    """The entitlement tables that events fill, or others of the same columns at ``locations``."""
    tables = [f"recon_ods_entitlement_{role}" for role in ("expected", "internal", "provider")]
    sides = tuple(Source(kind, at, SourceMapping(t, match_key="issue_id", biz_time="occurred_at", tenant="tenant_id")) for t, at in zip(tables, locations or tables))
    return EntitlementScenario("ENTITLEMENT_FULFILLMENT", sides, tenant_id).validate()
