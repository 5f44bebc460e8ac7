"""How a source's columns become those of records."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SourceMapping:
    """Names of a source's columns. Optional ones may be None; ``table`` names the source in references to its rows.

    ``match_expr`` and ``group_expr`` are SQL expressions over the source's columns that take the place of the key columns.
    """

    table: str
    id: str = "id"
    match_key: str | None = None
    group_key: str = "group_key"
    currency: str = "ccy"
    amount: str = "amount_minor"
    entry_type: str | None = "entry_type"
    biz_status: str | None = "biz_status"
    biz_time: str | None = "biz_time"
    posting_time: str | None = "posting_time"
    base_amount: str | None = None
    tenant: str | None = None
    match_expr: str | None = None
    group_expr: str | None = None

    def required(self) -> list[str]:
        names = [self.id, None if self.match_expr else self.match_key, None if self.group_expr else self.group_key, self.currency, self.amount, self.entry_type, self.biz_status, self.biz_time, self.posting_time, self.base_amount, self.tenant]
        return [n for n in names if n]


@dataclass(frozen=True)
class ReadContext:
    """Run, segment and side that a source is read for; the filter and tenant are optional."""

    run_id: str
    segment_id: str
    side: str
    role: str
    cutoff: str | None = None
    tenant_id: str | None = None
    extra: dict = field(default_factory=dict)
