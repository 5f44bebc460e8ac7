"""Fixed names and table schemas of the reconciliation data model. Money is always a signed long of minor units."""

from __future__ import annotations

# Fixed values, as stored in tables.
ENTRY_TYPES = ["ISSUE", "REFUND", "REVERSAL"]
ROLES = ["MARKETING", "ACCOUNTING", "CHANNEL"]
LEFT, RIGHT = "LEFT", "RIGHT"
TYPES = ["AMOUNT_MISMATCH", "BRIDGE_BROKEN", "CURRENCY_MISMATCH", "DUPLICATE", "EXTRA", "FX_RATE_DIFF", "GROUP_SUM_MISMATCH", "MISSING", "STATUS_MISMATCH", "TIMING"]
CLEAN = "CLEAN"

RECORDS = """run_id string, segment_id string, side string, source_role string, match_key string, group_key string, bucket int,
currency string, signed_amount_minor long, base_amount_minor long, fx_rate decimal(20,10), fx_rate_time timestamp, fx_rate_source string,
entry_type string, biz_status string, biz_time timestamp, posting_time timestamp, raw_ref string, record_id string"""
REJECT_COLUMNS = ["run_id", "segment_id", "side", "raw_ref", "reason", "payload"]
REJECTS = "run_id string, segment_id string, side string, raw_ref string, reason string, payload string"
DISPOSITIONS = "fingerprint string, scenario string, period string, status string, version long, operator string, note string, last_seen_run string, updated_at timestamp"
ACTIONS = "idempotency_key string, fingerprint string, run_id string, action string, operator string, payload string, created_at timestamp"
OBSERVATIONS = "tenant_id string, event_id string, issue_id string, sku_id string, quantity long, status string, provider_ref string, role string, occurred_at timestamp, raw_ref string"
