"""Tables and closed vocabularies of the ledger. Nothing is inferred; absent values stay NULL."""

from __future__ import annotations

#: The counterparty that marks a movement between one's own accounts, and its reserved namespace.
RESERVED = "urn:ledger:"
SELF = RESERVED + "self"

# Closed vocabularies.
CURRENCIES = {"MXN": 2}
DIRECTIONS = ("INFLOW", "OUTFLOW")
RECONCILIATION_STATES = ("UNRECONCILED", "RECONCILED", "CONFLICTED")
FINANCIAL_STATUSES = ("UNKNOWN", "PENDING", "SETTLED", "REVERSED")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
SOURCE_TYPES = ("GMAIL", "BANK_STATEMENT", "MANUAL")
OUTCOMES = ("MATCH", "NO_MATCH", "AMBIGUOUS")
CLAIM_TRANSITIONS = (("PROPOSED", "ACTIVE"), ("PROPOSED", "REJECTED"), ("ACTIVE", "SUPERSEDED"))
CLAIM_FIELDS = (
    "amount_minor", "currency", "merchant", "account_identifier", "direction", "financial_status", "occurred_at",
    "tracking_key", "counterparty",
)
STAGES = ("RECEIVED", "EXTRACTED", "RECONCILED")

TRANSACTION = (
    "id string, source_id string, amount_minor bigint, currency string, merchant string, counterparty string, direction string, "
    "financial_status string, reconciliation_state string, transaction_state string, superseded_by string, occurred_at timestamp, tracking_key string"
)
EVIDENCE = "id string, source_id string, source_type string, source_reference string, content_type string, raw_content binary, observed_at timestamp"
CLAIM_FIELD = "claim_id string, field_name string, value_int bigint, value_text string, confidence string"
CANDIDATE = "left_ref string, right_ref string, status string, basis string"
SOURCES_CONFIG = "sources array<struct<id:string,type:string,query:string,extraction_profile:string>>"
UPLOAD = "source_id string, source_artifact_key string, observed_at string, content_type string, raw_content string"
