"""Declared schemas. Nothing is inferred: one StructType per event type and schema version."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B, _I, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ENVELOPE = struct(event_id=_S, event_type=_S, schema_version=_I, occurred_at=_TS, ingested_at=_TS, producer=_S, trace_id=_S, correlation_id=_S, idempotency_key=_S, payload=_S)

CANONICAL = struct(
    source_dataset=_S, source_row_id=_S, field_coverage=T.ArrayType(_S), transaction_id=_S, account_id=_S, occurred_at=_TS, amount_minor=_L, currency=_S, merchant_id=_S,
    device_id=_S, ip=_S, lat=_D, lon=_D, merchant_name=_S, user_agent=_S, memo=_S, device_label=_S, opaque_features=T.MapType(_S, _D), opaque_labels=T.MapType(_S, _S),
)

PAYLOADS = {
    ("transaction.created", 1): struct(transaction_id=_S, account_id=_S, amount_minor=_L, currency=_S, merchant_id=_S),
    ("transaction.created", 2): struct(transaction_id=_S, account_id=_S, amount_minor=_L, currency=_S, merchant_id=_S, device_id=_S),
    ("identity.changed", 1): struct(account_id=_S, change=_S),
    ("login.attempted", 1): struct(account_id=_S, ip=_S, success=_B),
}

LABEL = struct(tx_id=_S, is_fraud=_B, fraud_pattern=_S, causal_evidence_keys=T.ArrayType(_S))
EVIDENCE = struct(evidence_id=_S, investigation_id=_S, kind=_S, trust_tier=_S, provenance=_S, query=_S, params=T.MapType(_S, _S), row_count=_I, truncated=_B, data=_S)
EDGE = struct(src=_S, dst=_S, src_type=_S, dst_type=_S, edge_type=_S, props=T.MapType(_S, _S))
AUDIT = struct(seq=_L, occurred_at=_TS, actor=struct(type=_S, id=_S), action=_S, entity=_S, before=_S, after=_S, payload_hash=_S, prev_hash=_S, chain_hash=_S)
CAPABILITY = struct(id=_S, phase=_S, name=_S, status=_S, notes=_S, evidence=struct(command=_S, verified_at=_S, result=_S))
STATUS_FILE = struct(project=_S, current_phase=_S, capabilities=T.ArrayType(CAPABILITY))

#: Fields a run manifest may carry, each as text; a superset of every list that names some.
MANIFEST = struct(**dict.fromkeys(
    "run_id track llm_tier dirty_worktree git_commit started_at finished_at seed dataset_name dataset_version dataset_digest generator_version feature_version model_name model_digest "
    "rules_version prompt_version tool_registry_version provider llm_model temperature max_tokens budget cases python_version spark_version delta_version platform hostname cpu_count".split(), _S))

NODE_TYPES = ("Account", "Device", "IP", "Card", "Merchant")
EDGE_TYPES = ("USED_DEVICE", "USED_IP", "HOLDS", "PAID", "LINKED_TO")
TRUST_TIERS = ("SYSTEM", "DERIVED", "UNTRUSTED")
ATTACKER_FIELDS = ("merchant_name", "user_agent", "memo", "device_label")
TOPICS = ("transactions.v1", "identity.v1", "logins.v1", "scores.v1", "cases.v1", "evidence.v1", "actions.v1", "audit.v1", "features.v1")
