"""Typed ids, trace ids, time-ordered ids, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = ("acc_", "dev_", "mer_", "inv_", "act_")


def typed_id(prefix: str, value: Column) -> Column:
    if prefix not in PREFIXES:
        raise ValueError(f"unknown id prefix {prefix}")
    return F.concat(F.lit(prefix), value.cast("string"))


def is_typed_id(value: Column, prefix: str | None = None) -> Column:
    return value.rlike(f"^{prefix or '(?:' + '|'.join(PREFIXES) + ')'}[0-9A-Za-z]+$")


def is_trace_id(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{32}$") & ~value.rlike("^0+$")


def trace_id(traceparent: Column) -> Column:
    """The 32 hex digits of a traceparent header, null if it is malformed."""
    found = F.regexp_extract(traceparent, "^[0-9a-f]{2}-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}$", 1)
    return F.when(is_trace_id(found), found)


def span_id(traceparent: Column) -> Column:
    found = F.regexp_extract(traceparent, "^[0-9a-f]{2}-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}$", 2)
    return F.when(found.rlike("^[0-9a-f]{16}$") & ~found.rlike("^0+$"), found)


def uuid7(at: Column, seed: Column) -> Column:
    """A version 7 UUID of the instant ``at``, its random part hashed from ``seed``: reruns give the same id."""
    millis = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    rest = F.sha2(seed.cast("string"), 256)
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(rest, 4, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(
        F.substring(millis, 1, 8), F.lit("-"), F.substring(millis, 9, 4), F.lit("-7"), F.substring(rest, 1, 3), F.lit("-"), variant, F.substring(rest, 5, 3), F.lit("-"), F.substring(rest, 8, 12))


def canonical_json(*columns: str) -> Column:
    """JSON of the columns by name, nulls written out, so that a missing value can't hide in a hash."""
    parts = [F.concat(F.lit(f'"{c}":'), F.coalesce(F.to_json(F.array(F.col(c).cast("string"))), F.lit("[null]"))) for c in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def idempotency_key(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)


def token(value: Column, salt: str) -> Column:
    """A salted SHA-256 token; null stays null."""
    return F.sha2(F.concat(F.lit(salt), value), 256)
