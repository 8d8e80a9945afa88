"""Checks at the edge: envelopes, clocks, schemas, enums, coverage, trust."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schemas import ATTACKER_FIELDS, ENVELOPE, PAYLOADS, TRUST_TIERS

FUTURE_SECONDS, PAST_SECONDS = 24 * 3600, 90 * 24 * 3600
LONGEST_UNTRUSTED = 256


def errors(*rules: tuple[str, Column]) -> Column:
    """Names of the rules whose condition is true, in order; a null condition is no error."""
    return F.filter(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules]), lambda e: e.isNotNull())


def missing_fields(fields: list[str] | None = None) -> Column:
    return errors(*[(f, F.col(f).isNull()) for f in fields or ENVELOPE.names])


def clock_verdict(at: Column, reference: Column) -> Column:
    """REJECT over 24 h ahead of the reference, FLAG over 90 days behind it, else OK."""
    ahead = F.unix_micros(at) - F.unix_micros(reference)
    return F.when(ahead > FUTURE_SECONDS * 1_000_000, "REJECT").when(-ahead > PAST_SECONDS * 1_000_000, "FLAG").otherwise("OK")


def known_or(column: Column, known: list[str], other: str = "UNKNOWN") -> Column:
    return F.when(column.isin(*known), column).otherwise(F.lit(other))


def typed_payload(payload: Column, event_type: str, version: int) -> Column:
    """The payload as its declared struct; null where the JSON is malformed."""
    return F.from_json(payload, PAYLOADS[event_type, version], {"mode": "PERMISSIVE"})


def extra_fields(payload: Column, schema: T.StructType) -> Column:
    return F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), F.array(*map(F.lit, schema.names)))


def route(df: DataFrame, found: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(valid rows, dead letters): split on the error list."""
    return df.filter(F.size(found) == 0).drop(found), df.filter(F.size(found) > 0)


def dead_letters(df: DataFrame, consumer: str, version: str, found: str = "errors") -> DataFrame:
    """Rejected rows as they came, with what is wrong and who says so."""
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c != found])).alias("envelope"), F.col(found).alias("errors"), F.lit(consumer).alias("consumer"), F.lit(version).alias("consumer_version"))


def poisoned(attempts: Column, most: int = 3) -> Column:
    return attempts >= most


def covered(required: list[str], coverage: Column) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, required)), coverage)) == 0


def gated(value: Column, required: list[str], coverage: Column) -> Column:
    """The value where the source supplies every field it needs, else null: unavailable, which is not zero."""
    return F.when(covered(required, coverage), value)


def stamped(df: DataFrame) -> DataFrame:
    """Attacker-controlled fields cut to a length and marked UNTRUSTED in their metadata, and a ``trust_tier`` for the
    row: the least trusted of the fields it holds."""
    for name in ATTACKER_FIELDS:
        if name in df.columns:
            df = df.withColumn(name, F.substring(name, 1, LONGEST_UNTRUSTED)).withMetadata(name, {"trust_tier": "UNTRUSTED"})
    held = [F.col(c).isNotNull() for c in ATTACKER_FIELDS if c in df.columns]
    any_held = held[0] if held else F.lit(False)
    for h in held[1:]:
        any_held = any_held | h
    return df.withColumn("trust_tier", F.when(any_held, "UNTRUSTED").otherwise("SYSTEM"))


def least_trusted(*tiers: Column) -> Column:
    order = F.array(*map(F.lit, TRUST_TIERS))
    # a tier that is unknown or missing counts as the least trusted
    rank = lambda c: F.coalesce(F.nullif(F.array_position(order, c), F.lit(0)), F.lit(len(TRUST_TIERS))).cast("int")
    return F.element_at(order, rank(tiers[0]) if len(tiers) == 1 else F.greatest(*map(rank, tiers)))


def pinned(expected: dict[str, str], actual: dict[str, str]) -> list[str]:
    """What is wrong with installed versions against pins: unknown, missing, or another version. A pin of 3.4 accepts
    3.4.9 and not 3.40, as whole dotted parts are compared."""
    found = []
    for name, pin in expected.items():
        got = actual.get(name)
        if got is None:
            found.append(f"{name}: missing")
        elif got.split(".")[: len(pin.split("."))] != pin.split("."):
            found.append(f"{name}: {got} is not {pin}")
    return found + [f"{name}: no pin" for name in actual if name not in expected]


def schema_text(schema: T.StructType) -> str:
    return json.dumps(schema.jsonValue(), sort_keys=True)
