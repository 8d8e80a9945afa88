"""Source adapters: each says which canonical fields it supplies and turns its rows into canonical ones."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.ids import typed_id
from riskloom.functions.measures import minor_units
from riskloom.schemas import CANONICAL


@dataclass(frozen=True)
class SourceProfile:
    name: str
    version: str
    field_coverage: tuple[str, ...]
    row_count: int
    digest: str


class SourceAdapter(Protocol):
    name: str
    version: str
    coverage: tuple[str, ...]

    def describe(self) -> SourceProfile: ...

    def to_canonical(self) -> DataFrame: ...

    def label_column(self) -> str | None: ...


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows and a digest that does not depend on their order: sum and xor of row hashes, in one aggregate."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(row, F.lit(1 << 40))).alias("s"), F.bit_xor(row).alias("x")).first()
    return r["n"], f"{r['s'] or 0:x}-{(r['x'] or 0) % (1 << 64):016x}"


def canonical(df: DataFrame, source: str, row_id: Column, coverage: tuple[str, ...], **fields: Column) -> DataFrame:
    """Rows in the canonical schema; a field that is not covered, or does not fit its type, is null."""
    given = {"source_dataset": F.lit(source), "source_row_id": row_id.cast("string"), "field_coverage": F.array(*map(F.lit, coverage))} | fields
    if extra := set(given) - set(CANONICAL.names):
        raise ValueError(f"not canonical: {sorted(extra)}")
    return df.select(*[given.get(f.name, F.lit(None)).try_cast(f.dataType).alias(f.name) for f in CANONICAL])


class _Adapter:
    name = version = ""
    coverage: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def describe(self) -> SourceProfile:
        n, d = digest(self.to_canonical().drop("opaque_features", "opaque_labels", "field_coverage"))
        return SourceProfile(self.name, self.version, self.coverage, n, d)

    def label_column(self) -> str | None:
        return None

    def to_canonical(self) -> DataFrame:
        raise NotImplementedError


class OrdersAdapter(_Adapter):
    """Orders as transactions of customers."""

    name, version, coverage = "orders", "1", ("transaction_id", "account_id", "occurred_at", "amount_minor")

    def to_canonical(self) -> DataFrame:
        o = self.spark.read.parquet(f"{self.path}/orders.parquet")
        return canonical(
            o, self.name, F.col("o_orderkey"), self.coverage, transaction_id=typed_id("act_", F.col("o_orderkey")), account_id=typed_id("acc_", F.col("o_custkey")),
            occurred_at=F.col("o_orderdate").cast("timestamp"), amount_minor=minor_units(F.col("o_totalprice")))


class EventsAdapter(_Adapter):
    """Clickstream events as transactions with a device."""

    name, version, coverage = "events", "1", ("transaction_id", "account_id", "occurred_at", "amount_minor", "device_id")

    def to_canonical(self) -> DataFrame:
        e = self.spark.read.parquet(f"{self.path}/events.parquet")
        return canonical(
            e, self.name, F.col("event_id"), self.coverage, transaction_id=typed_id("act_", F.col("event_id")), account_id=typed_id("acc_", F.col("user_id")),
            occurred_at=F.col("ts").cast("timestamp"), amount_minor=minor_units(F.col("value")), device_id=typed_id("dev_", F.get_json_object("props", "$.k")))


class IdentityAdapter(_Adapter):
    """A transaction table with an identity table beside it and obfuscated columns: numeric V, C and D columns travel in
    a map of doubles, M columns in a map of strings. Files transactions.parquet and identity.parquet."""

    name, version, coverage = "external", "1", ("transaction_id", "occurred_at", "amount_minor", "opaque_features", "opaque_labels", "user_agent")
    epoch = "2017-12-01T00:00:00Z"

    def label_column(self) -> str:
        return "isFraud"

    def to_canonical(self) -> DataFrame:
        tx = self.spark.read.parquet(f"{self.path}/transactions.parquet")
        who = self.spark.read.parquet(f"{self.path}/identity.parquet")
        numeric = [c for c in tx.columns if c[0] in "VCD" and c[1:].isdigit()]
        words = [c for c in tx.columns if c[0] == "M" and c[1:].isdigit()]
        both = tx.join(who.select("TransactionID", *[c for c in ("DeviceInfo",) if c in who.columns]), "TransactionID", "left")
        packed = lambda columns, kind: F.map_filter(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast(kind))]) if columns else F.create_map().cast(f"map<string,{kind}>"), lambda k, v: v.isNotNull())
        at = F.timestamp_seconds(F.unix_seconds(F.lit(self.epoch).cast("timestamp")) + F.col("TransactionDT"))
        fields = {"transaction_id": typed_id("act_", F.col("TransactionID")), "occurred_at": at, "amount_minor": minor_units(F.col("TransactionAmt")), "opaque_features": packed(numeric, "double"), "opaque_labels": packed(words, "string")}
        if "DeviceInfo" in both.columns:
            fields["user_agent"] = F.col("DeviceInfo")
        return canonical(both, self.name, F.col("TransactionID"), self.coverage, **fields)


def coverage_mismatch(df: DataFrame, declared: tuple[str, ...]) -> DataFrame:
    """(field, problem): fields declared but never filled, and fields filled but not declared."""
    own = [f for f in CANONICAL.names if f not in ("source_dataset", "source_row_id", "field_coverage")]
    filled = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in own])
    long = filled.select(F.explode(F.create_map(*[x for c in own for x in (F.lit(c), F.col(c))])).alias("field", "filled"))
    said = F.col("field").isin(*declared)
    return long.select("field", F.when(said & ~F.coalesce("filled", F.lit(False)), "declared, never filled").when(~said & F.col("filled"), "filled, not declared").alias("problem")).filter("problem is not null")
