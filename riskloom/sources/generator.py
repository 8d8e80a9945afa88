"""A reproducible generator: every column is hashed from the row's number and the seed, so partitions, retries and
cluster size do not change a row, as random functions seeded by partition would."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCENARIOS = (
    "ACCOUNT_TAKEOVER", "CARD_TESTING", "IMPOSSIBLE_TRAVEL", "VELOCITY_ATTACK", "DEVICE_FARM", "FRAUD_RING", "MERCHANT_COLLUSION", "CREDENTIAL_STUFFING", "HIGH_VALUE", "UNUSUAL_DEVICE",
)


def unit(seed: int, label: str, *of: Column) -> Column:
    """A number in (0, 1) that depends on seed, label and ``of`` alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(label), *of), 11) + 0.5) / float(1 << 53)


def pick(u: Column, n: int) -> Column:
    return F.floor(u * n).cast("long")


def transactions(spark: SparkSession, n: int, seed: int = 42, accounts: int | None = None, days: int = 30, positive: float = 0.005) -> DataFrame:
    """``n`` transactions with diurnal times, lognormal amounts, Zipf-like merchants and home places; a share of
    ``positive`` rows carries one of ten scenarios, written over the plain values."""
    accounts = accounts or max(1, n // 50)
    row = F.col("id")
    u = lambda label, *of: unit(seed, label, *(of or (row,)))
    account = pick(u("account"), accounts)
    normal = lambda label, *of: F.sqrt(-2 * F.ln(u(label + "a", *of))) * F.cos(2 * math.pi * u(label + "b", *of))
    df = spark.range(n).withColumn("account", account)
    hour = 14 + 4 * normal("hour")  # most events in the afternoon, wrapped into the day
    second = F.pmod(hour, F.lit(24.0)) * 3600
    at = F.lit(1_704_067_200) + pick(u("day"), days) * 86_400 + second
    fraud = u("fraud") < positive
    kind = F.when(fraud, F.element_at(F.array(*map(F.lit, SCENARIOS)), (pick(u("kind"), len(SCENARIOS)) + 1).cast("int")))
    home_lat, home_lon = 60 * u("lat", F.col("account")) - 10, 300 * u("lon", F.col("account")) - 150
    far = kind == "IMPOSSIBLE_TRAVEL"
    amount = F.exp(3.2 + 0.9 * normal("amount"))
    amount = F.when(kind == "HIGH_VALUE", amount * 60).when(kind == "CARD_TESTING", F.lit(1.0) + u("tiny")).otherwise(amount)
    device = F.when(F.coalesce(kind.isin("DEVICE_FARM", "FRAUD_RING"), F.lit(False)), F.concat(F.lit("dev_farm"), pick(u("farm"), 5))).otherwise(F.concat(F.lit("dev_"), F.col("account"), F.lit("x"), pick(u("device"), 2)))
    return df.select(
        F.concat(F.lit("act_"), row).alias("transaction_id"), F.concat(F.lit("acc_"), "account").alias("account_id"), F.timestamp_micros((at * 1_000_000).cast("long")).alias("occurred_at"),
        F.round(amount * 100).cast("long").alias("amount_minor"), F.lit("EUR").alias("currency"), F.concat(F.lit("mer_"), F.floor(200 * F.pow(u("merchant"), F.lit(3.0))).cast("long")).alias("merchant_id"),
        device.alias("device_id"), F.round(F.when(far, -home_lat).otherwise(home_lat) + 0.05 * normal("dlat"), 6).alias("lat"), F.round(F.when(far, -home_lon).otherwise(home_lon) + 0.05 * normal("dlon"), 6).alias("lon"),
        fraud.alias("is_fraud"), kind.alias("fraud_pattern"))


def split_labels(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transactions without labels, labels): the two go to separate namespaces."""
    labels = df.select(F.col("transaction_id").alias("tx_id"), "is_fraud", "fraud_pattern", F.when(F.col("is_fraud"), F.array("fraud_pattern")).otherwise(F.array().cast("array<string>")).alias("causal_evidence_keys"))
    return df.drop("is_fraud", "fraud_pattern"), labels
