"""The driver tables as this engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its times have no zone and are read as UTC, so the session must say UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts (an instant), event_type, value, device."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("device"))


#: The same in the oracle's SQL.
EVENTS = "(SELECT event_id, user_id, ts, event_type, value, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) AS device FROM events)"


def fraud_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the scenarios name their columns."""
    return events(spark, sf_dir).select("event_id", F.col("user_id").alias("account"), F.col("ts").alias("at"), F.col("value").alias("amount"), "device", "event_type")


def ntz(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)
