"""Ten fraud scenarios. Their predicates are this library's own: each is a function of transaction and identity events
(account, device, merchant, at, amount, kind, ...), with its thresholds as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.measures import haversine_km

from . import graph, metrics, timeline


def account_takeover(events: DataFrame, changes: DataFrame, least_z: float = 3.0, within: int = 86_400) -> DataFrame:
    """Transactions of unusual amount at most ``within`` seconds after an identity change of their account."""
    z = metrics.robust_z(events, "account", "amount").filter(F.col("robust_z") >= least_z)
    changed = changes.select("account", "at", F.col("event_id").alias("change_id"), F.unix_micros("at").alias("changed_us"))
    out = timeline.asof(z, changed, "account", "at", "event_id", "change_id", ["change_id", "changed_us"])
    return out.filter(F.unix_micros("at") - F.col("changed_us") <= within * 1_000_000)


def card_testing(events: DataFrame, small: float = 5.0, least: int = 3, within: int = 300) -> DataFrame:
    """Small amounts that come ``least`` or more within ``within`` seconds on one account."""
    rows = timeline.trailing(events.filter(F.col("amount") <= small), "account", "at", {"burst": (within, F.count(F.lit(1)))})
    return rows.filter(F.col("burst") >= least)


def impossible_travel(events: DataFrame, kmh: float = 900.0) -> DataFrame:
    """Events too far from the account's previous one for the time between; rows without a place are left out."""
    here = events.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    out = timeline.last_before(here, "account", ["at", "event_id"], "at", F.struct("lat", "lon", F.unix_micros("at").alias("us")), "before")
    out = out.withColumn("km", haversine_km(F.col("before.lat"), F.col("before.lon"), F.col("lat"), F.col("lon")))
    hours = (F.unix_micros("at") - F.col("before.us")) / 3.6e9
    return out.filter(F.col("km") > kmh * hours).filter("km > 1").drop("before")


def velocity_attack(events: DataFrame, minute: int = 3, five: int = 6) -> DataFrame:
    one = F.count(F.lit(1))
    rows = timeline.trailing(events, "account", "at", {"n_1m": (60, one), "n_5m": (300, one)})
    return rows.filter((F.col("n_1m") >= minute) | (F.col("n_5m") >= five))


def device_farm(events: DataFrame, least: int = 5) -> DataFrame:
    """Devices that ``least`` or more accounts use."""
    return graph.shared(events, "device", "account", least).groupBy("device").agg(F.max("sharers").alias("accounts"))


def fraud_ring(events: DataFrame, least_shared: int = 2, least_size: int = 3) -> DataFrame:
    """Components of accounts and devices, with size and density; only devices that several accounts use count."""
    uses = graph.shared(events, "device", "account", least_shared)
    edges = graph.cut(uses.select(F.concat(F.lit("a"), "account").alias("src"), F.concat(F.lit("d"), "device").alias("dst")).distinct())
    nodes = graph.components(edges)
    joined = edges.join(nodes.withColumnRenamed("node", "src"), "src")
    sizes = nodes.groupBy("component").agg(F.sum(F.col("node").startswith("a").cast("long")).alias("accounts"), F.sum(F.col("node").startswith("d").cast("long")).alias("devices"))
    out = sizes.join(joined.groupBy("component").agg(F.count(F.lit(1)).alias("links")), "component").filter(F.col("accounts") >= least_size)
    return out.withColumn("density", F.col("links") / (F.col("accounts") * F.col("devices")))


def merchant_collusion(sales: DataFrame, least: int = 10, share: float = 0.6) -> DataFrame:
    return graph.collusion(sales, "merchant", "account", "flagged", least, share)


def credential_stuffing(logins: DataFrame, least: int = 5, within: int = 3600) -> DataFrame:
    """Origins from which logins to ``least`` or more accounts fail within an hour's window."""
    failed = logins.filter("not success")
    start = F.floor(F.unix_micros("at") / (within * 1_000_000)) * within
    return failed.groupBy("ip", start.alias("window_start")).agg(F.count_distinct("account").alias("accounts"), F.count(F.lit(1)).alias("failures")).filter(F.col("accounts") >= least)


def high_value(events: DataFrame, least_z: float = 3.5) -> DataFrame:
    return metrics.robust_z(events, "account", "amount").filter(F.col("robust_z") > least_z)


def unusual_device(events: DataFrame, after: int = 86_400) -> DataFrame:
    """First use of a device by an account that is known for longer than ``after`` seconds."""
    first = events.groupBy("account", "device").agg(F.min(F.struct("at", "event_id")).alias("f"))
    known = events.groupBy("account").agg(F.min("at").alias("since"))
    out = first.join(known, "account").select("account", "device", F.col("f.at").alias("at"), F.col("f.event_id").alias("event_id"), "since")
    return out.filter(F.unix_micros("at") - F.unix_micros("since") > after * 1_000_000)
