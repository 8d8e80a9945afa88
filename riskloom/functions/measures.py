"""Money, time, geography, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
BANDS = (("CRITICAL", 80), ("HIGH", 60), ("MEDIUM", 30))


def minor_units(amount: Column) -> Column:
    """Whole minor units of a decimal amount; a float never goes further than this."""
    return F.round(amount * 100).cast("long")


def has_offset(text: Column) -> Column:
    """RFC 3339 with an explicit offset; naive times fail."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")


def parse_instant(text: Column) -> Column:
    return F.when(has_offset(text), F.try_to_timestamp(F.upper(text)))


def lag_seconds(occurred: Column, ingested: Column) -> Column:
    return (F.unix_micros(ingested) - F.unix_micros(occurred)) / F.lit(1_000_000.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))


def band(score: Column) -> Column:
    """LOW below the first threshold of BANDS; null scores stay null."""
    out = F.when(score.isNotNull(), F.lit("LOW"))
    for name, least in reversed(BANDS):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out
