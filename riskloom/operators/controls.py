"""Scope, visibility, limits, late rows, parity and rates; and text that may carry instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import timeline

#: Patterns of instructions addressed to a model, this library's own.
INJECTIONS = (r"(?i)ignore (all|any|previous|prior) instructions", r"(?i)system prompt", r"(?i)you are now", r"(?i)disregard .{0,20}(above|previous)", r"(?i)<\s*script", r"(?i)\bBEGIN (RSA|OPENSSH)")


def in_scope(df: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Rows of the entities that ``scope`` (key) names."""
    return df.join(scope.select(key), key, "left_semi")


def visible(cases: DataFrame, user: str, role: str) -> DataFrame:
    """Managers see all cases, others their own and those assigned to nobody."""
    return cases if role == "manager" else cases.filter(F.col("assignee").isNull() | (F.col("assignee") == user))


def tripped(actions: DataFrame, key: str, at: str, most: int, seconds: int = 3600) -> DataFrame:
    """(key, window, actions): windows in which a key took more than ``most`` actions; combined map-side."""
    window = F.floor(F.unix_micros(at) / (seconds * 1_000_000)).alias("window")
    return actions.groupBy(key, window).agg(F.count(F.lit(1)).alias("actions")).filter(F.col("actions") > most)


def marked_late(rows: DataFrame, batch: str, at: str, delay: int = 600) -> DataFrame:
    """``rows`` with ``is_late``: older than the greatest time of all earlier batches, less ``delay`` seconds. The batch
    form of what silver does stream by stream."""
    out = timeline.greatest_before(rows, batch, F.unix_micros(at), "__top")
    return out.withColumn("is_late", F.coalesce(F.unix_micros(at) < F.col("__top") - delay * 1_000_000, F.lit(False))).drop("__top")


def parity(offline: DataFrame, online: DataFrame, key: str) -> DataFrame:
    """Both stores' values of each key, with ``equal``: null-safe, so that a key that one side lacks differs."""
    both = offline.join(online, key, "full_outer")
    pairs = [(a, b) for a, b in zip([c for c in offline.columns if c != key], [c for c in online.columns if c != key], strict=True)]
    equal = F.lit(True)
    for a, b in pairs:
        equal = equal & F.col(a).eqNullSafe(F.col(b))
    return both.withColumn("equal", equal)


def rates(df: DataFrame, by: str, **conditions: Column) -> DataFrame:
    """(by, calls, a share for each condition); a null condition counts as not met."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), *[share(c).alias(name) for name, c in conditions.items()])


def token_cost(usage: DataFrame, prices: DataFrame, kind: str, tokens: Column, by: str) -> DataFrame:
    """(by, cost): tokens times the price of their kind. ``prices`` (kind, rate) has a row a kind, so it is broadcast."""
    return usage.withColumn("__n", tokens).join(F.broadcast(prices), kind).groupBy(by).agg(F.sum(F.col("__n") * F.col("rate")).alias("cost"))


def percentiles(df: DataFrame, by: str, value: Column, **at: float) -> DataFrame:
    """(by, one column for each percentile, mean); exact, so the state is one entry for each distinct value of a group."""
    return df.groupBy(by).agg(*[F.percentile(value, p).alias(name) for name, p in at.items()], F.avg(value).alias("mean"))


def attempts(text: Column, patterns: tuple[str, ...] = INJECTIONS) -> Column:
    """What in a text looks like instructions to a model: all matches, pattern by pattern. Null gives none."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in patterns]
    return F.concat(*found)


def stripped(text: Column, patterns: tuple[str, ...] = INJECTIONS) -> Column:
    """The text without them; what two removals bring together is looked at by the patterns that follow."""
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def disarmed(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with the untrusted ``columns`` stripped and ``injection_attempts`` counted, and what was found, a row a hit
    (key, field, hit), to be attached to the case."""
    hits = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), attempts(F.col(c)).alias("hits")) for c in columns])).alias("f"))
    hits = hits.select(key, F.col("f.field").alias("field"), F.explode("f.hits").alias("hit"))
    count = sum((F.size(attempts(F.col(c))) for c in columns), F.lit(0))
    return df.withColumn("injection_attempts", count).withColumns({c: stripped(F.col(c)) for c in columns}), hits
