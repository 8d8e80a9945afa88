"""Declarative rules: names, versions, predicates and weights as data."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.measures import band


def _read(text: str) -> dict:
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("rules that are not JSON need a YAML parser") from e
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from e


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: str  # a Spark SQL expression
    weight: int
    requires: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleSet:
    version: str
    rules: tuple[Rule, ...]

    @classmethod
    def parse(cls, text: str) -> RuleSet:
        """From JSON, or YAML where a parser is installed: {"version", "rules": [{"name", "when", "weight", "requires"}]};
        names must differ."""
        raw = _read(text)
        rules = tuple(Rule(r["name"], r["when"], int(r["weight"]), tuple(r.get("requires", ()))) for r in raw["rules"])
        if len({r.name for r in rules}) != len(rules):
            raise ValueError("two rules of one name")
        return cls(str(raw["version"]), rules)

    def hits(self) -> Column:
        """Names of the rules that fire; a predicate that is null does not."""
        return F.array_compact(F.array(*[F.when(F.expr(r.predicate), F.lit(r.name)) for r in self.rules]))

    def score(self) -> Column:
        total = F.lit(0)
        for r in self.rules:
            total = total + F.when(F.expr(r.predicate), F.lit(r.weight)).otherwise(F.lit(0))
        return F.least(total, F.lit(100)).cast("long")

    def usable(self, coverage: set[str]) -> RuleSet:
        """Without the rules whose fields a source does not supply: left out before planning, so never computed."""
        return RuleSet(self.version, tuple(r for r in self.rules if set(r.requires) <= coverage))


class RuleFile:
    """Rules that are read again when their file has changed; a file that does not parse leaves the old ones."""

    def __init__(self, path: str):
        self.path, self.seen, self.rules, self.error = path, None, None, ""

    def current(self) -> RuleSet:
        stamp = os.stat(self.path).st_mtime_ns
        if stamp != self.seen:
            try:
                with open(self.path, encoding="utf-8") as f:
                    self.rules, self.error = RuleSet.parse(f.read()), ""
            except (ValueError, KeyError, TypeError) as e:
                self.error = str(e)
                if self.rules is None:
                    raise
            self.seen = stamp
        return self.rules


def scored(df: DataFrame, rules: RuleSet) -> DataFrame:
    out = df.withColumns({"hits": rules.hits(), "score": rules.score()})
    return out.withColumns({"band": band(F.col("score")), "rules_version": F.lit(rules.version)})


def triage(df: DataFrame, least: int = 60) -> DataFrame:
    """What goes to the queue: bands HIGH and CRITICAL. The filter asks for the score, as a filter on the band would
    repeat all rules for each of its limits once it is pushed below the projection."""
    return df.filter(F.col("score") >= least)


def with_profiles(df: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Fail open: rows without online features are scored by rules alone and marked degraded."""
    known = profiles.withColumn("__known", F.lit(True))
    return df.join(known, key, "left").withColumn("degraded", F.col("__known").isNull()).drop("__known")


ORDERS = RuleSet("2024.1", (
    Rule("amount_over_4000", "amount_minor > 40000000", 40), Rule("amount_over_3000", "amount_minor > 30000000", 20), Rule("amount_tiny", "amount_minor < 200000", 15),
    Rule("amount_round", "amount_minor % 10000 = 0", 10), Rule("urgent", "priority = '1-URGENT'", 15), Rule("high_priority", "priority = '2-HIGH'", 5),
    Rule("unspecified_priority", "priority = '4-NOT SPECIFIED'", 5), Rule("status_open", "status = 'O'", 10), Rule("status_pending", "status = 'P'", 10),
    Rule("negative_balance", "balance_minor < 0", 20), Rule("over_balance", "amount_minor > 50 * balance_minor", 10), Rule("segment_machinery", "segment = 'MACHINERY'", 5),
    Rule("segment_building", "segment = 'BUILDING'", 5), Rule("month_end", "day(occurred_at) >= 28", 5), Rule("weekend", "dayofweek(occurred_at) in (1, 7)", 5),
    Rule("far_away", "distance_km > 5000", 30, ("lat", "lon")),
))
