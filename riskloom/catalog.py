"""A guard over schema access. Spark has no grants: this resolves names for a role and refuses the rest, which is
weaker than a database's grants, as code that goes round it is not stopped."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = ("app", "audit", "groundtruth", "eval", "external")
#: What each role may do in each schema; all else is denied.
GRANTS = {
    "app_role": {"app": ("SELECT", "INSERT", "UPDATE"), "audit": ("INSERT",)},
    "stream_role": {"app": ("SELECT",), "external": ("SELECT",)},
    "eval_role": {"app": ("SELECT",), "audit": ("SELECT",), "groundtruth": ("SELECT",), "eval": ("SELECT", "INSERT"), "external": ("SELECT", "INSERT")},
    "auditor_role": {"app": ("SELECT",), "audit": ("SELECT",), "eval": ("SELECT",)},
}
#: Result families that no table may hold together.
FORBIDDEN_UNION = ("EXTERNAL", "SYNTHETIC")


class AccessDenied(PermissionError):
    pass


def grants(spark: SparkSession) -> DataFrame:
    rows = [(role, schema, verb) for role, schemas in GRANTS.items() for schema, verbs in schemas.items() for verb in verbs]
    return spark.createDataFrame(rows, "role string, schema_name string, verb string")


@dataclass
class Catalog:
    """Tables by ``schema.table`` for one role; ``tables`` maps names to functions that give a DataFrame."""

    spark: SparkSession
    role: str
    tables: dict = field(default_factory=dict)

    def allowed(self, schema: str, verb: str) -> bool:
        return verb in GRANTS.get(self.role, {}).get(schema, ())

    def _check(self, name: str, verb: str) -> str:
        schema = name.partition(".")[0]
        if schema not in SCHEMAS or not self.allowed(schema, verb):
            raise AccessDenied(f"{self.role} may not {verb} {name}")
        return schema

    def read(self, name: str) -> DataFrame:
        self._check(name, "SELECT")
        return self.tables[name](self.spark)

    def append(self, name: str, df: DataFrame, path: str) -> None:
        self._check(name, "INSERT")
        df.write.mode("append").parquet(path)

    def replace(self, name: str, df: DataFrame, path: str) -> None:
        self._check(name, "UPDATE")
        df.write.mode("overwrite").parquet(path)


def mixes(tracks: Column) -> Column:
    """Whether an array of result families holds both of those that must not meet."""
    return F.size(F.array_intersect(tracks, F.array(*map(F.lit, FORBIDDEN_UNION)))) == len(FORBIDDEN_UNION)


def guard_union(tracks: list[str]) -> None:
    """Refuse a table that would hold results of both families."""
    if set(FORBIDDEN_UNION) <= set(tracks):
        raise ValueError(f"results of {' and '.join(FORBIDDEN_UNION)} data must not share a table")
