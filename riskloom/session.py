"""Sessions with the settings this library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC because every time rule compares instants; adaptive execution to coalesce small partitions and split skewed
#: joins. Cluster sizing (executors, memory, shuffle partitions) is left to whoever submits the job.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "riskloom", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | (conf or {}))
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()
