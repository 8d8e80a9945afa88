"""Arbitrary state with a time to live, and sinks beside the tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Velocity(StatefulProcessor):
    """Counts an account's events; the count is forgotten when it was not touched for ``ttl`` milliseconds."""

    def __init__(self, ttl: int = 86_400_000):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        n += sum(len(r) for r in rows)
        self.count.update((n,))
        yield pd.DataFrame({"account": [str(key[0])], "n": [n]})

    def close(self) -> None:
        pass


def velocity(stream: DataFrame, key: str, ttl: int = 86_400_000) -> DataFrame:
    """Needs the RocksDB state store (PROVIDER) and the processing-time mode for its time to live."""
    return stream.groupBy(key).transformWithStateInPandas(Velocity(ttl), outputStructType="account string, n long", outputMode="Update", timeMode="ProcessingTime")


def enriched(stream: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Stream rows with the profile of their key; unknown keys pass."""
    return stream.join(profiles, key, "left")


class Progress(StreamingQueryListener):
    """Per query and batch: rows, event-time watermark, duration, and rows that the engine dropped as late."""

    def __init__(self):
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({
            "query": p.name, "batch": p.batchId, "rows": p.numInputRows, "millis": p.batchDuration, "watermark": (p.eventTime or {}).get("watermark"),
            "dropped": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class LatestStore:
    """The newest value per key, in this process: for tests and small tables, as its rows come to the driver."""

    def __init__(self):
        self.rows: dict = {}
        self.batches: set[int] = set()

    def save(self, newest: DataFrame, key: str, order: str, batch: int) -> None:
        for row in newest.toLocalIterator():
            value = row.asDict()
            self.rows[value.pop(key)] = value
        self.batches.add(batch)


class TableStore:
    """The newest value per key as files of each batch; a batch that is retried overwrites its own."""

    def __init__(self, path: str):
        self.path = path

    def save(self, newest: DataFrame, key: str, order: str, batch: int) -> None:
        newest.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch}")

    def latest(self, spark, key: str, order: str) -> DataFrame:
        rows = spark.read.parquet(self.path)
        columns = [c for c in rows.columns if c not in (key, "batch_id")]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, "batch_id")).alias("v"))
        return newest.select(key, *[F.col(f"v.{c}").alias(c) for c in columns])


class RemoteStore:
    """An online store that each task writes to: ``connect`` gives a client with ``put(key, value)`` and ``close()``, in the
    task. Writes are upserts of the same values, so a task or batch that runs again does no harm."""

    def __init__(self, connect):
        self.connect = connect

    def save(self, newest: DataFrame, key: str, order: str, batch: int) -> None:
        connect = self.connect

        def write(rows) -> None:
            client = connect()
            try:
                for row in rows:
                    value = row.asDict()
                    client.put(value.pop(key), value)
            finally:
                client.close()

        newest.foreachPartition(write)


def reconcile(store, key: str, order: str, marker: str = "RECONCILED"):
    """A foreachBatch handler that saves each key's newest row of the batch, marked, to a store."""

    def run(df: DataFrame, batch: int) -> None:
        rest = [c for c in df.columns if c != key]
        newest = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v"))
        store.save(newest.select(key, *[F.col(f"v.{c}").alias(c) for c in rest], F.lit(marker).alias("source")), key, order, batch)

    return run
