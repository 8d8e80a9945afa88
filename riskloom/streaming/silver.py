"""Event log to bronze, silver and gold, with late rows routed instead of dropped.

A row is late when it is older than the watermark of its batch: the greatest event time of all batches before, less the
delay. Watermarks are stored per batch, and every output is written under its batch, overwriting it, so that a batch
that is retried gives the same split.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

DELAY = 600


@dataclass
class Counters:
    on_time: int = 0
    late: int = 0
    duplicates: int = 0
    dead: int = 0
    batches: dict = field(default_factory=dict)

    def add(self, batch: int, **n: int) -> None:
        self.batches[batch] = n  # a retried batch counts once
        for name in ("on_time", "late", "duplicates", "dead"):
            setattr(self, name, sum(b.get(name, 0) for b in self.batches.values()))


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in no order; one listing for each directory level with a wildcard."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return [f.getPath().toString() for f in found or ()]


def _numbered(paths: list[str]) -> dict[int, str]:
    """By the number that ends each path, as in batch_id=7."""
    return {int(p.rpartition("=")[2]): p for p in paths}


DAY_US = 86_400_000_000


def day(at: Column) -> Column:
    """Number of the day, whatever the session's time zone."""
    return F.floor(F.unix_micros(at) / DAY_US).cast("long")


class Silver:
    """foreachBatch handler with tables on_time, late, dead and watermarks under ``path``. On-time rows lie by day of their
    event and batch, so that a batch lists and reads only the days it could repeat; the watermark of a batch holds the
    greatest time up to it, so that only the newest is read.

    ``checks`` are (name, condition) pairs that make a row a dead letter. Duplicates are judged by ``key`` against the
    rows that could still be repeated: those whose event time lies within ``keep`` seconds of the batch's oldest
    on-time row; a key seen longer ago than that counts as new."""

    def __init__(self, path: str, key: str = "event_id", at: str = "occurred_at", delay: int = DELAY, keep: int = 7 * 86_400, checks: tuple[tuple[str, Column], ...] = ()):
        self.path, self.key, self.at, self.delay, self.keep, self.checks = path, key, at, delay, keep, checks
        self.counters = Counters()

    def _top(self, spark: SparkSession, batch: int) -> int | None:
        """Greatest event time of all batches before."""
        earlier = {n: p for n, p in _numbered(_glob(spark, f"{self.path}/watermarks/batch_id=*")).items() if n < batch}
        return spark.read.schema("max_us long").parquet(earlier[max(earlier)]).agg(F.max("max_us")).first()[0] if earlier else None

    def _put(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch_id={batch}")

    def on_time(self, spark: SparkSession, schema: T.StructType, first: int | None = None, last: int | None = None) -> DataFrame | None:
        """On-time rows with their batch_id, of events between two times in microseconds; None where no day has any."""
        days = _numbered(_glob(spark, f"{self.path}/on_time/day=*"))
        paths = [p for d, p in days.items() if (first is None or d >= first // DAY_US) and (last is None or d <= last // DAY_US)]
        if not paths:
            return None
        rows = spark.read.schema(_with_batch(schema)).option("basePath", f"{self.path}/on_time").parquet(*paths).drop("day")
        us = F.unix_micros(F.col(self.at))
        rows = rows if first is None else rows.filter(us >= first)
        return rows if last is None else rows.filter(us <= last)

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        top = self._top(spark, batch)
        mark = None if top is None else top - self.delay * 1_000_000
        us = F.unix_micros(F.col(self.at))
        bad = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in self.checks])) if self.checks else F.array().cast("array<string>")
        df = df.withColumn("errors", F.when(F.col(self.at).isNull() | F.col(self.key).isNull(), F.array(F.lit("no key or time"))).otherwise(bad))
        df = df.withColumn("is_late", F.coalesce(us < F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)).persist()
        try:
            dead, good = df.filter(F.size("errors") > 0), df.filter(F.size("errors") == 0).drop("errors")
            late, fresh = good.filter("is_late").drop("is_late"), good.filter("not is_late").drop("is_late")
            rest = [c for c in fresh.columns if c != self.key]
            first = fresh.groupBy(self.key).agg(F.min(F.struct(self.at, *[c for c in rest if c != self.at])).alias("f")).select(self.key, *[F.col(f"f.{c}").alias(c) for c in rest])
            span = fresh.agg(F.min(us), F.max(us)).first()
            seen = self.on_time(spark, first.schema, span[0] - self.keep * 1_000_000, span[1]) if span[0] is not None else None
            if seen is not None:
                first = first.join(seen.filter(F.col("batch_id") < batch).select(self.key), self.key, "left_anti")
            dealt = first.select(*fresh.columns, day(F.col(self.at)).alias("day"), F.lit(batch).alias("batch_id"))
            # overwrites this batch's part of each day; the same batch gives the same days
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(f"{self.path}/on_time")
            self._put(late, "late", batch)
            self._put(dead.drop("is_late"), "dead", batch)
            self._put(good.agg(F.max(us).alias("max_us")).select(F.greatest("max_us", F.lit(top)).alias("max_us")).filter("max_us is not null"), "watermarks", batch)
            n = df.agg(F.count(F.lit(1)).alias("all"), F.sum(F.when(F.size("errors") > 0, 1).otherwise(0)).alias("dead"), F.sum(F.when((F.size("errors") == 0) & F.col("is_late"), 1).otherwise(0)).alias("late")).first()
            written = _glob(spark, f"{self.path}/on_time/day=*/batch_id={batch}")
            kept = spark.read.schema(fresh.schema).parquet(*written).count() if written else 0
            dead_n, late_n = n["dead"] or 0, n["late"] or 0
            self.counters.add(batch, on_time=kept, late=late_n, dead=dead_n, duplicates=n["all"] - dead_n - late_n - kept)
        finally:
            df.unpersist()

    def table(self, spark: SparkSession, name: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path}/{name}")


def bronze(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only copy of the log, never written over; reads what there is and ends, so a replay is bounded."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{checkpoint}/_checkpoints/bronze").trigger(availableNow=True).start()


def run_silver(stream: DataFrame, silver: Silver, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(silver).option("checkpointLocation", f"{checkpoint}/_checkpoints/silver").trigger(availableNow=True).start()


class Gold:
    """Recomputes the windows that a batch touches from silver, in full, and writes them under the batch; the newest
    batch of a window is the one that counts. So gold never depends on how batches were cut."""

    def __init__(self, silver: Silver, path: str, account: str, amount: str, seconds: int = 300):
        self.silver, self.path, self.account, self.amount, self.seconds = silver, path, account, amount, seconds

    def _windows(self, df: DataFrame) -> DataFrame:
        return df.withColumn("window_start", F.floor(F.unix_micros(F.col(self.silver.at)) / (self.seconds * 1_000_000)) * self.seconds)

    def __call__(self, df: DataFrame, batch: int) -> None:
        self.silver(df, batch)
        spark = df.sparkSession
        written = _glob(spark, f"{self.silver.path}/on_time/day=*/batch_id={batch}")
        if not written:
            return
        touched = self._windows(spark.read.schema(df.schema).parquet(*written)).select(self.account, "window_start").distinct()
        # only days and stretches that the batch touches are read again
        span = touched.agg(F.min("window_start"), F.max("window_start")).first()
        rows = self._windows(self.silver.on_time(spark, df.schema, span[0] * 1_000_000, (span[1] + self.seconds) * 1_000_000).filter(F.col("batch_id") <= batch))
        made = rows.join(touched, [self.account, "window_start"], "left_semi").groupBy(self.account, "window_start").agg(F.count(F.lit(1)).alias("n"), F.sum(self.amount).alias("total"))
        made.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch}")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(self.path)
        newest = rows.groupBy(self.account, "window_start").agg(F.max_by(F.struct("n", "total"), "batch_id").alias("v"))
        return newest.select(self.account, "window_start", "v.n", "v.total")


def native_windows(stream: DataFrame, at: str, key: str, seconds: int, delay: int = DELAY) -> DataFrame:
    """The engine's own tumbling windows; rows behind its watermark are dropped and only counted."""
    return stream.withWatermark(at, f"{delay} seconds").groupBy(F.window(at, f"{seconds} seconds"), key).agg(F.count(F.lit(1)).alias("n"))


def native_dedup(stream: DataFrame, at: str, key: str, delay: int = DELAY) -> DataFrame:
    return stream.withWatermark(at, f"{delay} seconds").dropDuplicatesWithinWatermark([key])


def native_sessions(stream: DataFrame, at: str, key: str, gap: int = 1800, delay: int = DELAY) -> DataFrame:
    return stream.withWatermark(at, f"{delay} seconds").groupBy(F.session_window(at, f"{gap} seconds"), key).agg(F.count(F.lit(1)).alias("n"))
