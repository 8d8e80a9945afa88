"""Shared pieces: lineage cuts in the shared folder, row keys, and joins that hold up under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.lineage import cut as materialize
from riskloom.lineage import discard, release, shared_folder, shared_path

__all__ = ["materialize", "discard", "release", "shared_folder", "shared_path"]

SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Rows up to which a small table is broadcast, after it has been counted.
BROADCAST_ROWS = 50_000


def fresh(columns, base: str) -> str:
    """A column name that ``columns`` does not have, whatever the case."""
    taken = {c.lower() for c in columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def aside(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with room for columns ``names``: its own of that name, whatever the case, stay as ``<name>_input``."""
    taken = {n.lower() for n in names}
    for c in docs.columns:
        if c.lower() in taken:
            docs = docs.withColumnRenamed(c, fresh([*docs.columns, *names], f"{c}_input"))
    return docs


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_hash(name: str = "text") -> Column:
    """With doc_id, the key of a row; rows that share both are equal in all that the operators judge."""
    return F.xxhash64(text_or_empty(name))


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table with one that is usually small. ``small`` must be materialized: its rows are counted, and
    up to ``limit`` it is broadcast; beyond that a sort-merge join runs, whose hot partitions AQE splits."""
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores, where rows are few and small but the work on each is not; the size of files would
    put them in a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow over batches that are bounded by bytes and not by rows alone, as texts may be long. The bound is a
    session setting that is read when the plan runs, so it can't be put back here; a session that sets its own keeps it."""
    if df.sparkSession.conf.get(BATCH_BYTES, None) is None:
        df.sparkSession.conf.set(BATCH_BYTES, str(8 << 20))
    return df.mapInArrow(function, schema)


def held_out(id_column: Column) -> Column:
    """True for the evaluation fold: crc32 of the id as text leaves remainder 1 by 3; null ids are not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drop_rows(docs: DataFrame, doomed: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows keyed in ``doomed`` (id, h). All columns of ``docs`` are kept."""
    h = fresh(docs.columns, "__h")
    left = docs.withColumn(h, row_hash(text_column))
    right = doomed.select(F.col("id").alias("__id"), F.col("h").alias("__dh"))
    on = left[id_column].eqNullSafe(right["__id"]) & (left[h] == right["__dh"])
    return left.join(right, on, "left_anti").drop(h)


def training_ids(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids outside the held-out fold, the first by a hash of the id, so every run
    and every partitioning picks the same; a label given twice counts once, and null labels or ids not at all."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    rows = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
