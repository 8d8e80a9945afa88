"""Exact duplicates, combined in skew-safe steps; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACES, fresh, materialize, text_or_empty

#: Digests with several texts that are kept apart by name; a real hash has none.
CLASHES = 1000


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _keyed(rows: DataFrame, clashing: list[str]) -> DataFrame:
    """``rows`` with ``key``: the digest of ``norm``, and after it the text itself where different texts share a digest."""
    rows = rows.withColumn("digest", digest(F.col("norm")))
    key = F.when(F.col("digest").isin(clashing), F.concat("digest", "norm")).otherwise(F.col("digest")) if clashing else F.col("digest")
    return rows.withColumn("key", key)


def exact_groups(rows: DataFrame, salts: int = 16) -> tuple[DataFrame, list[str]]:
    """One row (key, keep_row, keep_id, group_size) per group of equal texts with two members or more, and the digests
    that different texts share. ``rows``: id, row (a number that tells rows apart), norm.

    Three combining steps, each keyed by SHA-256 digest *and* whole normalised text, so contents are compared and
    a digest alone never merges rows: each task combines its own rows (map-side aggregation), then the rows of one
    salt are combined, then the winners of all salts. A group that holds a third of all rows reaches the last
    exchange as at most one row per salt and task. The groups of a digest are counted there as well: where it has one, as
    ever with SHA-256, the digest stands for the text from then on; else the text is part of the key."""
    rows = _keyed(rows, []).withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.lit(salts)))
    first = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))
    salted = rows.groupBy("salt", "digest", "norm").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    # dealt by digest alone, which serves the grouping by text and the count of texts alike
    whole = salted.repartition("digest").groupBy("digest", "norm").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    kinds = F.count(F.lit(1)).over(Window.partitionBy("digest"))  # of a digest's different texts
    groups = whole.select("digest", "first", "n").withColumn("kinds", kinds).filter("n > 1")
    named = ["key", F.col("first.row").alias("keep_row"), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size")]
    groups = materialize(groups.withColumn("key", F.col("digest")).select(*named, "kinds"), "exact-groups")
    clashing = [r["key"] for r in groups.filter("kinds > 1").select("key").distinct().limit(CLASHES + 1).collect()]
    if len(clashing) > CLASHES:
        raise ValueError(f"over {CLASHES} digests stand for several texts; this is no hash of them")
    if not clashing:
        return groups.drop("kinds"), clashing
    apart = whole.filter(F.col("digest").isin(clashing) & (F.col("n") > 1)).withColumn("key", F.concat("digest", "norm")).select(*named)
    return materialize(groups.filter("kinds = 1").drop("kinds").unionByName(apart), "exact-groups"), clashing


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = 16) -> DataFrame:
    """One row (id, keep_id, group_size, kept, text_sha256) per row of ``docs``, dropped ones included.

    Texts are equal when they are after each run of ASCII white space becomes one space; a null text counts as
    empty. Of equal texts the smallest id stays; null ids come last. Rows that repeat id and text are told apart
    by their place in the scan, which is read twice, so give it a table that was read, not a shuffled result; exactly one
    row of a group has kept = true. Texts are compared whole. Empty in, empty out; no other columns are read."""
    rows = docs.select(F.col(id_column).alias("id"), normalized(text_or_empty(text_column)).alias("norm")).withColumn("row", F.monotonically_increasing_id())
    groups, clashing = exact_groups(rows, salts)
    members = _keyed(rows, clashing).select("id", "row", "key", F.sha2("norm", 256).alias("text_sha256"))
    judged = members.join(groups, "key", "left")
    alone = F.col("group_size").isNull()
    return judged.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def without_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = 16) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept whatever their names; which row as in
    exact_duplicates, and like there the row number rests on the order of the scan."""
    row, norm, key = (fresh(docs.columns, c) for c in ("__row_no", "__norm", "__key"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(norm, normalized(text_or_empty(text_column)))
    groups, clashing = exact_groups(numbered.select(F.col(id_column).alias("id"), F.col(row).alias("row"), F.col(norm).alias("norm")), salts)
    own = digest(F.col(norm))
    found = numbered.withColumn(key, F.when(own.isin(clashing), F.concat(own, norm)).otherwise(own) if clashing else own).drop(norm)
    doomed = groups.select(F.col("key").alias("__dup"), "keep_row")
    return found.join(doomed, (found[key] == F.col("__dup")) & (found[row] != F.col("keep_row")), "left_anti").drop(row, key)
