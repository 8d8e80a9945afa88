"""The corpus pipeline: toxicity, exact copies, near copies, benchmark passages, then mixing.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with all columns of ``docs``; run() writes each
stage's rows as Parquet in the shared folder, reads them again as the next stage's docs, and deletes what is superseded.
The last stage adds size, source_size, target and taken; a row whose taken is 0 is not drawn.

In all stages: a null text counts as empty, texts are read whole whatever their length, a null doc_id is an id like any
other but loses every tie, repeated rows are judged alike except where one of them stays, an empty table gives an empty
one, and further columns travel along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontam, exact, mixing, near, toxicity
from riskloom.llm.common import discard, drop_rows, fresh, materialize
from riskloom.llm.queries import TOXIC_FROM


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under the toxicity threshold. Without labels of both classes the seed lexicon decides; rows
    with an empty text stay."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs.columns, "__score")
    return toxicity.toxicity(docs, lexicon, score_column=score).filter(F.col(score) < TOXIC_FROM).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the smallest doc_id; of rows that share that too, the first of
    the scan. All empty and null texts are one group."""
    return exact.without_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by SimHash and, for what fingerprints miss at this distance, exact
    candidates (five-word shingles at Jaccard 0.8 or more): the one with the smallest doc_id. Rows that share doc_id and
    text hash are one document and stay or go together; texts without words are one group."""
    members = materialize(near.near_copies(docs), "near")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
    winners = members.groupBy("root").agg(F.min(first).alias("w")).select(F.col("root").alias("r"), F.col("w.id").alias("w_id"), F.col("w.h").alias("w_h"))
    same = (F.col("root") == F.col("r")) & F.col("id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))
    losers = materialize(members.join(winners, same, "left_anti").select("id", "h"), "near-losers")
    discard(members)
    return drop_rows(docs, losers)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is found; rows with an empty text stay, and all rows do if the benchmark is empty."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the words that the mix takes of each; columns named like the four added stay as ``<name>_input``."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", keep_civil),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]

#: Hashing, learned scores and sampling are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
