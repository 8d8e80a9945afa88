"""The corpus operators as queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, mixing, pii, quality, simhash, suffix, toxicity, urls, warc
from .common import held_out, shared_path

TOXIC_FROM = 0.7
#: The key under which the pseudonymisation query runs; real uses bring a secret one.
PII_KEY = b"riskloom query key, not a secret"
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.quality(docs, model)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "windows", "item_windows")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.without_repeats(_table(spark, sf_dir, "documents"), keep_bytes=False)
    return found.drop("kept").withColumnRenamed("id", "doc_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents"), PII_KEY).withColumnRenamed("id", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels reach a page through the document id that ends its path: bad quality or toxic text asks for a block. Those
    of the held-out fold are not learned from."""
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    number = F.try_to_number(F.nullif(F.regexp_extract("url", r"/([0-9]{1,18})(?:\.html)?/?(?:[?#].*)?$", 1), F.lit("")), F.lit("999999999999999999")).cast("long")
    labelled = pages.withColumn("doc_id", number).join(labels, "doc_id").filter(~held_out(F.col("doc_id"))).select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return urls.judge(pages, URL_RULES, urls.mine(labelled)).withColumnRenamed("id", "page_id")


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    path = shared_path(spark, "warc")
    warc.write(pages, path)
    kind = pages.schema["page_id"].dataType
    records = warc.read(spark, path)
    revisit = F.col("type") == "revisit"
    return records.select(
        F.col("id").cast(kind).alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, lexicon)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_decontam, op4_suffix, op5_pii, op6_mixing, op7_urls, op8_exact, op9_warc, op10_toxicity)}

ORACLE_SQL = {
    "op8_exact": r"""
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        WINDOW same AS (PARTITION BY norm)""",
    "op9_warc": """
        SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN octet_length(encode(body)) >= 1000 AND page_id <> max(page_id) OVER same THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN octet_length(encode(body)) >= 1000 AND page_id <> max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS body FROM pages)
        WINDOW same AS (PARTITION BY body)""",
}
