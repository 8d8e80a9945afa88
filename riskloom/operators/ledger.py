"""Evidence, routing, citations, manifests, audit chains, capability status."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
#: The states a capability can be in.
STATUSES = ("NOT_STARTED", "IN_PROGRESS", "PASS", "FAIL", "BLOCKED")


# --- gaps and routing


def open_gaps(hypotheses: DataFrame, challenges: DataFrame, collected: DataFrame) -> DataFrame:
    """Evidence kinds that an open hypothesis or challenge requires and nobody has collected: a union of sets."""
    wants = lambda df, c: df.filter("status = 'OPEN'").select("investigation_id", F.explode(c).alias("kind"))
    wanted = wants(hypotheses, "required_evidence").unionByName(wants(challenges, "required_refutation_evidence")).distinct()
    return wanted.join(collected.select("investigation_id", "kind"), ["investigation_id", "kind"], "left_anti")


def eligible(agents: DataFrame, gaps: DataFrame, collected: DataFrame) -> DataFrame:
    """Agents that produce something missing, have what they require and calls left, by investigation. Joined on the
    missing kind, not on all pairs."""
    have = collected.groupBy("investigation_id").agg(F.collect_set("kind").alias("have"))
    produce = agents.withColumn("kind", F.explode("produces_evidence"))
    hits = gaps.join(produce, "kind").groupBy("investigation_id", "agent_id").agg(F.count(F.lit(1)).alias("closes"), F.first("required_evidence").alias("needs"), F.first("priority").alias("priority"), F.first("max_invocations").alias("most"), F.first("invocations").alias("used"))
    hits = hits.join(have, "investigation_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    return hits.filter((F.size(F.array_except("needs", "have")) == 0) & (F.col("used") < F.col("most")))


def route_next(agents: DataFrame, gaps: DataFrame, collected: DataFrame) -> DataFrame:
    """The agent to call next in each investigation: highest priority, then the smallest id."""
    best = eligible(agents, gaps, collected).groupBy("investigation_id").agg(F.min(F.struct((-F.col("priority")).alias("p"), "agent_id", "closes")).alias("b"))
    return best.select("investigation_id", F.col("b.agent_id").alias("agent_id"), F.col("b.closes").alias("closes"))


# --- citations


def unsupported_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited ids for which there is no evidence, by claim; a claim that cites nothing is unsupported as well."""
    cited = claims.select("claim_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    return cited.join(evidence.select("evidence_id"), "evidence_id", "left_anti").select("claim_id", "evidence_id")


def unnecessary_calls(calls: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Tool calls whose evidence no surviving hypothesis cites."""
    kept = hypotheses.filter("status <> 'REJECTED'").select(F.explode("evidence_ids").alias("evidence_id")).distinct()
    return calls.join(kept, "evidence_id", "left_anti")


def evidence_pr(found: Column, causal: Column) -> dict[str, Column]:
    """Precision and recall of a set of evidence keys; an empty denominator gives null."""
    hit = F.size(F.array_intersect(found, causal))
    return {"precision": F.try_divide(hit, F.size(F.array_distinct(found))), "recall": F.try_divide(hit, F.size(F.array_distinct(causal)))}


# --- manifests


def manifest_diff(a: DataFrame, b: DataFrame, key: str = "run_id") -> DataFrame:
    """(field, a, b) where two one-row manifests differ; a field that one side lacks is a difference."""
    long = lambda df, name: df.select(F.explode(F.create_map(*[x for c in df.columns if c != key for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", name))
    return long(a, "a").join(long(b, "b"), "field", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


# --- audit chain


def chained(payload_hash: Column, prev_hash: Column) -> Column:
    return F.sha2(F.concat(prev_hash, F.lit("|"), payload_hash), 256)


def _fold(batches):
    """Rows (entity, seq, payload_hash) in order, each with the hash before it and its own; only the last is kept."""
    entity, last = None, GENESIS
    for batch in batches:
        before, own = [], []
        for name, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if name != entity:
                entity, last = name, GENESIS
            before.append(last)
            last = hashlib.sha256(f"{last}|{payload}".encode()).hexdigest()
            own.append(last)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*batch.schema.names, "prev_hash", "chain_hash"])


def build_chain(events: DataFrame, entity: str, seq: str, payload_hash: str) -> DataFrame:
    """Rows with prev_hash and chain_hash, one chain per entity. Each hash needs the one before it, so the rows of an
    entity pass through one task in order, a batch at a time; no chain is held in memory."""
    rows = events.select(entity, F.col(seq).cast("long").alias("seq"), F.col(payload_hash).alias("payload_hash"))
    dealt = rows.repartition(entity).sortWithinPartitions(entity, "seq", "payload_hash")
    kind = rows.schema[entity].dataType.simpleString()
    return dealt.mapInArrow(_fold, f"{entity} {kind}, seq long, payload_hash string, prev_hash string, chain_hash string")


def verify_chain(rows: DataFrame, entity: str, payload_hash_now: Column) -> DataFrame:
    """Breaks (entity, seq, reason), in parallel: every row is checked against its own stored values and the row before
    it, so one break does not run on through the rest."""
    order = Window.partitionBy(entity).orderBy("seq")
    before = F.coalesce(F.lag("chain_hash").over(order), F.lit(GENESIS))
    reason = F.when(payload_hash_now != F.col("payload_hash"), "payload").when(chained(F.col("payload_hash"), F.col("prev_hash")) != F.col("chain_hash"), "hash").when(F.col("prev_hash") != before, "link")
    return rows.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(entity, "seq", "reason")


# --- capability status


def status_errors(rows: DataFrame) -> DataFrame:
    """(id, error): no command; PASS without time or result; a time without PASS; a status that is not one; ids that
    repeat or are malformed."""
    e = F.col("evidence")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    found = F.array_compact(F.array(
        F.when(~F.col("id").rlike("^P[0-9]+B?\\.[a-z0-9-]+$"), "malformed id"), F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown status"),
        F.when(blank(e["command"]), "no command"), F.when((F.col("status") != "PASS") & ~blank(e["verified_at"]), "time without PASS"), F.when((F.col("status") == "PASS") & blank(e["verified_at"]), "PASS without time"),
        F.when((F.col("status") == "PASS") & blank(e["result"]), "PASS without result")))
    single = rows.select("id", F.explode(found).alias("error"))
    return single.unionByName(duplicate_ids(rows).select("id", F.lit("duplicate id").alias("error")))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def status_report(rows: DataFrame) -> DataFrame:
    counts = [F.sum((F.col("status") == s).cast("long")).alias(s.lower()) for s in STATUSES]
    return rows.groupBy("phase").agg(F.count(F.lit(1)).alias("total"), *counts)
