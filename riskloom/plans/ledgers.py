"""Queries over evidence, citations, manifests, audit chains, capability records and grants."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import catalog
from riskloom.operators import controls, ledger

from .inputs import EVENTS, events, table
from .registry import query


def _sets(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("early", F.col("ts") < F.lit("2024-01-16T00:00:00Z").cast("timestamp"))
    kinds = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    return e.groupBy("user_id").agg(kinds((F.col("value") > 60) & F.col("early")).alias("found"), kinds((F.col("value") > 60) & ~F.col("early")).alias("causal"))


@query("""
    WITH s AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (value > 60 AND ts < TIMESTAMP '2024-01-16 00:00:00'), []) AS f,
                      coalesce(list(DISTINCT event_type) FILTER (value > 60 AND ts >= TIMESTAMP '2024-01-16 00:00:00'), []) AS c FROM events GROUP BY 1)
    SELECT user_id, round(len(list_intersect(f, c)) / nullif(len(f), 0), 6) AS precision, round(len(list_intersect(f, c)) / nullif(len(c), 0), 6) AS recall FROM s""")
def evidence_pr(spark, sf_dir):
    """Kinds seen early against kinds seen late; an empty side gives null."""
    parts = ledger.evidence_pr(F.col("found"), F.col("causal"))
    return _sets(spark, sf_dir).select("user_id", *[F.round(c, 6).alias(n) for n, c in parts.items()])


@query("""
    SELECT user_id, CAST(len(list_intersect(list(DISTINCT event_type) FILTER (ts < TIMESTAMP '2024-01-16 00:00:00'), list(DISTINCT event_type) FILTER (ts >= TIMESTAMP '2024-01-16 00:00:00'))) AS INTEGER) AS shared FROM events
    GROUP BY 1 HAVING count(*) FILTER (ts < TIMESTAMP '2024-01-16 00:00:00') > 0 AND count(*) FILTER (ts >= TIMESTAMP '2024-01-16 00:00:00') > 0""")
def feature_overlap(spark, sf_dir):
    """How many kinds both halves of the month have."""
    e = events(spark, sf_dir).withColumn("early", F.col("ts") < F.lit("2024-01-16T00:00:00Z").cast("timestamp"))
    side = lambda c, n: e.filter(c).groupBy("user_id").agg(F.collect_set("event_type").alias(n))
    return side("early", "a").join(side("not early", "b"), "user_id").select("user_id", F.size(F.array_intersect("a", "b")).alias("shared"))


@query("SELECT conv_id * 1000 + turn AS claim_id, 'ev' || (conv_id * 10 + turn) AS evidence_id FROM conversations WHERE conv_id * 10 + turn >= 500")
def unsupported_claims(spark, sf_dir):
    """Citations beyond the evidence that there is."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), F.array(F.concat(F.lit("ev"), F.col("conv_id") * 10 + F.col("turn"))).alias("evidence_ids"))
    return ledger.unsupported_claims(c, spark.range(500).select(F.concat(F.lit("ev"), "id").alias("evidence_id")))


@query("SELECT conv_id * 1000 + turn AS call_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def unnecessary_calls(spark, sf_dir):
    """Calls whose evidence no surviving hypothesis cites; conversations with a system turn stand for those."""
    c = table(spark, sf_dir, "conversations")
    calls = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"), F.concat(F.lit("ev"), "conv_id").alias("evidence_id"))
    hypotheses = c.filter("role = 'system'").select(F.array(F.concat(F.lit("ev"), "conv_id")).alias("evidence_ids"), F.lit("OPEN").alias("status"))
    return ledger.unnecessary_calls(calls, hypotheses).select("call_id")


@query("SELECT event_type AS tool, count(*) AS calls, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(CASE WHEN event_id % 9 = 0 THEN 1.0 ELSE 0.0 END), 6) AS override_rate FROM events GROUP BY 1")
def investigation_rates(spark, sf_dir):
    out = controls.rates(events(spark, sf_dir).withColumnRenamed("event_type", "tool"), "tool", success_rate=F.col("value") > 20, override_rate=F.col("event_id") % 9 == 0)
    return out.select("tool", "calls", F.round("success_rate", 6).alias("success_rate"), F.round("override_rate", 6).alias("override_rate"))


@query("""
    SELECT conv_id, round(sum(length(text) * CAST(rate AS DOUBLE)), 6) AS cost FROM conversations JOIN (VALUES ('system', 0.000001), ('user', 0.000002), ('assistant', 0.000008)) r(role, rate) USING (role) GROUP BY 1""")
def cost_per_investigation(spark, sf_dir):
    rates = spark.createDataFrame([("system", 0.000001), ("user", 0.000002), ("assistant", 0.000008)], "role string, rate double")
    return controls.token_cost(table(spark, sf_dir, "conversations"), rates, "role", F.length("text"), "conv_id").select("conv_id", F.round("cost", 6).alias("cost"))


@query("""
    SELECT role, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.95), 6) AS p95, round(quantile_cont(length(text), 0.99), 6) AS p99, round(avg(length(text)), 6) AS mean FROM conversations GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    """Exact percentiles; text length stands for a duration."""
    out = controls.percentiles(table(spark, sf_dir, "conversations"), "role", F.length("text"), p50=0.5, p95=0.95, p99=0.99)
    return out.select("role", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean")])


# --- audit chain: one chain per account and day, one event in 97 altered after it was written

CHAINED = f"""
    WITH RECURSIVE e AS (SELECT user_id || '/' || CAST(ts AS DATE) AS entity, event_id AS seq, sha256(event_type || '|' || event_id) AS payload_hash,
            row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS r FROM {EVENTS}),
    c AS (SELECT entity, seq, r, payload_hash, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || payload_hash) AS chain_hash FROM e WHERE r = 1
        UNION ALL SELECT e.entity, e.seq, e.r, e.payload_hash, c.chain_hash, sha256(c.chain_hash || '|' || e.payload_hash) FROM c JOIN e ON e.entity = c.entity AND e.r = c.r + 1)"""


def _chain(spark, sf_dir):
    e = events(spark, sf_dir).select(F.concat("user_id", F.lit("/"), F.to_date("ts")).alias("entity"), F.col("event_id").alias("seq"), F.sha2(F.concat("event_type", F.lit("|"), "event_id"), 256).alias("payload_hash"), "event_type")
    return e, ledger.build_chain(e, "entity", "seq", "payload_hash")


@query(f"{CHAINED} SELECT entity, seq, prev_hash, chain_hash FROM c")
def audit_chain(spark, sf_dir):
    return _chain(spark, sf_dir)[1].select("entity", "seq", "prev_hash", "chain_hash")


@query(f"SELECT user_id || '/' || CAST(ts AS DATE) AS entity, event_id AS seq, 'payload' AS reason FROM {EVENTS} WHERE event_id % 97 = 5")
def audit_chain_verify(spark, sf_dir):
    """Every altered payload is found, and nothing after it."""
    e, rows = _chain(spark, sf_dir)
    now = e.select("entity", "seq", F.sha2(F.concat(F.when(F.col("seq") % 97 == 5, F.lit("forged")).otherwise(F.col("event_type")), F.lit("|"), "seq"), 256).alias("now"))
    return ledger.verify_chain(rows.join(now, ["entity", "seq"]), "entity", F.col("now"))


# --- investigations: each conversation is one; its turns raise hypotheses and challenges and collect evidence

KINDS = ("RING_SCORE", "DEVICE_SHARING", "VELOCITY", "MERCHANT_RISK", "ANOMALY", "GEO")
K = "['RING_SCORE', 'DEVICE_SHARING', 'VELOCITY', 'MERCHANT_RISK', 'ANOMALY', 'GEO']"
AGENTS = [
    ("graph", ["RING_SCORE", "DEVICE_SHARING"], [], 5, 2, 0), ("velocity", ["VELOCITY"], [], 9, 3, 0), ("merchant", ["MERCHANT_RISK"], ["VELOCITY"], 9, 1, 0),
    ("spent", ["RING_SCORE"], [], 99, 1, 1), ("anomaly", ["ANOMALY", "VELOCITY"], ["GEO"], 7, 1, 0),
]


def _kind(i):
    return F.element_at(F.array(*map(F.lit, KINDS)), (i % 6 + 1).cast("int"))


def _investigations(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "investigation_id")
    c, n = F.col("investigation_id"), F.col("turn")
    h = t.filter(n % 2 == 0).select("investigation_id", F.when((c + n) % 3 == 0, "REJECTED").otherwise("OPEN").alias("status"), F.array(_kind(c + n), _kind(c * 5 + n * 7 + 1)).alias("required_evidence"))
    challenges = t.filter(n % 2 == 1).select("investigation_id", F.when((c + n) % 4 == 1, "CLOSED").otherwise("OPEN").alias("status"), F.array(_kind(c * 2 + n)).alias("required_refutation_evidence"))
    return h, challenges, t.filter(F.length("text") % 3 == 0).select("investigation_id", _kind(F.length("text")).alias("kind"))


COLLECTED = f"(SELECT conv_id AS investigation_id, {K}[length(text) % 6 + 1] AS kind FROM conversations WHERE length(text) % 3 = 0)"
GAPS = f"""(SELECT investigation_id, kind FROM (
        SELECT conv_id AS investigation_id, unnest([{K}[(conv_id + turn) % 6 + 1], {K}[(conv_id * 5 + turn * 7 + 1) % 6 + 1]]) AS kind FROM conversations WHERE turn % 2 = 0 AND (conv_id + turn) % 3 <> 0
        UNION SELECT conv_id, {K}[(conv_id * 2 + turn) % 6 + 1] FROM conversations WHERE turn % 2 = 1 AND (conv_id + turn) % 4 <> 1)
    EXCEPT SELECT investigation_id, kind FROM {COLLECTED})"""


@query(f"SELECT investigation_id, kind FROM {GAPS}")
def open_gaps(spark, sf_dir):
    return ledger.open_gaps(*_investigations(spark, sf_dir))


@query(f"""
    SELECT investigation_id, agent_id, closes FROM (
        SELECT g.investigation_id, a.agent_id, count(*) AS closes, row_number() OVER (PARTITION BY g.investigation_id ORDER BY a.priority DESC, a.agent_id) AS r FROM {GAPS} g
        JOIN (VALUES ('graph', 'RING_SCORE', NULL, 5), ('graph', 'DEVICE_SHARING', NULL, 5), ('velocity', 'VELOCITY', NULL, 9), ('merchant', 'MERCHANT_RISK', 'VELOCITY', 9), ('anomaly', 'ANOMALY', 'GEO', 7), ('anomaly', 'VELOCITY', 'GEO', 7))
            a(agent_id, produces, needs, priority) ON a.produces = g.kind
        WHERE a.needs IS NULL OR EXISTS (SELECT 1 FROM {COLLECTED} c WHERE c.investigation_id = g.investigation_id AND c.kind = a.needs) GROUP BY g.investigation_id, a.agent_id, a.priority) WHERE r = 1""")
def route_next(spark, sf_dir):
    """Who goes next: produces something missing, has what it needs, has calls left; then priority and name."""
    h, c, have = _investigations(spark, sf_dir)
    agents = spark.createDataFrame(AGENTS, "agent_id string, produces_evidence array<string>, required_evidence array<string>, priority int, max_invocations int, invocations int")
    return ledger.route_next(agents, ledger.open_gaps(h, c, have), have)


@query("""
    WITH s AS (SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS na, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS nb, min(event_id) FILTER (ts < TIMESTAMP '2024-01-16') AS fa, min(event_id) FILTER (ts >= TIMESTAMP '2024-01-16') AS fb,
        count(DISTINCT event_type) FILTER (ts < TIMESTAMP '2024-01-16') AS ka, count(DISTINCT event_type) FILTER (ts >= TIMESTAMP '2024-01-16') AS kb FROM events)
    SELECT field, a, b FROM (SELECT 'cases' AS field, na::VARCHAR AS a, nb::VARCHAR AS b FROM s UNION ALL SELECT 'seed', fa::VARCHAR, fb::VARCHAR FROM s UNION ALL SELECT 'temperature', ka::VARCHAR, kb::VARCHAR FROM s
        UNION ALL SELECT 'rules_version', NULL, '7' UNION ALL SELECT 'model_name', 'halves', 'halves') WHERE a IS DISTINCT FROM b""")
def manifest_diff(spark, sf_dir):
    """Manifests of runs over the two halves of the month."""
    e, early = events(spark, sf_dir), F.col("ts") < F.lit("2024-01-16T00:00:00Z").cast("timestamp")
    run = lambda name, rows, rules: rows.agg(F.lit(name).alias("run_id"), F.count(F.lit(1)).cast("string").alias("cases"), F.min("event_id").cast("string").alias("seed"), F.count_distinct("event_type").cast("string").alias("temperature"), F.lit("halves").alias("model_name"), F.lit(rules).cast("string").alias("rules_version"))
    return ledger.manifest_diff(run("r1", e.filter(early), None), run("r2", e.filter(~early), "7"))


#: Capabilities by customer: one in 41 with a malformed id, one in 37 with an id that others have, six states of which one is unknown.
CAPABILITIES = """(SELECT CASE WHEN c_custkey % 41 = 0 THEN 'bad id ' || c_custkey WHEN c_custkey % 37 = 0 THEN 'P1.dup-' || c_custkey // 37 % 3 ELSE 'P' || c_custkey % 7 || CASE WHEN c_custkey % 5 = 0 THEN 'B' ELSE '' END || '.cap-' || c_custkey END AS id,
        'P' || c_custkey % 7 AS phase, ['NOT_STARTED', 'IN_PROGRESS', 'PASS', 'FAIL', 'BLOCKED', 'DONE'][c_custkey % 6 + 1] AS status, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN ' ' ELSE 'make' END AS command,
        CASE WHEN c_custkey % 4 = 0 THEN '2024-01-01' END AS verified_at, CASE WHEN c_custkey % 3 = 2 THEN 'ok' END AS result FROM customer)"""


def _capabilities(spark, sf_dir):
    k = F.col("c_custkey")
    usual = F.concat(F.lit("P"), k % 7, F.when(k % 5 == 0, "B").otherwise(""), F.lit(".cap-"), k)
    name = F.when(k % 41 == 0, F.concat(F.lit("bad id "), k)).when(k % 37 == 0, F.concat(F.lit("P1.dup-"), F.floor(k / 37) % 3)).otherwise(usual)
    status = F.element_at(F.array(*map(F.lit, (*ledger.STATUSES, "DONE"))), (k % 6 + 1).cast("int"))
    evidence = F.struct(F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, " ").otherwise("make").alias("command"), F.when(k % 4 == 0, "2024-01-01").alias("verified_at"), F.when(k % 3 == 2, "ok").alias("result"))
    return table(spark, sf_dir, "customer").select(name.alias("id"), F.concat(F.lit("P"), k % 7).alias("phase"), status.alias("status"), evidence.alias("evidence"))


@query(f"""
    SELECT phase, count(*) AS total, {', '.join(f"CAST(sum((status = '{s}')::INT) AS BIGINT) AS {s.lower()}" for s in ledger.STATUSES)} FROM {CAPABILITIES} GROUP BY 1""")
def status_report(spark, sf_dir):
    return ledger.status_report(_capabilities(spark, sf_dir))


@query(f"SELECT id, count(*) AS n FROM {CAPABILITIES} GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return ledger.duplicate_ids(_capabilities(spark, sf_dir))


@query(f"""
    SELECT id, error FROM (SELECT id, unnest([CASE WHEN NOT regexp_matches(id, '^P[0-9]+B?\\.[a-z0-9-]+$') THEN 'malformed id' END, CASE WHEN status = 'DONE' THEN 'unknown status' END, CASE WHEN trim(coalesce(command, '')) = '' THEN 'no command' END,
        CASE WHEN status <> 'PASS' AND verified_at IS NOT NULL THEN 'time without PASS' END, CASE WHEN status = 'PASS' AND verified_at IS NULL THEN 'PASS without time' END, CASE WHEN status = 'PASS' AND result IS NULL THEN 'PASS without result' END]) AS error FROM {CAPABILITIES}) WHERE error IS NOT NULL
    UNION ALL SELECT id, 'duplicate id' FROM {CAPABILITIES} GROUP BY 1 HAVING count(*) > 1""".replace("\\\\", "\\"))
def status_errors(spark, sf_dir):
    return ledger.status_errors(_capabilities(spark, sf_dir))


GRANTED = ", ".join(f"('{role}', '{schema}', '{verb}')" for role, schemas in catalog.GRANTS.items() for schema, verbs in schemas.items() for verb in verbs)
VERBS = ("SELECT", "INSERT", "UPDATE")


@query(f"""
    WITH r AS (SELECT event_id, {list(catalog.GRANTS)}[event_id % 4 + 1] AS role, {list(catalog.SCHEMAS)}[event_id // 4 % 5 + 1] AS schema_name, {list(VERBS)}[event_id // 20 % 3 + 1] AS verb FROM events)
    SELECT event_id, role, schema_name, verb, (role, schema_name, verb) IN (VALUES {GRANTED}) AS allowed FROM r""")
def grant_matrix(spark, sf_dir):
    """Requests for access, one an event, against what each role may do."""
    k = F.col("event_id")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    asked = events(spark, sf_dir).select("event_id", pick(catalog.GRANTS, k).alias("role"), pick(catalog.SCHEMAS, F.floor(k / 4)).alias("schema_name"), pick(VERBS, F.floor(k / 20)).alias("verb"))
    granted = F.broadcast(catalog.grants(spark).withColumn("found", F.lit(True)))  # a row a grant
    return asked.join(granted, ["role", "schema_name", "verb"], "left").select("event_id", "role", "schema_name", "verb", F.coalesce("found", F.lit(False)).alias("allowed"))
