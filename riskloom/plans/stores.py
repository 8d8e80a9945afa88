"""Queries over what is written and read again: streams and their tables, stores, files, versions, adapters. Each writes
rows of the driver's tables to the shared folder and returns what the reader gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import catalog
from riskloom.functions import redact
from riskloom.lineage import cut, shared_path
from riskloom.operators import claims, metrics, ml, validation
from riskloom.sources import adapters, files, generator
from riskloom.streaming import silver, state

from .inputs import EVENTS, events, ntz, table
from .registry import query

ROW = "event_id string, user_id long, occurred_at timestamp, event_type string, value double"
#: The log's batches: event numbers shuffled a little and dealt by 2,000, the number of a batch at most 7.
BATCH = "least((event_id + event_id * 7919 % 500) // 2000, 7)"
LOG = f"""(SELECT event_id, user_id, ts, event_type, value, {BATCH} AS batch FROM events
    UNION ALL SELECT event_id, user_id, ts, event_type, value, least({BATCH} + 1, 7) FROM events WHERE event_id % 50 = 0)"""
#: Each row with the watermark of its batch, and whether a row of its key came before it.
JUDGED = f"""(SELECT l.*, value > 150 AS dead, value <= 150 AND coalesce(ts < mark, false) AS late FROM {LOG} l JOIN (
    SELECT batch, max(max(ts) FILTER (value <= 150)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS mark FROM {LOG} GROUP BY 1) m USING (batch))"""
FIRST = f"(SELECT event_id, min(batch) AS batch FROM {JUDGED} WHERE NOT dead AND NOT late GROUP BY 1)"


def _log(spark, sf_dir):
    """Events in eight batches, one event in fifty twice."""
    e = events(spark, sf_dir)
    batch = F.least(F.floor((F.col("event_id") + F.col("event_id") * 7919 % 500) / 2000), F.lit(7)).cast("int")
    rows = e.select(F.col("event_id").cast("string").alias("event_id"), "user_id", F.col("ts").alias("occurred_at"), "event_type", "value", batch.alias("batch"), (F.col("event_id") % 50 == 0).alias("twice"))
    again = rows.filter("twice").withColumn("batch", F.least(F.col("batch") + 1, F.lit(7)))
    return rows.unionByName(again).drop("twice")


def _bronze(spark, sf_dir):
    """The log as files, copied by a stream that starts twice; (path of the copy, its counters' folder)."""
    home = shared_path(spark, "log")
    for half in ("batch < 4", "batch >= 4"):
        _log(spark, sf_dir).filter(half).write.partitionBy("batch").mode("append").parquet(f"{home}/log")
        stream = spark.readStream.schema(f"{ROW}, batch int").parquet(f"{home}/log")
        silver.bronze(stream, f"{home}/bronze", home).awaitTermination()
    return home


def _silver(spark, sf_dir, gold: bool = False):
    """The log through the handler, batch by batch, the third batch twice as after a failure."""
    home = shared_path(spark, "silver")
    log = cut(_log(spark, sf_dir), "log")
    handler = silver.Silver(f"{home}/silver", checks=(("amount", F.col("value") > 150),))
    run = silver.Gold(handler, f"{home}/gold", "user_id", "value", 3600) if gold else handler
    for batch in (0, 1, 2, 2, 3, 4, 5, 6, 7):
        run(log.filter(F.col("batch") == batch).drop("batch"), batch)
    return home, handler, run


@query(f"SELECT CAST(event_id AS VARCHAR) AS event_id, user_id, ts AS occurred_at, event_type, CAST(batch AS INTEGER) AS batch FROM {LOG}")
def bronze_copy(spark, sf_dir):
    """What a stream that was stopped and started again has copied: every row of the log, once."""
    return spark.read.schema(f"{ROW}, batch int").parquet(f"{_bronze(spark, sf_dir)}/bronze").select("event_id", "user_id", ntz("occurred_at"), "event_type", "batch")


@query(f"SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(batch AS BIGINT) AS batch_id FROM {FIRST}")
def silver_on_time(spark, sf_dir):
    """Rows that are in time, each key once, in the batch that brought it first."""
    _, handler, _ = _silver(spark, sf_dir)
    return handler.on_time(spark, spark.createDataFrame([], ROW).schema).select("event_id", "batch_id")


@query(f"SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(batch AS INTEGER) AS batch_id FROM {JUDGED} WHERE late")
def silver_late(spark, sf_dir):
    """Rows behind the watermark of their batch, kept beside the others."""
    home, _, _ = _silver(spark, sf_dir)
    return spark.read.schema(f"{ROW}, batch_id int").parquet(f"{home}/silver/late").select("event_id", "batch_id")


@query(f"""
    SELECT CAST(batch AS BIGINT) AS batch, count(*) AS rows, count(*) FILTER (dead) AS dead, count(*) FILTER (late) AS late,
           CAST(count(*) FILTER (NOT dead AND NOT late) - coalesce(any_value(kept), 0) AS BIGINT) AS duplicates, CAST(coalesce(any_value(kept), 0) AS BIGINT) AS on_time
    FROM {JUDGED} LEFT JOIN (SELECT batch, count(*) AS kept FROM {FIRST} GROUP BY 1) USING (batch) GROUP BY 1""")
def silver_conservation(spark, sf_dir):
    """The handler's counters: of each batch's rows, every one is on time, late, a duplicate or dead. Batches without rows
    are left out."""
    _, handler, _ = _silver(spark, sf_dir)
    rows = [(batch, sum(n.values()), n["dead"], n["late"], n["duplicates"], n["on_time"]) for batch, n in handler.counters.batches.items() if any(n.values())]
    return spark.createDataFrame(rows, "batch long, rows long, dead long, late long, duplicates long, on_time long")


@query(f"""
    SELECT user_id, CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS window_start, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT j.* FROM {JUDGED} j JOIN {FIRST} f ON f.event_id = j.event_id AND f.batch = j.batch WHERE NOT dead AND NOT late QUALIFY row_number() OVER (PARTITION BY j.event_id) = 1) GROUP BY ALL""")
def gold_windows(spark, sf_dir):
    """Hourly sums of each account, recomputed where a batch touches them."""
    _, _, gold = _silver(spark, sf_dir, gold=True)
    return gold.table(spark).select("user_id", "window_start", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, last(event_id ORDER BY ts, event_id) AS event_id, last(event_type ORDER BY ts, event_id) AS event_type, 'RECONCILED' AS source FROM events GROUP BY 1")
def online_store(spark, sf_dir):
    """The newest event per account in a store that four batches, in any order, were reconciled into."""
    store = state.TableStore(shared_path(spark, "store"))
    e = events(spark, sf_dir).select("user_id", F.struct(F.unix_micros("ts").alias("us"), "event_id").alias("order"), "event_id", "event_type")
    for batch in (2, 0, 3, 1, 1):
        state.reconcile(store, "user_id", "order")(e.filter(F.col("event_id") % 4 == batch), batch)
    return store.latest(spark, "user_id", "order").select("user_id", "event_id", "event_type", "source")


@query(f"""
    SELECT CAST(batch AS INTEGER) AS batch, e.event_id, o.n AS profile_events FROM (SELECT event_id, user_id, {BATCH} AS batch FROM events UNION ALL SELECT event_id, user_id, least({BATCH} + 1, 7) FROM events WHERE event_id % 50 = 0) e
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = user_id""")
def stream_enriched(spark, sf_dir):
    """Rows of a stream beside the static profile of their account; unknown accounts pass."""
    home = shared_path(spark, "enriched")
    _log(spark, sf_dir).write.parquet(f"{home}/log")
    profiles = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    stream = spark.readStream.schema(f"{ROW}, batch int").parquet(f"{home}/log")
    out = state.enriched(stream, profiles, "user_id").select("batch", F.col("event_id").cast("long").alias("event_id"), F.col("n").alias("profile_events"))
    out.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{home}/out")


@query("SELECT user_id, CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def watermarked_windows(spark, sf_dir):
    """The engine's own windows with a watermark; one batch, in which nothing is late."""
    home = shared_path(spark, "windows")
    events(spark, sf_dir).select("user_id", "ts").write.parquet(f"{home}/in")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{home}/in")
    out = silver.native_windows(stream, "ts", "user_id", 3600)

    def keep(df, batch):
        df.select("user_id", F.unix_seconds("window.start").alias("window_start"), "n").write.mode("overwrite").parquet(f"{home}/out/batch_id={batch}")

    out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{home}/c").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("user_id long, window_start long, n long, batch_id long").parquet(f"{home}/out")
    return found.groupBy("user_id", "window_start").agg(F.max("n").alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS account, count(*) AS n FROM events GROUP BY 1")
def state_counts(spark, sf_dir):
    """Counts that live in a stream's state, with a time to live, as last told of each account."""
    home = shared_path(spark, "state")
    e = events(spark, sf_dir).select("user_id", "ts")
    e.write.parquet(f"{home}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{home}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, state.PROVIDER)
    try:
        keep = lambda df, batch: df.write.mode("overwrite").parquet(f"{home}/out/batch_id={batch}")
        q = state.velocity(stream, "user_id").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{home}/c").start()
        # with a time to live there is always another batch, so the first one without rows ends the run
        while q.isActive and (q.lastProgress is None or q.lastProgress["numInputRows"] > 0):
            q.awaitTermination(1)
        q.stop()
        if q.exception():
            raise q.exception()
    finally:
        spark.conf.set(name, before)
    found = spark.read.schema("account string, n long, batch_id long").parquet(f"{home}/out")
    return found.groupBy("account").agg(F.max("n").alias("n"))


# --- sinks and files


@query("SELECT event_id AS seq, event_type AS action FROM events WHERE event_id % 3 <> 2")
def audit_append(spark, sf_dir):
    """Two appends by a role that may only append, read by one that may only read."""
    path = shared_path(spark, "audit")
    rows = events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("event_type").alias("action"))
    app = catalog.Catalog(spark, "app_role")
    for part in (0, 1):
        app.append("audit.events", rows.filter(F.col("seq") % 3 == part), path)
    return catalog.Catalog(spark, "auditor_role", {"audit.events": lambda s: s.read.schema(rows.schema).parquet(path)}).read("audit.events")


@query(f"SELECT DISTINCT 'a' || user_id AS src, 'd' || device AS dst, 'Account' AS src_type, 'Device' AS dst_type, 'USED_DEVICE' AS edge_type, CAST(user_id % 4 AS INTEGER) AS part FROM {EVENTS}")
def graph_sink(spark, sf_dir):
    """Edges as the graph's store holds them after two overlapping batches were merged in: each once, by part of its
    source."""
    path = shared_path(spark, "graph")
    e = events(spark, sf_dir).select(F.concat(F.lit("a"), "user_id").alias("src"), F.concat(F.lit("d"), "device").alias("dst"), F.lit("Account").alias("src_type"), F.lit("Device").alias("dst_type"), F.lit("USED_DEVICE").alias("edge_type"), (F.col("user_id") % 4).cast("int").alias("part"), "event_id")
    kept = None
    for version, some in enumerate(("event_id % 3 <> 0", "event_id % 3 <> 1")):
        kept = files.merge_edges(spark, kept, e.filter(some).drop("event_id"), f"{path}/version={version}", "part")
    return kept


@query("""
    SELECT 'run-' || l_suppkey AS run_id, CASE WHEN l_suppkey % 4 = 0 THEN 'EXTERNAL' ELSE 'SYNTHETIC' END AS track, CAST(count(*) AS VARCHAR) AS cases FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY l_suppkey""")
def manifest_scan(spark, sf_dir):
    """Manifests from JSON files; files that are not JSON or name no run are passed over."""
    path = shared_path(spark, "manifests")
    runs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("run-"), "l_suppkey"))
    text = F.to_json(F.struct(named.alias("run_id"), F.when(F.col("l_suppkey") % 4 == 0, "EXTERNAL").otherwise("SYNTHETIC").alias("track"), F.col("n").alias("cases")))
    runs.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(text), ",\n"), F.lit("\n]")).alias("value")).coalesce(1).write.text(f"{path}/a", compression="none")
    spark.range(1).select(F.lit("{broken").alias("value")).coalesce(1).write.text(f"{path}/b", compression="none")
    return files.manifests(spark, f"{path}/*", "*.txt").select("run_id", "track", "cases")


@query("SELECT 'P' || p_partkey % 9 || '.part-' || p_partkey AS id, 'P' || p_partkey % 9 AS phase, ['NOT_STARTED', 'IN_PROGRESS', 'PASS', 'FAIL', 'BLOCKED'][p_partkey % 5 + 1] AS status, 'make ' || p_partkey AS command FROM part")
def capability_scan(spark, sf_dir):
    """Capabilities from a status file."""
    path = shared_path(spark, "status")
    k = F.col("p_partkey")
    states = F.array(*map(F.lit, ("NOT_STARTED", "IN_PROGRESS", "PASS", "FAIL", "BLOCKED")))
    one = F.struct(F.concat(F.lit("P"), k % 9, F.lit(".part-"), k).alias("id"), F.concat(F.lit("P"), k % 9).alias("phase"), F.element_at(states, (k % 5 + 1).cast("int")).alias("status"), F.struct(F.concat(F.lit("make "), k).alias("command")).alias("evidence"))
    table(spark, sf_dir, "part").agg(F.collect_list(one).alias("capabilities")).select(F.lit("x").alias("project"), F.lit("P1").alias("current_phase"), "capabilities").write.json(path)
    return files.capabilities(spark, path).select("id", "phase", "status", F.col("evidence.command").alias("command"))


@query("""
    SELECT lower(replace(n_name, ' ', '_')) || ': ' || CASE WHEN n_nationkey % 4 = 1 THEN 'missing' ELSE '3.' || n_nationkey || '0.1 is not 3.' || n_nationkey END AS problem FROM nation WHERE n_nationkey % 4 IN (1, 2)
    UNION ALL SELECT 'extra: no pin'""")
def pin_assertion(spark, sf_dir):
    """Pins from a TOML file against installed versions: one in four missing, one in four another version."""
    path = shared_path(spark, "pins")
    names = [(r.n, r.k) for r in table(spark, sf_dir, "nation").select(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("n"), F.col("n_nationkey").alias("k")).collect()]  # 25 rows
    text = "[tool.pins]\n" + "".join(f'{n} = "3.{k}"\n' for n, k in names)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    installed = {n: f"3.{k}0.1" if k % 4 == 2 else f"3.{k}.7" for n, k in names if k % 4 != 1} | {"extra": "1"}
    return spark.createDataFrame([(p,) for p in validation.pinned(files.pins(spark, path), installed)], "problem string")


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders")
def time_travel(spark, sf_dir):
    """The first version of a table that was written over twice."""
    path = shared_path(spark, "versions")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    files.save_version(rows, path, 1)
    files.save_version(rows.withColumn("status", F.lit("later")), path, 2)
    files.save_version(rows.limit(0), path, 3)
    return files.load_version(spark, path, 1, rows.schema)


@query("SELECT o_orderkey, max(o_totalprice + (o_orderkey % 3 = 0)::INT) AS price FROM orders GROUP BY 1")
def merged_table(spark, sf_dir):
    """Upserts: a third of the orders changed later, and the newest of each key kept."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(0).cast("timestamp").alias("at"))
    later = rows.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("price") + 1).alias("price"), F.lit(60).cast("timestamp").alias("at"))
    return files.merge(rows, later, ["o_orderkey"], "at").select("o_orderkey", "price")


@query("SELECT c_custkey, c_name, count(*) OVER () AS pinned_rows FROM customer")
def frozen_dataset(spark, sf_dir):
    """A dataset that was pinned when it was written, read again only because it still fits its pin."""
    pin = files.freeze(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), shared_path(spark, "frozen"), "customers")
    return files.thaw(spark, pin).withColumn("pinned_rows", F.lit(pin["rows"]).cast("long"))


@query("""
    SELECT 'act_' || o_orderkey AS transaction_id, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor, CAST(1512086400 + o_orderkey AS BIGINT) AS at_s, CASE WHEN o_orderkey % 2 = 0 THEN 'agent ' || o_custkey END AS user_agent,
           CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE round(o_totalprice / 7, 6) END AS v1, CASE WHEN o_orderkey % 5 = 0 THEN 'T' END AS m1, (o_orderkey % 3 <> 0)::INT + 1 AS held FROM orders""")
def identity_adapter(spark, sf_dir):
    """An external table with obfuscated columns and an identity table, in canonical form."""
    path, o, k = shared_path(spark, "external"), table(spark, sf_dir, "orders"), F.col("o_orderkey")
    o.select(k.alias("TransactionID"), k.alias("TransactionDT"), F.col("o_totalprice").alias("TransactionAmt"), (k % 100 == 0).cast("int").alias("isFraud"), F.when(k % 3 != 0, F.col("o_totalprice") / 7).alias("V1"), (k % 4).cast("double").alias("C2"), F.when(k % 5 == 0, "T").alias("M1")).write.parquet(f"{path}/transactions.parquet")
    o.filter(k % 2 == 0).select(k.alias("TransactionID"), F.concat(F.lit("agent "), "o_custkey").alias("DeviceInfo")).write.parquet(f"{path}/identity.parquet")
    rows = adapters.IdentityAdapter(spark, path).to_canonical()
    return rows.select("transaction_id", "amount_minor", F.unix_seconds("occurred_at").alias("at_s"), "user_agent", F.round(F.try_element_at("opaque_features", F.lit("V1")), 6).alias("v1"), F.try_element_at("opaque_labels", F.lit("M1")).alias("m1"), F.size("opaque_features").alias("held"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey IS NOT NULL")
def relational_scan(spark, sf_dir):
    """A database table read in eight slices of its key, by any executor; rows without a key are left out. Balances that
    the database can't hold as numbers stand beside them as text."""
    text = F.col("s_acctbal").cast("string")
    odd = F.when(text.isin("NaN", "Infinity", "-Infinity", "-0.0"), text)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(odd.isNull(), F.col("s_acctbal")).alias("s_acctbal"), odd.alias("odd"))
    read = files.relational(spark, files.embedded(rows, "supplier", "s_suppkey"), "supplier", "s_suppkey", None, None, 8, driver=files.EMBEDDED)
    return read.filter("s_suppkey IS NOT NULL").select("s_suppkey", "s_name", F.coalesce(F.col("odd").cast("double"), "s_acctbal").alias("s_acctbal"))


@query("SELECT count(*) AS n, count(*) AS ids, true AS all_in_range, true AS share_fits, true AS again_equal FROM events")
def generated_transactions(spark, sf_dir):
    """As many generated transactions as there are events: what must hold of them, and that a second run, cut otherwise,
    gives the same rows."""
    n = table(spark, sf_dir, "events").count()
    made = generator.transactions(spark, n, 5, accounts=max(1, n // 50), positive=0.05)
    same = adapters.digest(made) == adapters.digest(generator.transactions(spark, n, 5, accounts=max(1, n // 50), positive=0.05).repartition(7))
    in_range = (F.col("amount_minor") > 0) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & (F.col("is_fraud") == F.col("fraud_pattern").isNotNull())
    share = F.avg(F.col("is_fraud").cast("int"))
    return made.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("transaction_id").alias("ids"), F.min(in_range).alias("all_in_range"), (F.abs(share - 0.05) < 5 * (0.0475 / max(n, 1)) ** 0.5).alias("share_fits"), F.lit(same).alias("again_equal"))


@query("""
    SELECT user_id, count(DISTINCT CASE WHEN value > 40 THEN CASE WHEN event_id % 3 = 0 THEN 'EXTERNAL' ELSE 'SYNTHETIC' END END) = 2 AS refused FROM events GROUP BY 1""")
def forbidden_union(spark, sf_dir):
    """Accounts whose results would put both families in one table."""
    track = F.when(F.col("value") > 40, F.when(F.col("event_id") % 3 == 0, "EXTERNAL").otherwise("SYNTHETIC"))
    return events(spark, sf_dir).groupBy("user_id").agg(F.collect_set(track).alias("t")).select("user_id", catalog.mixes(F.col("t")).alias("refused"))


@query("""
    SELECT event_id, '{"password": "«redacted»", "ctx": {"who": "mail «redacted»", "tries": [{"pan": "«redacted»"}, ' || event_id || ', "from «redacted»"]}, "kind": "' || event_type || '"}' AS body FROM events""")
def json_redacted(spark, sf_dir):
    """Nested documents with every string redacted and sensitive keys emptied, at any depth."""
    body = F.concat(F.lit('{"password": "x'), "event_id", F.lit('", "ctx": {"who": "mail u'), "user_id", F.lit('@bank.org", "tries": [{"pan": '), "event_id", F.lit("}, "), "event_id", F.lit(', "from 10.0.0.'), F.col("user_id") % 200, F.lit('"]}, "kind": "'), "event_type", F.lit('"}'))
    return events(spark, sf_dir).select("event_id", redact.redact_json(body).alias("body"))


@query("SELECT round(avg((value > 60)::INT), 6) AS rate, true AS real_learns, true AS shuffled_does_not FROM events")
def leakage_check(spark, sf_dir):
    """A model on shuffled labels does no better than the base rate, while the same model on real ones does."""
    rows = events(spark, sf_dir).select("event_id", "value", F.hour("ts").cast("double").alias("hour"), (F.col("value") > 60).cast("int").alias("label"))
    part = lambda df, k: df.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k)

    def auc(df):
        scored = ml.Calibrated(["value", "hour"], "label", rounds=3, depth=3).fit(part(df, 0), part(df, 1)).score(part(df, 2))
        return metrics.roc_auc(scored, "score", "label").first()[0]

    real, fake = auc(cut(rows)), auc(cut(ml.shuffled_labels(rows, "label")))
    return rows.agg(F.round(F.avg("label"), 6).alias("rate"), F.lit(real > 0.95).alias("real_learns"), F.lit(abs(fake - 0.5) < 0.12).alias("shuffled_does_not"))


@query(f"SELECT user_id, count(DISTINCT device) AS devices, true AS within_bound FROM {EVENTS} GROUP BY 1")
def approx_distinct_bound(spark, sf_dir):
    """Sketched distinct counts beside exact ones: none is off by more than 5 %."""
    e = events(spark, sf_dir)
    sketched = e.groupBy("user_id").agg(F.hll_sketch_agg("device", F.lit(14)).alias("s"))
    exact = e.select("user_id", "device").distinct().groupBy("user_id").agg(F.count("device").alias("devices"))
    near = F.abs(F.hll_sketch_estimate("s") - F.col("devices")) <= 0.05 * F.col("devices")
    return exact.join(sketched, "user_id").select("user_id", "devices", near.alias("within_bound"))


@query("SELECT c_custkey AS note, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT c_custkey, ['name ' || c_name, '', 'in ' || c_mktsegment] AS l FROM customer WHERE c_custkey % 50 = 0)")
def text_scan(spark, sf_dir):
    """Lines with their numbers of text files in folders; files of other endings are passed over."""
    path = shared_path(spark, "notes")
    c = table(spark, sf_dir, "customer").filter("c_custkey % 50 = 0")
    body = F.concat(F.lit("name "), "c_name", F.lit("\n\nin "), "c_mktsegment")
    c.select(body.alias("value"), F.col("c_custkey").alias("note")).repartition("note").write.partitionBy("note").option("compression", "none").text(path)
    note = F.regexp_extract("path", "note=([0-9]+)", 1).cast("long")
    return claims.lines(files.texts(spark, path, "*.txt").select(note.alias("note"), "text"), "note")
