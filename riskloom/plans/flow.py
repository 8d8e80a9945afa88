"""Queries over the event and transaction flow: checks, features, windows, joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import ids, measures
from riskloom.operators import controls, graph, metrics, rules, timeline, validation
from riskloom.schemas import PAYLOADS
from riskloom.sources.adapters import EventsAdapter, OrdersAdapter, coverage_mismatch

from .inputs import EVENTS, events, ntz, table
from .registry import query

FRAME = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {} PRECEDING AND CURRENT ROW)"


@query(f"""
    SELECT event_id, user_id, count(*) {FRAME.format('1 MINUTE')} AS n_1m, count(*) {FRAME.format('5 MINUTE')} AS n_5m,
           count(*) {FRAME.format('1 HOUR')} AS n_1h, count(*) {FRAME.format('24 HOUR')} AS n_24h, round(sum(value) {FRAME.format('24 HOUR')}, 4) AS amount_24h
    FROM events""")
def velocity_trailing(spark, sf_dir):
    """Events of the account in the last minute, five minutes, hour and day, both ends included."""
    one = F.count(F.lit(1))
    frames = {"n_1m": (60, one), "n_5m": (300, one), "n_1h": (3600, one), "n_24h": (86_400, one), "s": (86_400, F.sum("value"))}
    out = timeline.trailing(events(spark, sf_dir), "user_id", "ts", frames)
    return out.select("event_id", "user_id", "n_1m", "n_5m", "n_1h", "n_24h", F.round("s", 4).alias("amount_24h"))


@query("""
    SELECT user_id, CAST(width AS BIGINT) AS width_s, CAST(epoch_us(ts) // (CAST(width AS BIGINT) * 1000000) * width AS BIGINT) AS window_start, count(*) AS n, round(sum(value), 4) AS total
    FROM events, (VALUES (60), (300), (3600), (86400)) AS w(width) GROUP BY ALL""")
def velocity_tumbling(spark, sf_dir):
    """Tumbling counts at four widths from one pass."""
    e = events(spark, sf_dir).withColumn("width_s", F.explode(F.array(*[F.lit(w).cast("long") for w in (60, 300, 3600, 86_400)])))
    start = F.floor(F.unix_micros("ts") / (F.col("width_s") * 1_000_000)) * F.col("width_s")
    return e.groupBy("user_id", "width_s", start.cast("long").alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
    SELECT user_id, CAST((epoch_us(ts) // 900000000 - k) * 900 AS BIGINT) AS window_start, count(*) AS n
    FROM events, (VALUES (0), (1), (2), (3)) AS s(k) GROUP BY ALL""")
def velocity_sliding(spark, sf_dir):
    """One-hour windows every quarter of an hour."""
    w = events(spark, sf_dir).groupBy("user_id", F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.unix_seconds("w.start").alias("window_start"), "n")


@query("""
    WITH t AS (SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS a FROM orders)
    SELECT o_custkey AS account, count(*) AS n, CAST(sum(a) AS BIGINT) AS total_minor, round(avg(a), 4) AS mean_minor, round(stddev_samp(a), 2) AS sd_minor, min(a) AS min_minor, max(a) AS max_minor
    FROM t GROUP BY 1""")
def amount_stats(spark, sf_dir):
    a = F.col("a")
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), measures.minor_units(F.col("o_totalprice")).alias("a"))
    return t.groupBy("account").agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("total_minor"), F.round(F.avg(a), 4).alias("mean_minor"), F.round(F.stddev_samp(a), 2).alias("sd_minor"), F.min(a).alias("min_minor"), F.max(a).alias("max_minor"))


@query(f"SELECT user_id, count(DISTINCT device) AS devices, count(DISTINCT event_type) AS kinds FROM {EVENTS} GROUP BY 1")
def distinct_entities(spark, sf_dir):
    """Exact distinct counts; each is deduplicated before it is counted, so a busy account is combined early."""
    e = events(spark, sf_dir)
    device = e.select("user_id", "device").distinct().groupBy("user_id").agg(F.count("device").alias("devices"))
    kind = e.select("user_id", "event_type").distinct().groupBy("user_id").agg(F.count("event_type").alias("kinds"))
    return device.join(kind, "user_id")


@query()
def distinct_entities_approx(spark, sf_dir):
    """Distinct counts by mergeable sketches of about 0.8 % error; the estimate itself has no counterpart in SQL."""
    s = events(spark, sf_dir).groupBy("user_id").agg(F.hll_sketch_agg("device", F.lit(14)).alias("s"))
    return s.select("user_id", F.hll_sketch_estimate("s").alias("devices"))


@query("""
    SELECT l_suppkey AS merchant, count(*) AS sales, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS flagged_share, count(DISTINCT l_orderkey) AS orders
    FROM lineitem GROUP BY 1""")
def merchant_risk(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("merchant"), "l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("r"))
    return per.groupBy("merchant").agg(F.sum("n").alias("sales"), F.round(F.sum("r") / F.sum("n"), 6).alias("flagged_share"), F.count(F.lit(1)).alias("orders"))


@query("""
    SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, last(event_type ORDER BY ts, event_id) AS last_kind, last(event_id ORDER BY value, event_id) AS largest_event
    FROM events GROUP BY 1""")
def entity_profile(spark, sf_dir):
    out = events(spark, sf_dir).groupBy("user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"),
        F.max_by("event_id", F.struct("value", "event_id")).alias("largest_event"))
    return out.select("user_id", ntz("first_seen"), ntz("last_seen"), "n", "last_kind", "largest_event")


@query(f"""
    WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1),
         d AS (SELECT user_id, median(abs(value - m)) AS d FROM events JOIN m USING (user_id) GROUP BY 1)
    SELECT event_id, round(0.6745 * (value - m) / nullif(d, 0), 4) AS robust_z FROM events JOIN m USING (user_id) JOIN d USING (user_id)""")
def robust_z(spark, sf_dir):
    return metrics.robust_z(events(spark, sf_dir), "user_id", "value").select("event_id", F.round("robust_z", 4).alias("robust_z"))


@query(f"SELECT event_id, CAST(len(list_distinct(list(device) {FRAME.format('24 HOUR')})) AS BIGINT) AS devices_24h FROM {EVENTS}")
def trailing_distinct(spark, sf_dir):
    out = timeline.trailing(events(spark, sf_dir), "user_id", "ts", {"d": (86_400, F.collect_set("device"))})
    return out.select("event_id", F.size("d").cast("long").alias("devices_24h"))


@query(f"SELECT event_id, round(median(value) {FRAME.format('24 HOUR')}, 6) AS median_24h FROM events")
def trailing_median(spark, sf_dir):
    out = timeline.trailing(events(spark, sf_dir), "user_id", "ts", {"m": (86_400, F.percentile("value", 0.5))})
    return out.select("event_id", F.round("m", 6).alias("median_24h"))


@query("""
    SELECT event_id, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w AS BIGINT) AS gap_us, lag(event_type) OVER w AS previous_kind
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def prev_event_gap(spark, sf_dir):
    out = timeline.last_before(events(spark, sf_dir), "user_id", ["ts", "event_id"], "ts", F.struct(F.unix_micros("ts").alias("us"), "event_type"), "p")
    return out.select("event_id", (F.unix_micros("ts") - F.col("p.us")).alias("gap_us"), F.col("p.event_type").alias("previous_kind"))


@query("""
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2""")
def sessions(spark, sf_dir):
    """Sessions that end after 30 idle minutes."""
    out = timeline.sessions(events(spark, sf_dir), "user_id", ["ts", "event_id"], "ts", 1800)
    out = out.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))
    return out.select("user_id", "session", ntz("started"), ntz("ended"), "n")


@query("""
    SELECT p.event_id, p.user_id, v.event_id AS view_id, round(v.value, 4) AS view_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    LEFT JOIN LATERAL (SELECT event_id, value FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts < p.ts ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 1) v ON true""")
def pit_training_set(spark, sf_dir):
    """Purchases with the account's latest view strictly before them."""
    e = events(spark, sf_dir)
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.round("value", 4).alias("view_value"))
    out = timeline.asof(e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), views, "user_id", "ts", "event_id", "view_id", ["view_id", "view_value"])
    return out.select("event_id", "user_id", "view_id", "view_value")


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-22 00:00:00' THEN 'train' ELSE 'test' END AS part FROM events")
def temporal_split(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.when(F.col("ts") < F.lit("2024-01-22T00:00:00Z").cast("timestamp"), "train").otherwise("test").alias("part"))


COPIES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT {COPIES} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, {COPIES}) AS r FROM lineitem) WHERE r = 1")
def dedup_events(spark, sf_dir):
    """First row by ship date of each repeated key."""
    rows = table(spark, sf_dir, "lineitem").select(*COPIES.split(", "))
    return timeline.dedup(rows, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate")])


@query("""
    SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber FROM (
        SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1""")
def latest_per_key(spark, sf_dir):
    """Newest row of each key, combined map-side."""
    top = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("t"))
    return top.select("l_partkey", "t.l_shipdate", "t.l_orderkey", "t.l_linenumber")


@query("""
    SELECT event_id, max(version) AS version, max(device) AS device FROM (
        SELECT event_id, 1 AS version, NULL AS device FROM events WHERE event_id % 3 <> 0
        UNION ALL SELECT event_id, 2, device FROM """ + EVENTS + """ WHERE event_id % 2 = 0) GROUP BY 1""")
def dual_version_union(spark, sf_dir):
    """Both versions of an event read together, the newer kept."""
    e = events(spark, sf_dir)
    v1 = e.filter("event_id % 3 <> 0").select("event_id", F.lit(1).alias("version"))
    v2 = e.filter("event_id % 2 = 0").select("event_id", F.lit(2).alias("version"), "device")
    both = v1.unionByName(v2, allowMissingColumns=True)
    return both.groupBy("event_id").agg(F.max("version").alias("version"), F.max_by("device", "version").alias("device"))


# --- the edge

INGESTED = "ts + (event_id * 37 % 1200) * INTERVAL 1 SECOND"


def enveloped(spark, sf_dir):
    """Events as envelopes in which some fields are missing by rule."""
    e = events(spark, sf_dir)
    gone = lambda n, c: F.when(F.col("event_id") % n != 0, c)
    return e.select(
        F.col("event_id").alias("n"), F.col("event_id").cast("string").alias("event_id"), "event_type", (F.col("event_id") % 4 + 1).cast("int").alias("schema_version"), F.col("ts").alias("occurred_at"),
        (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") * 37 % 1200).cast("decimal(18,6)"))).alias("ingested_at"), gone(7, F.lit("gateway")).alias("producer"),
        gone(11, F.sha2(F.col("event_id").cast("string"), 256).substr(1, 32)).alias("trace_id"), F.lit("c").alias("correlation_id"), gone(13, F.lit("k")).alias("idempotency_key"), gone(17, F.lit("{}")).alias("payload"), "value")


@query("""
    SELECT event_id AS n, concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'producer' END, CASE WHEN event_id % 11 = 0 THEN 'trace_id' END,
           CASE WHEN event_id % 13 = 0 THEN 'idempotency_key' END, CASE WHEN event_id % 17 = 0 THEN 'payload' END) AS missing
    FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0""")
def envelope_incomplete(spark, sf_dir):
    out = enveloped(spark, sf_dir).withColumn("m", validation.missing_fields())
    return out.filter(F.size("m") > 0).select("n", F.concat_ws(",", "m").alias("missing"))


@query("""
    SELECT event_id AS n, concat_ws(',', CASE WHEN event_id % 4 > 1 THEN 'version' END, CASE WHEN value > 200 THEN 'amount' END, CASE WHEN event_id % 11 = 0 THEN 'trace' END) AS errors
    FROM events WHERE event_id % 4 > 1 OR value > 200 OR event_id % 11 = 0""")
def silver_dlq(spark, sf_dir):
    """Dead letters with all that is wrong with each."""
    known = F.col("schema_version") <= 2
    found = validation.errors(("version", ~known), ("amount", F.col("value") > 200), ("trace", F.col("trace_id").isNull() | ~ids.is_trace_id(F.col("trace_id"))))
    _, dead = validation.route(enveloped(spark, sf_dir).withColumn("errors", found))
    return dead.select("n", F.concat_ws(",", "errors").alias("errors"))


@query("""
    SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 24 HOUR THEN 'REJECT' WHEN ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 90 DAY THEN 'FLAG' ELSE 'OK' END AS verdict FROM events""")
def clock_skew(spark, sf_dir):
    """Against a reference time that is a parameter, not the clock."""
    return events(spark, sf_dir).select("event_id", validation.clock_verdict(F.col("ts"), F.lit("2024-01-20T00:00:00Z").cast("timestamp")).alias("verdict"))


@query(f"""
    SELECT event_type, count(*) AS n, round(avg(epoch_us({INGESTED}) - epoch_us(ts)) / 1e6, 4) AS mean_lag_s, max(epoch_us({INGESTED}) - epoch_us(ts)) / 1e6 AS max_lag_s FROM events GROUP BY 1""")
def ingest_lag(spark, sf_dir):
    out = enveloped(spark, sf_dir).withColumn("lag", measures.lag_seconds(F.col("occurred_at"), F.col("ingested_at")))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lag"), 4).alias("mean_lag_s"), F.max("lag").alias("max_lag_s"))


BATCHED = "(SELECT *, (event_id + event_id * 7919 % 500) // 500 AS batch FROM events)"


@query(f"""
    WITH m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS mark FROM {BATCHED} GROUP BY 1)
    SELECT event_id, CAST(batch AS BIGINT) AS batch, coalesce(ts < mark, false) AS is_late FROM {BATCHED} JOIN m USING (batch)""")
def late_events_split(spark, sf_dir):
    """Late against the greatest time of all batches before, less ten minutes."""
    return late_split(events(spark, sf_dir)).select("event_id", "batch", "is_late")


def late_split(e):
    e = e.withColumn("batch", F.floor((F.col("event_id") + F.col("event_id") * 7919 % 500) / 500).cast("long"))
    return controls.marked_late(e, "batch", "ts")


@query("SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'UNKNOWN' END AS kind, count(*) AS n FROM events GROUP BY 1")
def unknown_enum(spark, sf_dir):
    return events(spark, sf_dir).groupBy(validation.known_or(F.col("event_type"), ["view", "click", "purchase"]).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, sha256('pepper' || c_name) AS token, right(c_name, 4) AS last_four FROM customer")
def pii_tokens(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", ids.token(F.col("c_name"), "pepper").alias("token"), F.right("c_name", F.lit(4)).alias("last_four"))


@query("SELECT 'act_' || o_orderkey AS transaction_id, 'acc_' || o_custkey AS account_id, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor, o_orderdate AS occurred_at FROM orders")
def canonical_orders(spark, sf_dir):
    return OrdersAdapter(spark, sf_dir).to_canonical().select("transaction_id", "account_id", "amount_minor", ntz("occurred_at"))


@query("""
    SELECT 'act_' || o_orderkey AS transaction_id, c_mktsegment AS segment, c_nationkey AS nation, CAST(round(c_acctbal * 100) AS BIGINT) AS balance_minor
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def canonical_enriched(spark, sf_dir):
    """Transactions keep their place whether or not the account is known."""
    c = table(spark, sf_dir, "customer").select(ids.typed_id("acc_", F.col("c_custkey")).alias("account_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), measures.minor_units(F.col("c_acctbal")).alias("balance_minor"))
    return OrdersAdapter(spark, sf_dir).to_canonical().join(c, "account_id", "left").select("transaction_id", "segment", "nation", "balance_minor")


@query(f"SELECT 'act_' || event_id AS transaction_id, CAST(round(value * 100) AS BIGINT) AS amount_feature, 'dev_' || device AS device_feature, CAST(NULL AS DOUBLE) AS geo_feature FROM {EVENTS}")
def coverage_features(spark, sf_dir):
    """A feature whose fields the source does not supply is null, never zero."""
    c = EventsAdapter(spark, sf_dir).to_canonical()
    gate = lambda v, *f: validation.gated(v, list(f), F.col("field_coverage"))
    return c.select("transaction_id", gate(F.col("amount_minor"), "amount_minor").alias("amount_feature"), gate(F.col("device_id"), "device_id").alias("device_feature"), gate(F.coalesce("lat", F.lit(0.0)), "lat", "lon").alias("geo_feature"))


@query("SELECT 'device_id' AS field, 'filled, not declared' AS problem UNION ALL SELECT 'currency', 'declared, never filled'")
def coverage_mismatch_report(spark, sf_dir):
    """What an adapter that misdeclares itself is told."""
    return coverage_mismatch(EventsAdapter(spark, sf_dir).to_canonical(), ("transaction_id", "account_id", "occurred_at", "amount_minor", "currency"))


@query("SELECT 'acc_' || c_custkey AS id, c_custkey % 2 = 0 AS valid FROM customer")
def typed_ids(spark, sf_dir):
    made = F.when(F.col("c_custkey") % 2 == 0, ids.typed_id("acc_", F.col("c_custkey"))).otherwise(F.concat(F.lit("acc-"), "c_custkey"))
    return table(spark, sf_dir, "customer").select(F.replace(made, F.lit("acc-"), F.lit("acc_")).alias("id"), ids.is_typed_id(made, "acc_").alias("valid"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'UNTRUSTED' WHEN event_id % 2 = 0 THEN 'DERIVED' ELSE 'SYSTEM' END AS tier FROM events")
def trust_tiers(spark, sf_dir):
    """A value made of several takes the least trusted tier."""
    a, b = F.when(F.col("event_id") % 2 == 0, "DERIVED").otherwise("SYSTEM"), F.when(F.col("event_id") % 3 == 0, "UNTRUSTED").otherwise("SYSTEM")
    return events(spark, sf_dir).select("event_id", validation.least_trusted(a, b).alias("tier"))


@query("""
    WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"account_id": "acc_' || user_id || '", "change": "email"}' WHEN 1 THEN '{"account_id": "acc_' || user_id || '", "change": "' || event_type || '"}'
            WHEN 2 THEN '{"account_id": "a", "change": "phone", "admin": true}' WHEN 3 THEN '{}' ELSE 'not json ' || event_id END AS payload FROM events),
    k AS (SELECT event_id, json_valid(payload) AS ok, CASE WHEN json_valid(payload) THEN json_keys(payload) ELSE [] END AS keys, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.change') END AS change FROM p)
    SELECT event_id, concat_ws(',', CASE WHEN NOT ok THEN 'json' END, CASE WHEN len(list_filter(keys, lambda x: x NOT IN ('account_id', 'change'))) > 0 THEN 'extra' END,
        CASE WHEN change IS NULL OR change NOT IN ('email', 'phone', 'device') THEN 'enum' END) AS errors FROM k""")
def strict_payload(spark, sf_dir):
    """A field beyond the schema or a value beyond the list is refused, not bent to fit."""
    k, account = F.col("event_id") % 5, F.concat(F.lit('{"account_id": "acc_'), "user_id", F.lit('", "change": "'))
    made = F.when(k == 0, F.concat(account, F.lit('email"}'))).when(k == 1, F.concat(account, "event_type", F.lit('"}')))
    made = made.when(k == 2, F.lit('{"account_id": "a", "change": "phone", "admin": true}')).when(k == 3, F.lit("{}")).otherwise(F.concat(F.lit("not json "), "event_id"))
    df = events(spark, sf_dir).select("event_id", made.alias("payload"))
    change = F.get_json_object("payload", "$.change")
    found = validation.errors(
        ("json", F.json_object_keys("payload").isNull()), ("extra", F.size(validation.extra_fields(F.col("payload"), PAYLOADS["identity.changed", 1])) > 0), ("enum", change.isNull() | ~change.isin("email", "phone", "device")))
    return df.select("event_id", F.concat_ws(",", found).alias("errors"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity, 4) AS v1, round(l_discount, 4) AS v2, CASE WHEN l_tax > 0 THEN 2 ELSE 1 END + (l_quantity IS NOT NULL)::INT AS held FROM lineitem""")
def opaque_features(spark, sf_dir):
    """Columns nobody explains travel in one typed map, and only those that hold a value."""
    li = table(spark, sf_dir, "lineitem")
    packed = F.map_filter(F.create_map(F.lit("V1"), F.col("l_quantity"), F.lit("V2"), F.col("l_discount"), F.lit("V3"), F.when(F.col("l_tax") > 0, F.col("l_tax"))), lambda k, v: v.isNotNull())
    return li.select("l_orderkey", "l_linenumber", "l_partkey", packed.alias("m")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.try_element_at("m", F.lit("V1")), 4).alias("v1"), F.round(F.try_element_at("m", F.lit("V2")), 4).alias("v2"), F.size("m").alias("held"))


# --- rules and triage

SCORED = """(
    SELECT *, least(40 * (amount_minor > 40000000)::INT + 20 * (amount_minor > 30000000)::INT + 15 * (amount_minor < 200000)::INT + 10 * (amount_minor % 10000 = 0)::INT
        + 15 * (priority = '1-URGENT')::INT + 5 * (priority = '2-HIGH')::INT + 5 * (priority = '4-NOT SPECIFIED')::INT + 10 * (status = 'O')::INT + 10 * (status = 'P')::INT
        + 20 * (balance_minor < 0)::INT + 10 * (amount_minor > 50 * balance_minor)::INT + 5 * (segment = 'MACHINERY')::INT + 5 * (segment = 'BUILDING')::INT
        + 5 * (day(placed) >= 28)::INT + 5 * (dayofweek(placed) IN (0, 6))::INT, 100) AS score
    FROM (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor, o_orderpriority AS priority, o_orderstatus AS status, o_orderdate AS placed,
                 CAST(round(c_acctbal * 100) AS BIGINT) AS balance_minor, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey))"""
BAND = "CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END"


def scored(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    t = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", measures.minor_units(F.col("o_totalprice")).alias("amount_minor"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("occurred_at"), measures.minor_units(F.col("c_acctbal")).alias("balance_minor"), F.col("c_mktsegment").alias("segment"))
    return rules.scored(t, rules.ORDERS.usable({"amount_minor", "occurred_at"}))


@query(f"""
    SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN amount_minor > 40000000 THEN 'amount_over_4000' END, CASE WHEN amount_minor > 30000000 THEN 'amount_over_3000' END,
        CASE WHEN amount_minor < 200000 THEN 'amount_tiny' END, CASE WHEN amount_minor % 10000 = 0 THEN 'amount_round' END, CASE WHEN priority = '1-URGENT' THEN 'urgent' END, CASE WHEN priority = '2-HIGH' THEN 'high_priority' END,
        CASE WHEN priority = '4-NOT SPECIFIED' THEN 'unspecified_priority' END, CASE WHEN status = 'O' THEN 'status_open' END, CASE WHEN status = 'P' THEN 'status_pending' END, CASE WHEN balance_minor < 0 THEN 'negative_balance' END,
        CASE WHEN amount_minor > 50 * balance_minor THEN 'over_balance' END, CASE WHEN segment = 'MACHINERY' THEN 'segment_machinery' END, CASE WHEN segment = 'BUILDING' THEN 'segment_building' END,
        CASE WHEN day(placed) >= 28 THEN 'month_end' END, CASE WHEN dayofweek(placed) IN (0, 6) THEN 'weekend' END]) AS rule FROM {SCORED}) WHERE rule IS NOT NULL GROUP BY 1""")
def rules_hits(spark, sf_dir):
    return scored(spark, sf_dir).select(F.explode("hits").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey, CAST(score AS BIGINT) AS score, {BAND} AS band FROM {SCORED}")
def rules_score(spark, sf_dir):
    return scored(spark, sf_dir).select("o_orderkey", "score", "band")


@query(f"SELECT o_orderkey, {BAND} AS band FROM {SCORED} WHERE score >= 60")
def triage(spark, sf_dir):
    return rules.triage(scored(spark, sf_dir)).select("o_orderkey", "band")


@query(f"""
    SELECT o_orderkey, p.user_id IS NULL AS degraded, coalesce(n, 0) AS profile_events FROM {SCORED} LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) p ON o_custkey = p.user_id""")
def degraded_scoring(spark, sf_dir):
    """Accounts without an online profile are scored by rules alone and say so."""
    p = events(spark, sf_dir).groupBy(F.col("user_id").alias("o_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return rules.with_profiles(scored(spark, sf_dir), p, "o_custkey").select("o_orderkey", "degraded", F.coalesce("n", F.lit(0)).alias("profile_events"))


@query("SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def entity_scope(spark, sf_dir):
    """Only what belongs to the entities in scope."""
    scope = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return controls.in_scope(events(spark, sf_dir), scope, "user_id").select("event_id")


@query("SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey % 5 = 2 OR o_orderkey % 5 = 4")
def row_visibility(spark, sf_dir):
    """An analyst sees their own and unassigned cases."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 5 != 4, F.concat(F.lit("analyst"), F.col("o_orderkey") % 5)).alias("assignee"))
    return controls.visible(cases, "analyst2", "analyst").select("case_id")


@query("""
    SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 2""")
def circuit_breaker(spark, sf_dir):
    """Accounts with two actions of a type or more in an hour."""
    e = events(spark, sf_dir).filter("event_type = 'error'")
    return controls.tripped(e, "user_id", "ts", 1).select("user_id", F.col("window").alias("hour"), F.col("actions").alias("errors"))


LATE = f"""(WITH m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS mark FROM {BATCHED} GROUP BY 1)
    SELECT e.*, coalesce(ts < mark, false) AS is_late FROM {BATCHED} e JOIN m USING (batch))"""
ONLINE = f"(SELECT user_id FROM {LATE} WHERE NOT is_late UNION ALL SELECT user_id FROM {LATE} WHERE NOT is_late AND event_id % 50 = 0)"


def parity(spark, sf_dir):
    """Offline counts of all events beside an online store that misses late ones and counts some twice."""
    e = late_split(events(spark, sf_dir))
    offline = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("offline"))
    online = e.filter("not is_late").groupBy("user_id").agg(F.sum(F.when(F.col("event_id") % 50 == 0, 2).otherwise(1)).alias("online"))
    return controls.parity(offline, online, "user_id")


@query(f"""
    SELECT coalesce(a.user_id, b.user_id) AS user_id, offline, CAST(online AS BIGINT) AS online FROM (SELECT user_id, count(*) AS offline FROM events GROUP BY 1) a
    FULL JOIN (SELECT user_id, count(*) AS online FROM {ONLINE} GROUP BY 1) b ON a.user_id = b.user_id WHERE offline IS DISTINCT FROM online""")
def feature_parity(spark, sf_dir):
    return parity(spark, sf_dir).filter("not equal").select("user_id", "offline", "online")


@query(f"""
    SELECT round(avg(abs(coalesce(online, 0) - offline) / greatest(offline, 1)), 6) AS drift FROM (SELECT user_id, count(*) AS offline FROM events GROUP BY 1) a
    LEFT JOIN (SELECT user_id, count(*) AS online FROM {ONLINE} GROUP BY 1) b ON a.user_id = b.user_id""")
def parity_drift(spark, sf_dir):
    p = parity(spark, sf_dir).withColumn("online", F.coalesce("online", F.lit(0)))
    return p.agg(F.round(metrics.drift(p, "online", "offline"), 6).alias("drift"))


# --- limits

@query("SELECT o_orderkey, o_totalprice, count(*) OVER () >= 25 AND (SELECT count(*) FROM orders) > 25 AS truncated FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)")
def capped_rows(spark, sf_dir):
    """The 25 largest orders, and whether there were more."""
    return graph.capped(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 50")
def cursor_page(spark, sf_dir):
    return graph.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 40, 50)
