"""Queries over graphs, fraud scenarios, and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import graph, metrics, ml, scenarios, timeline

from .inputs import EVENTS, events, fraud_events, ntz, table
from .registry import query

#: Uses of devices make the graph's edges.
USES = f"(SELECT DISTINCT user_id, device FROM {EVENTS})"
EDGES = f"(SELECT 'a' || user_id AS src, 'd' || device AS dst FROM {USES})"
BOTH = f"(SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES})"


def uses(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "device").distinct()


def edges(spark, sf_dir):
    return uses(spark, sf_dir).select(F.concat(F.lit("a"), "user_id").alias("src"), F.concat(F.lit("d"), "device").alias("dst"))


@query(f"SELECT src, dst, 'Account' AS src_type, 'Device' AS dst_type, 'USED_DEVICE' AS edge_type FROM {EDGES}")
def graph_edges(spark, sf_dir):
    return edges(spark, sf_dir).select("src", "dst", F.lit("Account").alias("src_type"), F.lit("Device").alias("dst_type"), F.lit("USED_DEVICE").alias("edge_type"))


@query(f"SELECT device, user_id, sharers FROM {USES} JOIN (SELECT device, count(*) AS sharers FROM {USES} GROUP BY 1 HAVING count(*) >= 4) USING (device)")
def shared_device_accounts(spark, sf_dir):
    """A row per use of a device that four accounts or more share."""
    return graph.shared(uses(spark, sf_dir), "device", "user_id", 4)


@query(f"""
    WITH e AS (SELECT event_id, user_id, device, ts FROM {EVENTS})
    SELECT a.event_id, b.user_id AS other, CAST(epoch_us(a.ts) - epoch_us(b.ts) AS BIGINT) AS gap_us FROM e a JOIN LATERAL (
        SELECT user_id, ts FROM e b WHERE b.device = a.device AND b.user_id <> a.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) ORDER BY b.ts DESC, b.event_id DESC LIMIT 1) b ON true
    WHERE a.ts - b.ts <= INTERVAL 60 MINUTE""")
def shared_entity_window(spark, sf_dir):
    """Uses of a device within an hour of another account's use."""
    out = timeline.near_in_time(events(spark, sf_dir), "device", "user_id", ["ts", "event_id"], "ts", 3600)
    return out.select("event_id", "other", "gap_us")


@query(f"""
    WITH RECURSIVE e AS (SELECT event_id, user_id, device, ts FROM {EVENTS}),
    near AS (SELECT DISTINCT a.user_id AS x, b.user_id AS y FROM e a JOIN LATERAL (
        SELECT user_id, ts FROM e b WHERE b.device = a.device AND b.user_id <> a.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) ORDER BY b.ts DESC, b.event_id DESC LIMIT 1) b ON true WHERE a.ts - b.ts <= INTERVAL 1 MINUTE),
    l AS (SELECT x, y FROM near UNION SELECT y, x FROM near),
    r AS (SELECT x AS node, x AS root FROM l UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node WHERE r.root < l.y)
    SELECT node AS user_id, min(root) AS cluster FROM r GROUP BY 1""")
def shared_ip_cluster(spark, sf_dir):
    """Components of accounts whose uses of one origin lie within a minute."""
    near = timeline.near_in_time(events(spark, sf_dir), "device", "user_id", ["ts", "event_id"], "ts", 60)
    out = graph.components(graph.cut(near.select(F.col("user_id").alias("src"), F.col("other").alias("dst")).distinct()))
    return out.select(F.col("node").alias("user_id"), F.col("component").alias("cluster"))


@query(f"""
    WITH RECURSIVE w AS (SELECT 'a8' AS node, 0 AS hops UNION SELECT b.dst, w.hops + 1 FROM w JOIN {BOTH} b ON b.src = w.node WHERE w.hops < 3)
    SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY 1""")
def k_hop(spark, sf_dir):
    start = spark.range(1).select(F.lit("a8").alias("node"))
    return graph.k_hop(edges(spark, sf_dir), start, 3)


@query(f"""
    WITH RECURSIVE w AS (SELECT 'a8' AS node, ['a8'] AS path UNION ALL
        SELECT dst, path FROM (SELECT b.dst, list_append(w.path, b.dst) AS path, row_number() OVER (PARTITION BY b.dst ORDER BY w.path) AS r FROM w JOIN {BOTH} b ON b.src = w.node WHERE len(w.path) <= 4 AND NOT list_contains(w.path, b.dst)) WHERE r = 1)
    SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS length FROM w WHERE node = 'a46' ORDER BY len(path), w.path LIMIT 1""")
def shortest_link(spark, sf_dir):
    """The first of the shortest paths between two accounts within four steps."""
    return graph.shortest_path(edges(spark, sf_dir), "a8", "a46", 4).select(F.array_join("path", ">").alias("path"), "length")


@query(f"""
    WITH RECURSIVE w AS (SELECT 'a8' AS node, 0 AS hops UNION SELECT b.dst, w.hops + 1 FROM w JOIN {BOTH} b ON b.src = w.node WHERE w.hops < 2),
    m AS (SELECT DISTINCT node FROM w), l AS (SELECT count(*) AS links FROM {EDGES} WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)), v AS (SELECT count(*) AS nodes FROM m)
    SELECT nodes, links, round(2 * links / nullif(nodes * (nodes - 1), 0), 6) AS density FROM v, l""")
def ring_score(spark, sf_dir):
    """Density of an account's two-step neighbourhood."""
    e = graph.cut(edges(spark, sf_dir))
    near = graph.cut(graph.k_hop(e, spark.range(1).select(F.lit("a8").alias("node")), 2).select("node"))
    return graph.density(e, near).select("nodes", "links", F.round("density", 6).alias("density"))


SALES = "(SELECT l_suppkey AS merchant, o_custkey AS account, l_returnflag = 'R' AS flagged FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""
    SELECT merchant, count(*) AS accounts, CAST(sum(hit) AS BIGINT) AS flagged_accounts, round(sum(hit) / count(*), 6) AS share
    FROM (SELECT merchant, account, max(flagged::INT) AS hit FROM {SALES} GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 10 AND sum(hit) / count(*) >= 0.35""")
def merchant_collusion(spark, sf_dir):
    """Merchants with a concentration of flagged accounts."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    sales = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("merchant"), F.col("o_custkey").alias("account"), (F.col("l_returnflag") == "R").alias("flagged"))
    out = scenarios.merchant_collusion(sales, 10, 0.35)
    return out.select("merchant", "accounts", "flagged_accounts", F.round("share", 6).alias("share"))


Z = """(WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1), d AS (SELECT user_id, median(abs(value - m)) AS d FROM events JOIN m USING (user_id) GROUP BY 1)
    SELECT events.*, 0.6745 * (value - m) / nullif(d, 0) AS z FROM events JOIN m USING (user_id) JOIN d USING (user_id))"""


@query(f"SELECT event_id FROM {Z} WHERE z > 3.5")
def high_value(spark, sf_dir):
    return scenarios.high_value(fraud_events(spark, sf_dir)).select("event_id")


@query(f"""
    SELECT z.event_id, c.event_id AS change_id FROM {Z} z JOIN LATERAL (
        SELECT event_id, ts FROM events c WHERE c.event_type = 'signup' AND c.user_id = z.user_id AND c.ts < z.ts ORDER BY c.ts DESC LIMIT 1) c ON true
    WHERE z.z >= 3 AND z.ts - c.ts <= INTERVAL 24 HOUR""")
def account_takeover(spark, sf_dir):
    e = fraud_events(spark, sf_dir)
    return scenarios.account_takeover(e, e.filter("event_type = 'signup'")).select("event_id", "change_id")


@query("""
    SELECT event_id, n AS burst FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events WHERE value <= 5) WHERE n >= 2""")
def card_testing(spark, sf_dir):
    return scenarios.card_testing(fraud_events(spark, sf_dir), least=2, within=6 * 3600).select("event_id", "burst")


@query("""
    SELECT event_id, n_1m, n_5m FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 MINUTE PRECEDING AND CURRENT ROW) AS n_1m,
        count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW) AS n_5m FROM events) WHERE n_1m >= 2 OR n_5m >= 2""")
def velocity_attack(spark, sf_dir):
    return scenarios.velocity_attack(fraud_events(spark, sf_dir), minute=2, five=2).select("event_id", "n_1m", "n_5m")


@query(f"SELECT device, count(*) AS accounts FROM {USES} GROUP BY 1 HAVING count(*) >= 5")
def device_farm(spark, sf_dir):
    return scenarios.device_farm(fraud_events(spark, sf_dir))


@query(f"""
    WITH RECURSIVE u AS (SELECT DISTINCT user_id, device FROM {EVENTS}),
    e AS (SELECT 'a' || user_id AS src, 'd' || device AS dst FROM u WHERE device IN (SELECT device FROM u GROUP BY 1 HAVING count(*) >= 2)),
    b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    r AS (SELECT src AS node, src AS root FROM b UNION SELECT b.dst, r.root FROM r JOIN b ON b.src = r.node WHERE r.root < b.dst),
    c AS (SELECT node, min(root) AS component FROM r GROUP BY 1),
    s AS (SELECT component, CAST(sum(CASE WHEN node LIKE 'a%' THEN 1 ELSE 0 END) AS BIGINT) AS accounts, CAST(sum(CASE WHEN node LIKE 'd%' THEN 1 ELSE 0 END) AS BIGINT) AS devices FROM c GROUP BY 1),
    l AS (SELECT component, count(*) AS links FROM e JOIN c ON e.src = c.node GROUP BY 1)
    SELECT component, accounts, devices, links, round(links / (accounts * devices), 6) AS density FROM s JOIN l USING (component) WHERE accounts >= 3""")
def fraud_ring(spark, sf_dir):
    """Components of accounts and the devices that they share."""
    out = scenarios.fraud_ring(fraud_events(spark, sf_dir).select("account", "device"))
    return out.select("component", "accounts", "devices", "links", F.round("density", 6).alias("density"))


@query(f"""
    SELECT device AS ip, CAST(epoch_us(ts) // 21600000000 * 21600 AS BIGINT) AS window_start, count(DISTINCT user_id) AS accounts, count(*) AS failures
    FROM {EVENTS} WHERE event_type = 'error' GROUP BY ALL HAVING count(DISTINCT user_id) >= 3""")
def credential_stuffing(spark, sf_dir):
    """Devices stand for origins and errors for failed logins."""
    e = fraud_events(spark, sf_dir).select(F.col("device").alias("ip"), "account", "at", (F.col("event_type") != "error").alias("success"))
    return scenarios.credential_stuffing(e, 3, 6 * 3600)


@query(f"""
    WITH f AS (SELECT user_id, device, min((ts, event_id)) AS f FROM {EVENTS} GROUP BY 1, 2), k AS (SELECT user_id, min(ts) AS since FROM events GROUP BY 1)
    SELECT user_id AS account, device, f[2] AS event_id FROM f JOIN k USING (user_id) WHERE f[1] - since > INTERVAL 14 DAY""")
def unusual_device(spark, sf_dir):
    return scenarios.unusual_device(fraud_events(spark, sf_dir), 14 * 86_400).select("account", "device", "event_id")


PLACES = "(SELECT *, CAST(event_id * 7919 % 1600 AS DOUBLE) / 10 - 80 AS lat, CAST(event_id * 104729 % 3600 AS DOUBLE) / 10 - 180 AS lon FROM events)"


@query(f"""
    WITH p AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(ts) OVER w AS ts0 FROM {PLACES} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    k AS (SELECT *, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(lat0)) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) AS km FROM p)
    SELECT event_id, round(km, 3) AS km FROM k WHERE km > 900 * (epoch_us(ts) - epoch_us(ts0)) / 3.6e9 AND km > 1""")
def impossible_travel(spark, sf_dir):
    """Places are derived from the event's number, as the table has none."""
    e = fraud_events(spark, sf_dir)
    e = e.withColumns({"lat": (F.col("event_id") * 7919 % 1600).cast("double") / 10 - 80, "lon": (F.col("event_id") * 104_729 % 3600).cast("double") / 10 - 180})
    return scenarios.impossible_travel(e).select("event_id", F.round("km", 3).alias("km"))


# --- metrics: an uninformative score over real labels

PAIRS = "(SELECT doc_id, toxic AS y, (doc_id * 7919 % 1000) / 1000.0 AS p FROM labels)"


def pairs(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"), (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("p"))


@query("SELECT doc_id, toxic, lang FROM documents JOIN labels USING (doc_id)")
def label_join(spark, sf_dir):
    """Predictions and labels meet by id; reading labels takes the evaluation role."""
    from riskloom.catalog import Catalog

    catalog = Catalog(spark, "eval_role", {"groundtruth.labels": lambda s: table(s, sf_dir, "labels")})
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(catalog.read("groundtruth.labels"), "doc_id").select("doc_id", "toxic", "lang")


@query("SELECT count(*) AS n, round(avg(toxic), 6) AS positive_rate FROM labels")
def base_rate(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("toxic"), 6).alias("positive_rate"))


@query(f"""
    WITH c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y <> 1) AS tn FROM {PAIRS})
    SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def classification_metrics(spark, sf_dir):
    c = metrics.confusion(pairs(spark, sf_dir), "p", "y", 0.5)
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "fpr", "f1")])


STEPS = f"""(SELECT p, pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM {PAIRS} GROUP BY 1) WINDOW w AS (ORDER BY p DESC))"""


@query(f"SELECT round(sum(cp / (cp + cn) * pos) / sum(pos), 6) AS pr_auc FROM {STEPS}")
def pr_auc(spark, sf_dir):
    return metrics.average_precision(pairs(spark, sf_dir), "p", "y").select(F.round("pr_auc", 6).alias("pr_auc"))


@query(f"SELECT round(sum(neg * (cp - pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM {STEPS}")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(pairs(spark, sf_dir), "p", "y").select(F.round("roc_auc", 6).alias("roc_auc"))


@query(f"SELECT round(min(cn / (SELECT count(*) FROM {PAIRS} WHERE y <> 1)), 6) AS fpr FROM {STEPS} WHERE cp >= 0.8 * (SELECT count(*) FROM {PAIRS} WHERE y = 1)")
def fpr_at_recall(spark, sf_dir):
    return metrics.fpr_at_recall(pairs(spark, sf_dir), "p", "y", 0.8).select(F.round("fpr", 6).alias("fpr"))


@query(f"SELECT round(avg(pow(p - y, 2)), 6) AS brier FROM {PAIRS}")
def brier(spark, sf_dir):
    return metrics.brier(pairs(spark, sf_dir), "p", "y").select(F.round("brier", 6).alias("brier"))


@query(f"SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS positive_rate FROM {PAIRS} GROUP BY 1")
def reliability(spark, sf_dir):
    return metrics.reliability(pairs(spark, sf_dir), "p", "y").select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("positive_rate", 6).alias("positive_rate"))


EARLY = "ts < TIMESTAMP '2024-01-16 00:00:00'"
CUTS = (5.0, 10.0, 20.0, 35.0, 50.0, 70.0, 100.0, 150.0, 200.0)


def _early():
    return F.col("ts") < F.lit("2024-01-16T00:00:00Z").cast("timestamp")


@query(f"""
    WITH b AS (SELECT {' + '.join(f'(value > {c})::INT' for c in CUTS)} AS bin, {EARLY} AS early FROM events),
    s AS (SELECT g.bin, count(*) FILTER (early) AS a, count(*) FILTER (NOT early) AS b FROM range(10) g(bin) LEFT JOIN b USING (bin) GROUP BY 1),
    t AS (SELECT greatest(a / sum(a) OVER (), 1e-6) AS a, greatest(b / sum(b) OVER (), 1e-6) AS b FROM s) SELECT round(sum((b - a) * ln(b / a)), 6) AS psi FROM t""")
def psi(spark, sf_dir):
    """Stability of amounts between the month's halves."""
    return metrics.psi(events(spark, sf_dir), "value", _early(), list(CUTS)).select(F.round("psi", 6).alias("psi"))


@query("""
    WITH e AS (SELECT *, ts < TIMESTAMP '2024-01-16 00:00:00' AS early FROM events),
    r AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM e WHERE early),
    c AS (SELECT DISTINCT value AS cut FROM r JOIN range(1, 10) q(i) ON r.k = ceil(n * q.i / 10.0)),
    b AS (SELECT CASE WHEN early THEN NULL ELSE CAST(ts AS DATE) END AS day, (SELECT count(*) FROM c WHERE cut < value) AS bin FROM e),
    g AS (SELECT i AS bin FROM range(0, (SELECT count(*) FROM c) + 1) x(i)),
    a AS (SELECT bin, greatest((SELECT count(*) FROM b WHERE day IS NULL AND b.bin = g.bin) / (SELECT count(*) FROM b WHERE day IS NULL), 1e-6) AS base FROM g),
    d AS (SELECT day, count(*) AS n FROM b WHERE day IS NOT NULL GROUP BY 1),
    h AS (SELECT day, bin, count(*) AS m FROM b WHERE day IS NOT NULL GROUP BY 1, 2)
    SELECT d.day, any_value(d.n) AS n, round(sum((greatest(coalesce(m, 0) / d.n, 1e-6) - base) * ln(greatest(coalesce(m, 0) / d.n, 1e-6) / base)), 6) AS psi
    FROM d CROSS JOIN a LEFT JOIN h ON h.day = d.day AND h.bin = a.bin GROUP BY 1""")
def psi_daily(spark, sf_dir):
    """Stability of each later day's amounts against tenths of the first half of the month."""
    return metrics.psi_by_day(events(spark, sf_dir), "value", "ts", "2024-01-16T00:00:00Z").select("day", "n", F.round("psi", 6).alias("psi"))


@query(f"""
    WITH s AS (SELECT value, count(*) FILTER ({EARLY}) AS a, count(*) FILTER (NOT {EARLY}) AS b FROM events GROUP BY 1),
    c AS (SELECT sum(a) OVER (ORDER BY value) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY value) / sum(b) OVER () AS fb FROM s) SELECT round(max(abs(fa - fb)), 6) AS ks FROM c""")
def ks(spark, sf_dir):
    return metrics.ks(events(spark, sf_dir), "value", _early()).select(F.round("ks", 6).alias("ks"))


@query("SELECT event_id, round(percent_rank() OVER (ORDER BY value), 6) AS percentile FROM events")
def anomaly_percentile(spark, sf_dir):
    """Rank of each amount among all, without a window over all rows."""
    return ml.percentile_rank(events(spark, sf_dir), "value", "percentile").select("event_id", F.round("percentile", 6).alias("percentile"))


@query("""
    SELECT event_id, list_aggregate(list_transform(list_sort([{'o': -abs(0.02 * value), 'f': 'amount'}, {'o': -abs(0.01 * (event_id % 7)), 'f': 'turn'}, {'o': -abs(-0.03 * (event_id % 11)), 'f': 'odd'}])[1:2], lambda x: x.f), 'string_agg', ',') AS top FROM events""")
def top_contributions(spark, sf_dir):
    """The two features that move a linear score most."""
    e = events(spark, sf_dir).select("event_id", F.col("value").alias("amount"), (F.col("event_id") % 7).alias("turn"), (F.col("event_id") % 11).alias("odd"))
    return e.select("event_id", F.array_join(F.transform(ml.top_contributions({"amount": 0.02, "turn": 0.01, "odd": -0.03}, 2), lambda p: p["feature"]), ",").alias("top"))


def model_rows(spark, sf_dir):
    """Trailing features of each event; a purchase over 100 is what there is to predict."""
    one = F.count(F.lit(1))
    e = timeline.trailing(events(spark, sf_dir), "user_id", "ts", {"n_1h": (3600, one), "n_24h": (86_400, one), "mean_24h": (86_400, F.avg("value"))})
    return e.withColumns({"hour": F.hour("ts").cast("double"), "label": ((F.col("event_type") == "purchase") & (F.col("value") > 100)).cast("int")})


@query()
def isolation_forest(spark, sf_dir):
    """Anomaly scores of all events; random trees have no counterpart in SQL."""
    return ml.isolation_forest(model_rows(spark, sf_dir).select("event_id", "value", "n_1h", "n_24h", "mean_24h"), ["value", "n_1h", "n_24h", "mean_24h"]).select("event_id", F.round("anomaly", 6).alias("anomaly"))


@query("""
    SELECT event_id, round((2 * percent_rank() OVER (ORDER BY value) + 1 * percent_rank() OVER (ORDER BY event_id % 1009)) / 3, 6) AS score FROM events""")
def ensemble_scores(spark, sf_dir):
    """Two rankings combined; weights two to one."""
    e = events(spark, sf_dir).select("event_id", "value", (F.col("event_id") % 1009).alias("other"))
    ranked = ml.percentile_rank(ml.percentile_rank(e, "value", "a"), "other", "b")
    return ranked.select("event_id", F.round(ml.ensemble(ranked, {"a": 2.0, "b": 1.0}), 6).alias("score"))


@query()
def calibrated_scores(spark, sf_dir):
    """Boosted trees on the first weeks, calibrated on the next, scored on the last; not expressible in SQL."""
    rows = model_rows(spark, sf_dir).select("event_id", "ts", "value", "n_1h", "n_24h", "mean_24h", "hour", "label")
    train, rest = ml.temporal_split(rows, "ts", "2024-01-15T00:00:00Z")
    validation, test = ml.temporal_split(rest, "ts", "2024-01-22T00:00:00Z")
    model = ml.Calibrated(["value", "n_1h", "n_24h", "mean_24h", "hour"], "label", rounds=5, depth=3).fit(train, validation)
    return model.score(test).select("event_id", ntz("ts"), F.round("score", 6).alias("score"))
