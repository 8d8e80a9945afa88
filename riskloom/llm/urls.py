"""URL filters: stated rules first, then association rules mined from labelled URLs."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialize, small_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host labels, path segments and query keys, digits folded to ``#``."""
    folded = lambda c: F.regexp_replace(F.translate(c, UPPER, LOWER), "[0-9]+", "#")
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(tag), folded(p)))
    query = F.coalesce(F.regexp_extract_all(url, F.lit("[?&]([^=&#]+)"), F.lit(1)), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(tagged("h:", F.split(host(url), "[.]")), tagged("p:", F.split(path(url), "[/._]")), tagged("q:", query)))


def stated(rules: list[tuple[str, str, str]], hosts: Column, paths: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null. ``rules``: (verdict, host, path); a rule fits its host
    and all subdomains if the path starts with the rule's. Rules of one length keep their order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((hosts == h) | F.endswith(hosts, F.lit("." + h))) & F.startswith(paths, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _filed(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``rules`` (rule, ...) with ``token``: the rule's rarest, under which the inverted index files it."""
    rare = rules.select("rule", F.explode("rule").alias("token")).join(counts, "token", "left")
    rare = rare.groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r")).select("rule", F.col("r.token").alias("token"))
    return rules.join(rare, "rule")


def _holding(rows: DataFrame, filed: DataFrame) -> DataFrame:
    """Rows of ``rows`` (items, ...) beside each rule all of whose tokens are among ``items``: each token of a row looks
    up the rules filed under it, and only those are compared."""
    looked = rows.withColumn("token", F.explode("items")).join(filed, "token")
    return looked.filter(F.size(F.array_except("rule", "items")) == 0).drop("token")


def lower_bound(hits: Column, n: Column, z: float) -> Column:
    """The lower end of Wilson's interval for a share of ``hits`` in ``n``."""
    share, z2 = hits / n, z * z
    return (share + z2 / (2 * n) - z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def no_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "rule array<string>, token string, blocked long, seen long")


def mine(labelled: DataFrame, support: float = 0.002, rows: int = 20, confidence: float = 0.6, lift: float = 1.5, z: float = 3.0, sample: int = 200_000) -> DataFrame:
    """Token combinations that mean block: a table (rule, token, blocked, seen) of token lists, the token that each is
    filed under, and the numbers of different blocked URLs and of all different URLs that hold it.

    FP-growth over the blocked URLs of ``labelled`` (url, block) gives the combinations that ``support`` of all URLs hold,
    ``rows`` of them at least. Of these a rule is kept if the share of blocked URLs among all that hold it reaches
    ``confidence``, the lower end of its interval at ``z`` deviations reaches ``lift`` times the share among all URLs (or
    halfway from that to one, if it is less), and no part of it is a rule. The floor of rows and the interval keep out
    combinations that chance makes, at every size of the table.

    Fitted on at most ``sample`` different URLs, the first by a hash of the URL; a URL given with both labels counts as
    blocked, null URLs and labels not at all. Tokens that occur in the same URLs stand for one another, and the first of
    them alone is mined, else long paths would double the combinations with each token. Combinations, counts and rules
    stay tables; nothing but three counts reaches the driver."""
    spark = labelled.sparkSession
    urls = labelled.filter(F.col("url").isNotNull() & F.col("block").isNotNull()).groupBy("url").agg(F.max("block").alias("block"))
    urls = urls.orderBy(F.xxhash64("url"), "url").limit(sample).select(tokens(F.col("url")).alias("items"), "block", F.xxhash64("url").alias("at"))
    urls = materialize(urls.filter(F.size("items") > 0), "url-sample")
    n, n_bad = urls.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("block").cast("long")), F.lit(0))).first()
    least = max(rows, math.ceil(support * n))
    if n_bad < least:
        return no_rules(spark)
    where = urls.select(F.explode("items").alias("token"), "at").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("at").alias("x"), F.sum(F.pmod("at", F.lit(1 << 40))).alias("s"))
    alike = where.groupBy("n", "x", "s").agg(F.min("token").alias("token"))
    counts = materialize(alike.filter(F.col("n") >= least).select("token", "n"), "url-tokens")
    known = urls.select("at", "block", F.explode("items").alias("token")).join(counts, "token").groupBy("at", "block").agg(F.collect_set("token").alias("items"))
    known = materialize(known, "url-items")
    bad = known.filter("block").select("items")
    if bad.isEmpty():
        return no_rules(spark)
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, least / bad.count())).fit(bad).freqItemsets
    sets = materialize(found.select(F.array_sort("items").alias("rule"), F.col("freq").alias("blocked")), "url-patterns")
    filed = materialize(_filed(sets, counts), "url-filed")
    seen = _holding(known.groupBy("items").agg(F.count(F.lit(1)).alias("n")), filed.select("rule", "token")).groupBy("rule").agg(F.sum("n").alias("seen"))
    base = n_bad / n
    good = filed.join(seen, "rule").filter(F.col("blocked") / F.col("seen") >= confidence).filter(lower_bound(F.col("blocked"), F.col("seen"), z) >= min(lift * base, (1 + base) / 2))
    good = materialize(good.select("rule", "token", "blocked", "seen"), "url-good")
    parts = good.select(F.col("rule").alias("part"), "token")
    longer = good.select(F.col("rule").alias("items")).withColumn("token", F.explode("items")).join(parts, "token")
    longer = longer.filter((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0)).select(F.col("items").alias("rule")).distinct()
    rules = materialize(good.join(longer, "rule", "left_anti"), "url-rules")
    discard(urls, counts, known, sets, filed, good)
    return rules


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], mined: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row (id, host, path, rule, verdict) per row of ``pages``. Stated rules decide in one narrow pass; the different
    URLs that none of them fits meet the ``mined`` ones (a table from mine()) through the inverted index.

    A null url, or one without ``://``, has empty host and path, no stated rule, and no tokens of either; a url that
    no rule of either kind fits is allowed. Repeated rows are judged alike, urls are read whole, an empty table gives an
    empty result, and no other columns are read, whatever their names."""
    named = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url")).select("id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = stated(rules, F.col("host"), F.col("path"))
    named = named.select("id", "url", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    if mined is None or mined.isEmpty():
        return named.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    open_ = named.filter(F.col("verdict").isNull() & F.col("url").isNotNull()).select("url").distinct().withColumn("items", tokens(F.col("url")))
    filed = mined.select("rule", "token")
    hit = materialize(_holding(open_, filed if mined.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS else F.broadcast(filed)).select("url").distinct().withColumn("hit", F.lit(True)), "url-hits")
    out = small_join(named, hit, ["url"], "left")
    return out.select("id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("hit"), F.lit("block")), F.lit("allow")).alias("verdict"))
