"""Bounded graph queries over an edge table (src, dst, ...). Frontiers and visited sets stay DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.lineage import cut, discard


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def k_hop(edges: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """(node, hops): the nodes within ``k`` steps of the nodes of ``start`` and their least distance. Each step joins the
    frontier with the edges and leaves out what was visited, so walks that return are not followed."""
    both = cut(undirected(edges))
    visited = frontier = cut(start.select("node").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, k + 1):
        onward = frontier.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(onward.join(visited, "node", "left_anti").withColumn("hops", F.lit(hop)))
        visited = visited.unionByName(frontier)
    return visited


def shortest_path(edges: DataFrame, a, b, most: int = 4) -> DataFrame:
    """(path, length): the shortest path from ``a`` to ``b`` within ``most`` steps; of several the first in the order of
    their nodes. Each node keeps its one best path, so the table never outgrows the nodes."""
    both = cut(undirected(edges))
    spark = edges.sparkSession
    kind = both.schema["src"].dataType
    frontier = spark.range(1).select(F.lit(a).cast(kind).alias("node"), F.array(F.lit(a).cast(kind)).alias("path"))
    visited = frontier
    for _ in range(most):
        onward = frontier.join(both, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        onward = onward.select("node", F.concat("path", F.array("node")).alias("path"))
        frontier = cut(onward.join(visited, "node", "left_anti"))
        visited = visited.unionByName(frontier)
        if not frontier.filter(F.col("node") == F.lit(b)).isEmpty():
            break
    return visited.filter(F.col("node") == F.lit(b)).select("path", (F.size("path") - 1).alias("length"))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for the nodes of ``edges`` that have an edge to another node; component is the smallest node
    reachable. Self-loops, repeats and both directions are allowed.

    By contraction: every node joins the node of least rank among itself and its neighbours, where ranks are hashed
    anew each round, and what joined the same node becomes one. Each round leaves about half the nodes of a path and
    fewer of any denser graph, whatever the order of their ids, and at least the node of highest rank of every
    component goes, so the loop ends and the work of all rounds together is a small multiple of the first. Labels of
    the rounds are then followed back. Steps are joins on the node and aggregates with map-side combining; nothing is
    collected, and tables that are superseded are deleted."""
    links = cut(edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).filter("a <> b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), F.col(c)).alias("r"), F.col(c).alias("n"))
        # the two ends of a link tell each other their ranks
        told = links.select(F.col("a").alias("node"), rank("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), rank("a").alias("near")))
        nearest = told.groupBy("node").agg(F.min("near").alias("near"))
        labels = cut(nearest.select("node", F.least(rank("node"), "near")["n"].alias("label")), "labels")
        rounds.append(labels)
        ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        fewer = cut(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "links")
        discard(links)
        links = fewer
    discard(links)
    if not rounds:
        return edges.select(F.col(src).alias("node"), F.col(src).alias("component")).limit(0)
    root = rounds.pop()
    while rounds:
        labels = rounds.pop()
        onward = root.select(F.col("node").alias("label"), F.col("label").alias("root"))
        further = cut(labels.join(onward, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "roots")
        discard(root, labels)
        root = further
    least_of = root.groupBy("label").agg(F.min("node").alias("component"))
    out = cut(root.join(least_of, "label").select("node", "component"), "components")
    discard(root)
    return out


def shared(links: DataFrame, entity: str, actor: str, least: int) -> DataFrame:
    """(actor, entity, sharers): uses of entities that at least ``least`` actors share. A row a use, not a row a pair."""
    uses = links.select(entity, actor).distinct()
    counts = uses.groupBy(entity).agg(F.count(F.lit(1)).alias("sharers")).filter(F.col("sharers") >= least)
    return uses.join(counts, entity)


def density(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(nodes, links, density) of the part of the graph that ``members`` (node) spans: 2E / (V (V - 1))."""
    inner = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    for side in "ab":
        inner = inner.join(members.select(F.col("node").alias(side)), side, "left_semi")
    v, e = members.agg(F.count(F.lit(1)).alias("nodes")), inner.agg(F.count(F.lit(1)).alias("links"))
    both = v.crossJoin(F.broadcast(e))  # one row each
    return both.withColumn("density", F.try_divide(2 * F.col("links"), F.col("nodes") * (F.col("nodes") - 1)))


def capped(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows in a total order and, on each, whether more were left out."""
    first = df.orderBy(*order).limit(limit + 1)
    cut_ = first.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return first.orderBy(*order).limit(limit).crossJoin(F.broadcast(cut_))  # one row


def page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next ``limit`` rows (200 at most) after a cursor, by key; no offset is counted."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit)


def collusion(sales: DataFrame, merchant: str, account: str, flagged: str, least: int, share: float) -> DataFrame:
    """Merchants of which at least ``share`` of ``least`` or more accounts have a flagged sale."""
    per = sales.groupBy(merchant, account).agg(F.max(F.col(flagged).cast("int")).alias("hit"))
    out = per.groupBy(merchant).agg(F.count(F.lit(1)).alias("accounts"), F.sum("hit").alias("flagged_accounts"))
    return out.withColumn("share", F.col("flagged_accounts") / F.col("accounts")).filter((F.col("accounts") >= least) & (F.col("share") >= share))

