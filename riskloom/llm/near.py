"""Near copies by the Jaccard similarity of word shingles: links by SimHash first, the rest by exact candidates, every
pair verified.

Two texts at a similarity of 0.8 differ in about ten bits of 64, so the links of simhash.py, at two bits, find mostly
copies that are far closer. They are taken first, as they are cheap and join most of a group; prefixes of the shingle
sets then give every other pair that can reach the similarity."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.graph import components

from .common import discard, in_arrow, materialize, row_hash, small_join, text_or_empty
from .simhash import links as fingerprint_links
from .simhash import majority, votes

WIDTH, SIMILARITY = 5, 0.8
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SAMPLE, COMMON, COMMON_LIMIT = 16, 4, 200_000
YIELD = 20  # comparisons with pivots per link that are worth another round
BITS, WORDS = 256, 4
MAPS = [f"m{k}" for k in range(WORDS)]


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of UTF-8 ``data``, A-Z lower-cased. Fewer words than ``width`` make
    one shingle; none make none."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def parity(hashes: np.ndarray) -> list[int]:
    """A map of BITS bits: bit i is whether an odd number of the hashes fall on i. Two sets differ in at least as many
    members as their maps differ in bits."""
    odd = np.bincount((hashes & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _sets(width: int):
    """(key, text) to (key, shingles)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(t.as_buffer().to_pybytes(), width) for t in texts])], names=["node", "shingles"])

    return run


def prefix_length(size: int, similarity: float) -> int:
    """Two sets at ``similarity`` share a member among the first so many of each, in any one order of all members."""
    return size - math.ceil(round(similarity * size, 6)) + 1 if size else 0


def _members(width: int, similarity: float, common):
    """Rows with node (hash of the set), its size, fingerprint, parity map and prefix; ``common`` (broadcast hashes and
    counts) go last in the order."""

    def run(batches):
        hashes, counts = common.value
        for batch in batches:
            nodes, sizes, prints, maps, prefixes = [], [], [], [], []
            for t in batch.column(2).cast(pa.binary()):
                found = shingles(t.as_buffer().to_pybytes(), width)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                prints.append(majority(votes(found), len(found)))
                maps.append(parity(found))
                if len(hashes) and len(found):
                    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                    rank = np.where(hashes[at] == found, counts[at], 0)
                    found = found[np.argsort(rank, kind="stable")] if rank.any() else found
                prefixes.append(found[: prefix_length(len(found), similarity)])
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64), pa.int64())
            bits = [pa.array([m[k] for m in maps], pa.int64()) for k in range(WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(nodes), pa.array(sizes, pa.int32()), signed(prints), *bits, _lists(prefixes)], names=["id", "h", "node", "size", "fp", *MAPS, "prefix"])

    return run


def _common(docs: DataFrame, text_column: str, width: int):
    """The shingles met most often in a sample of texts, with counts. They only order the sets, which keeps buckets
    small; what is found doesn't depend on them."""
    rows = docs.select(row_hash(text_column).alias("node"), text_or_empty(text_column).alias("t")).filter(F.pmod("node", F.lit(SAMPLE)) == 0)
    met = rows.transform(in_arrow, _sets(width), "node long, shingles array<long>").select(F.explode("shingles").alias("s"))
    top = met.groupBy("s").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(COMMON_LIMIT).toPandas()
    hashes, counts = top["s"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return docs.sparkSession.sparkContext.broadcast((hashes[order], counts[order]))


def _reaches(shared: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of ``n`` and ``m`` members that share so many are that similar; rounding lets a hair too many pass."""
    return shared * (1 + similarity) + 1e-6 >= (n + m) * similarity


def _possible(similarity: float) -> Column:
    """False only if sizes and places of a shared shingle rule the similarity out."""
    n, m, i, j = F.col("size_a"), F.col("size_b"), F.col("place_a"), F.col("place_b")
    return _reaches(F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1), n, m, similarity)


def _maps_allow(similarity: float) -> Column:
    """False only if the parity maps rule the similarity out."""
    n, m = F.col("size_a"), F.col("size_b")
    differ = F.lit(0)
    for c in MAPS:
        differ = differ + F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    return _reaches((n + m - differ) / 2, n, m, similarity)


def _counted(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) from a row per prefix shingle that they share, without those that share too few. What two sets
    share beyond their prefixes lies behind the prefix of one of them."""
    pairs = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("size_a").alias("n"), F.first("size_b").alias("m"))
    behind = F.ceil(F.round(F.greatest("n", "m") * F.lit(similarity), 6)) - 1
    return pairs.filter(_reaches(F.col("c") + behind, F.col("n"), F.col("m"), similarity)).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of ``pairs`` (a, b), those at ``similarity`` or more; the sets come from ``texts`` (h, t) again, as only some are
    needed and all would take more room than the texts."""
    pairs = materialize(pairs.filter("a <> b"), "near-pairs")
    if pairs.isEmpty():
        return pairs
    ends = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "near-ends")
    wanted = materialize(small_join(nodes.select("node", "h"), ends, ["node"]), "near-wanted")
    sets = small_join(texts, wanted, ["h"]).select("node", "t").transform(in_arrow, _sets(width), "node long, shingles array<long>")
    sets = materialize(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "near-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("shared"))
    links = materialize(both.filter(F.col("shared") + 1e-9 >= (F.col("n") + F.col("m") - F.col("shared")) * similarity).select("a", "b"), "near-links")
    discard(pairs, ends, wanted, sets)
    return links


def _labelled(shared: DataFrame, links: DataFrame) -> DataFrame:
    """``shared`` with the component of each node as label, without keys that hold one component only."""
    roots = components(links, "a", "b")
    out = small_join(shared.drop("label"), roots.withColumnRenamed("component", "label"), ["node"], "left").withColumn("label", F.coalesce("label", "node"))
    mixed = out.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    kept = materialize(out.join(mixed, "key"), "near-shared")
    discard(shared, roots)
    return kept


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of sets whose fingerprints are linked, and of each set with the first of its fingerprint."""
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    near = fingerprint_links(firsts.select("fp"))
    a, b = firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), firsts.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    far = near.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = nodes.select("node", "fp").join(firsts, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return far.unionByName(same)


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row (id, h, root) per row of ``docs``; rows share a root if links between sets of ``width``-word shingles at
    Jaccard ``similarity`` or more connect them.

    SimHash fingerprints of the sets are linked as in simhash.links, and what they join is verified. For all other
    pairs: a set's prefix is its first shingles in one order of all, as many as leave less than ``similarity`` of the
    set; two linked sets share a shingle of their prefixes, so no link is missed. Rows that share a prefix shingle are
    compared with one pivot of that bucket, another one each time, for as long as one comparison in YIELD finds a link;
    then every pair of a bucket that is not yet connected and that sizes, places and parity maps allow is compared.
    Pairs that are connected already need no comparison, which keeps large groups of near copies linear.

    A null text counts as empty; texts without words have an empty set and are one another's copies. Texts are read
    whole; repeated rows share a root; an empty table gives an empty result; no other columns are read, whatever their
    names."""
    rows = docs.select(F.col(id_column).alias("id"), row_hash(text_column).alias("h"), text_or_empty(text_column).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    texts = rows.select("h", "t")
    made = rows.transform(in_arrow, _members(width, similarity, _common(docs, text_column, width)), f"id {kind}, h long, node long, size int, fp long, {', '.join(f'{m} long' for m in MAPS)}, prefix array<long>")
    found = materialize(made, "near-found")
    members = materialize(found.select("id", "h", "node"), "near-members")
    nodes = materialize(found.groupBy("node").agg(F.min("h").alias("h"), *[F.first(c).alias(c) for c in ("size", "fp", *MAPS, "prefix")]), "near-nodes")
    discard(found)

    keyed = nodes.select("node", "size", F.posexplode("prefix").alias("place", "key"))
    # counted with map-side combining, as one shingle may stand in very many sets
    keys = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "near-keys")
    shared = materialize(keyed.join(keys, "key").withColumn("label", F.col("node")), "near-shared")
    discard(keys)

    links = _verified(_fingerprint_pairs(nodes), nodes, texts, width, similarity)
    shared = _labelled(shared, links)
    for k in itertools.count():
        row = F.struct(F.xxhash64("node", F.lit(k)).alias("order"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"), F.col("label").alias("label_b"))
        pivots = shared.groupBy("key").agg(F.min(row).alias("pivot"))
        pairs = shared.join(pivots, "key").select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"), "label", "pivot.*").filter("label <> label_b")
        pairs = materialize(_counted(pairs.filter(_possible(similarity)), similarity), "near-stars")
        new = _verified(pairs, nodes, texts, width, similarity)
        links, compared, found = links.unionByName(new), pairs.count(), new.count()
        discard(pairs)
        shared = _labelled(shared, links)
        if found * YIELD < compared or not found:
            break

    # a pair of two components has a row outside the component that most rows of the key have
    main = shared.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    shared = materialize(shared.join(main, "key").join(nodes.select("node", *MAPS), "node"), "near-left")
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "place", "label", *MAPS)]
    pairs = shared.filter("label <> main").select("key", "main", *side("a")).join(shared.select("key", *side("b")), "key")
    pairs = pairs.filter("label_a <> label_b").filter((F.col("label_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))).filter(_possible(similarity) & _maps_allow(similarity))
    low = F.col("node_a") < F.col("node_b")
    pairs = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), F.when(low, F.col("size_a")).otherwise(F.col("size_b")).alias("size_a"), F.when(low, F.col("size_b")).otherwise(F.col("size_a")).alias("size_b"))
    links = links.unionByName(_verified(_counted(pairs, similarity), nodes, texts, width, similarity))
    discard(shared)
    roots = components(links, "a", "b")
    discard(nodes)
    return small_join(members, roots, ["node"], "left").select("id", "h", F.coalesce("component", "node").alias("root"))
