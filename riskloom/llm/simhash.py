"""Near duplicates by SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskloom.operators.graph import components

from .common import discard, in_arrow, materialize, row_hash, spread, text_or_empty

SEED = 42
BLOCK = 1 << 15


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    out = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), BLOCK):
        out += np.unpackbits(hashes[start : start + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return out


def majority(ones: np.ndarray, total: int) -> int:
    """The bits that more than half of ``total`` hashes have."""
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprint(data: bytes, width: int = 3) -> int:
    """64-bit SimHash over the word shingles of UTF-8 ``data``, A-Z lower-cased: a bit is set when more than
    half of the shingles' XXH64 values have it. Fewer words than ``width`` make one shingle; none make zero."""
    words = data.lower().split()  # bytes.split() parts at exactly space and \x09-\x0D
    if not words:
        return 0
    total = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, BLOCK):
        stop = min(total, start + BLOCK)
        rows = zip(*(words[start + k : stop + k] for k in range(width))) if len(words) >= width else [words]
        ones += votes(np.array([digest(b" ".join(r), SEED) for r in rows], dtype=np.uint64))
    return majority(ones, total)


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            values = np.array([fingerprint(t.as_buffer().to_pybytes(), width) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64), pa.int64())], names=["id", "h", "fp"])

    return run


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """One row (id, h, fp) per row of ``docs``; only the two columns leave the scan."""
    rows = docs.select(F.col(id_column).alias("id"), row_hash(text_column).alias("h"), text_or_empty(text_column).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.transform(in_arrow, _fingerprints(width), f"id {kind}, h long, fp long")


def _variants(fp: Column) -> Column:
    """The 64 one-wildcard variants of the two 32-bit segments, each as (wildcard, segment without that bit)."""
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    made = []
    for k in range(64):
        part = (low, high)[k // 32].bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << k % 32)))
        made.append(F.lit(k << 32).bitwiseOR(part))
    return F.array(*made)


def links(nodes: DataFrame, bucket_limit: int = 512) -> DataFrame:
    """Links (a, b) that join the same fingerprints as the graph of all pairs at 2 or fewer differing bits.
    ``nodes`` (fp): distinct fingerprints.

    Two bits over two segments leave one segment with at most one differing bit, so each linked pair shares a
    one-wildcard variant. Buckets of up to ``bucket_limit`` fingerprints are joined on the variant and verified
    within the join, each pair under the first variant it shares only. The fingerprints of larger buckets are
    linked through their 2,016 two-wildcard keys over all 64 bits instead: such a key holds at most four
    distinct fingerprints, all within two bits, so linking each to the smallest loses no connection."""
    keyed = spread(nodes).select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    # counted with map-side combining, as one bucket may hold a large share of the fingerprints; always joined by sort
    # and merge, which splits such a bucket and costs alike at every size
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    sized = materialize(keyed.join(sizes.hint("merge"), "key"), "variants")
    discard(sizes)
    a = sized.filter(F.col("n") <= bucket_limit).select("key", F.col("fp").alias("a"))
    b = a.select(F.col("key").alias("key_b"), F.col("a").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    low = differ.bitwiseAND(F.lit(0xFFFFFFFF))
    in_low = F.bit_count(low)
    first = F.when(in_low == 0, F.lit(0)).when(in_low == 1, F.bit_count(low - 1)).otherwise(F.lit(32))
    on = (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= 2) & (F.shiftright("key", 32) == first)
    found = a.join(b, on).select("a", "b")

    hot = sized.filter(F.col("n") > bucket_limit).select("fp").distinct()
    bits = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)])
    masked = hot.select("fp", F.posexplode(bits).alias("i", "x")).select("fp", "i", "x", F.posexplode(bits).alias("j", "y")).filter("i < j")
    masked = masked.select("fp", "i", "j", F.col("fp").bitwiseAND(F.bitwise_not(F.col("x").bitwiseOR(F.col("y")))).alias("rest"))
    star = masked.withColumn("b", F.min("fp").over(Window.partitionBy("i", "j", "rest"))).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return found.unionByName(star)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, bucket_limit: int = 512) -> DataFrame:
    """One row (id, h, fp, component) per row of ``docs``; component is the smallest id reachable over
    links between fingerprints at 2 or fewer differing bits.

    A null text counts as empty and an empty text has fingerprint zero, linked like any other. Null ids take part,
    but are a component's id only if it has no other. Repeated rows share a fingerprint; texts are read whole, in
    blocks. An empty table gives an empty result; further columns are not read, whatever their names."""
    members = materialize(fingerprints(docs, id_column, text_column, width), "fingerprints")
    nodes = materialize(members.groupBy("fp").agg(F.min("id").alias("first_id")), "nodes")
    roots = components(links(nodes.select("fp"), bucket_limit), "a", "b")
    placed = nodes.join(roots.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialize(placed, "placed")
    discard(nodes, roots)
    named = placed.groupBy("root").agg(F.min("first_id").alias("component"))
    per_node = materialize(placed.join(named, "root").select("fp", "component"), "components")
    discard(placed)
    return members.join(per_node, "fp").select("id", "h", "fp", "component")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
