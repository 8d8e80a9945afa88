"""WARC archives: written by Spark's text writer, read back by boundary-chain verification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, small_join

MAGIC = "WARC/1.1\r\n"  # no character repeats the first, so a splitting reader can't misplace it
BLANK = "\r\n\r\n"
URN = "urn:riskloom:page:"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def judged(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html", least: int = 1000) -> DataFrame:
    """``pages`` (id, url, payload) with the record type: of equal payloads of at least ``least`` bytes the largest
    id is the response and the others revisit it. Equal means the same SHA-256 and length."""
    rows = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "key": F.sha2("payload", 256)})
    copies = rows.filter(F.col("size") >= least).groupBy("key", "size").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = materialize(copies, "warc-copies")
    rows = small_join(rows, copies, ["key", "size"], "left")
    revisit = F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    return rows.select("id", "url", "payload", "size", F.when(revisit, F.col("keep")).alias("refers_to"))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 100_000, **options) -> None:
    """One record a row, uncompressed. The text writer ends each row with the blank lines that end a record, so
    any file system that Spark writes to will do, and its commit protocol covers retried tasks. Payload bytes go
    out as they are. A null payload counts as empty, a null url as an empty one, a null id leaves the urn open;
    line breaks in urls are percent-encoded. Rows that repeat id and payload are each a response."""
    rows = judged(pages, **options)
    revisit = F.col("refers_to").isNotNull()
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", urn("id")),
        _line("WARC-Target-URI", uri),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
        _line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", urn("refers_to")))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string")),
        F.lit(BLANK),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))  # the cast keeps bytes as they are
    rows.select(F.concat(head, body).alias("value")).write.option("lineSep", BLANK).option("maxRecordsPerFile", records_per_file).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between two magics, with their place; a file may be read in many splits."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def _header(name: str) -> Column:
    """A header's value in ``head``; names in any case."""
    return F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, pos, next, size): each place after a magic as a candidate record and the offset at which
    its successor must start, by the length that its header states. Offsets are prefix sums of chunk sizes, by
    block and then within a block."""
    rows = _chunks(spark, path).withColumns({"size": F.octet_length("value").cast("long"), "head": F.substring_index("value", BLANK, 1)})
    stated = F.try_to_number(_header("Content-Length"), F.lit("999999999999")).cast("long")
    rows = rows.withColumn("whole", F.octet_length("head") + len(BLANK) + stated + len(BLANK))
    rows = materialize(rows.select("file", "block", "seq", "size", "whole"), "warc-chunks")
    blocks = rows.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("span"))
    before = F.coalesce(F.sum("span").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = materialize(blocks.select("file", "block", before.alias("start")), "warc-blocks")
    rows = small_join(rows, blocks, ["file", "block"])
    inside = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("pos", F.col("start") + inside - len(MAGIC)).filter("pos >= 0")  # what lies before the first magic is no record
    return rows.select("file", "block", "seq", "pos", (F.col("pos") + len(MAGIC) + F.col("whole")).alias("next"), "size", "whole")


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a block leaves the block."""
    rows = rows.sort_values("pos")
    exits: dict[int, float] = {}
    for pos, following in zip(rows["pos"].to_numpy()[::-1], rows["next"].to_numpy()[::-1], strict=True):
        exits[pos] = exits.get(following, following)
    return pd.DataFrame({"file": rows["file"], "pos": rows["pos"], "exit": pd.array([None if pd.isna(e) else int(e) for e in map(exits.get, rows["pos"])], dtype="Int64")})


def _marked(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that the chain from its entries visits."""
    rows = rows.sort_values("pos")
    live, keep = set(), []
    for pos, following, entry in zip(rows["pos"], rows["next"], rows["entry"], strict=True):
        keep.append(bool(entry) or pos in live)
        if keep[-1]:
            live.add(following)
    return rows[keep][["file", "seq", "pos", "size", "whole"]]


def _reachable(found: DataFrame) -> DataFrame:
    """Candidates on the chain that begins at the file's first byte.

    Chains are first followed within each block, so that pointer jumping only has to cross blocks: in each round
    the reached offsets jump and the jumps are squared, which takes log2(blocks of a file) rounds."""
    jumps = found.groupBy("file", "block").applyInPandas(_exits, "file string, pos long, exit long").filter("exit is not null")
    jumps = materialize(jumps, "warc-jumps")
    reached = materialize(jumps.filter("pos = 0").select("file", "pos").distinct(), "warc-reached")
    count = reached.count()
    places = found.select("file", "pos")
    while True:
        onward = reached.join(jumps, ["file", "pos"]).select("file", F.col("exit").alias("pos")).join(places, ["file", "pos"], "left_semi")
        more = materialize(reached.unionByName(onward).distinct(), "warc-reached")
        now = more.count()
        if now == count:
            break
        reached, count = more, now
        twice = jumps.select("file", F.col("pos").alias("from"), F.col("exit").alias("pos")).join(jumps, ["file", "pos"]).select("file", F.col("from").alias("pos"), "exit")
        jumps = materialize(twice, "warc-jumps")
    entries = reached.withColumn("entry", F.lit(True))
    flagged = found.join(entries, ["file", "pos"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return flagged.groupBy("file", "block").applyInPandas(_marked, "file string, seq long, pos long, size long, whole long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row (file, type, id, uri, payload_digest, refers_to, payload_length, payload) per record.

    Every magic is a candidate; only the chain of stated lengths from the file's first byte makes records, so a
    magic inside a payload is rejected and its bytes stay in the payload. A file that is cut or damaged gives the
    records before the damage; an empty one gives none. The files are read twice, so they must not change meanwhile."""
    found = materialize(_candidates(spark, path), "warc-candidates")
    good = materialize(_reachable(found), "warc-records")
    chunks = _chunks(spark, path)
    if found.count() == good.count() and good.filter("size < whole").isEmpty():
        # every chunk but the empty one before a file's first magic is a whole record: nothing to join
        return _records(chunks.filter(F.octet_length("value") > 0).select("file", "value"))
    whole = good.filter("size >= whole").select("file", "seq", "pos")
    rows = chunks.join(whole, ["file", "seq"]).select("file", "value")
    # records that hold a magic: their chunks are joined again, each owned by the record that starts last before it
    order = Window.partitionBy("file").orderBy("pos")
    starts = found.select("file", "seq", "pos").join(good.select("file", "seq", F.col("pos").alias("start")), ["file", "seq"], "left")
    last = F.last("start", ignorenulls=True).over(order)
    owned = starts.select("file", "seq", "pos", last.alias("owner")).filter("owner is not null")
    torn = good.filter("size < whole").select("file", F.col("pos").alias("owner"), "whole")
    parts = chunks.join(owned.join(torn, ["file", "owner"]), ["file", "seq"])
    glued = parts.groupBy("file", "owner", "whole").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("p"))
    glued = glued.select("file", F.array_join(F.col("p.value"), MAGIC).alias("value"), "whole").filter(F.octet_length("value") >= F.col("whole") - len(BLANK))
    return _records(rows.unionByName(glued.drop("whole")))


def _records(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("head", F.substring_index("value", BLANK, 1))
    length = F.try_to_number(_header("Content-Length"), F.lit("999999999999")).cast("int")
    urn = lambda name: F.nullif(F.regexp_extract(_header(name), rf"^<{URN}([^>]*)>$", 1), F.lit(""))
    return rows.select(
        "file", _header("WARC-Type").alias("type"), urn("WARC-Record-ID").alias("id"), _header("WARC-Target-URI").alias("uri"),
        F.regexp_extract(_header("WARC-Payload-Digest"), r"^sha1:([0-9a-f]{40})$", 1).alias("payload_digest"), urn("WARC-Refers-To").alias("refers_to"),
        F.try_to_number(_header("X-Payload-Length"), F.lit("999999999999")).cast("long").alias("payload_length"),
        F.substring(F.col("value").cast("binary"), F.octet_length("head") + len(BLANK) + 1, length).alias("payload"),
    )
