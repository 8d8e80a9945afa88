import hashlib
import random

import pytest

from riskloom.llm import warc
from riskloom.llm.common import shared_path


def corpus():
    rng = random.Random(2)
    big = "<html>" + "x" * 1500
    made = []
    for i in range(120):
        body = {
            0: None, 1: "", 2: big, 3: "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nfoo", 4: "tail\r\n\r\nWARC/1.1\r\n",
            5: "z" * rng.randrange(5000) + "\r\n\r\nWARC/1.1\r\nContent-Length: 99\r\n\r\n" + "q" * 1200,
        }.get(i % 10, f"p{i}\r\n\r\n" + "é\r\n" * rng.randrange(2000))
        made.append((i, f"http://a.b/{i}\n" if i % 10 else None, body))
    return [*made, (None, "http://x", big), (7, "http://again", "short"), (7, "http://again", "short")]


def want(rows):
    out = []
    for i, _, body in rows:
        data = (body or "").encode()
        known = [j for j, _, b in rows if (b or "").encode() == data and j is not None]
        keep = max(known, default=None)
        revisit = len(data) >= 1000 and keep is not None and i != keep
        out.append((str(i) if i is not None else "", "revisit" if revisit else "response", hashlib.sha1(data).hexdigest(), str(keep) if revisit else "", len(data), b"" if revisit else data))
    return sorted(out)


@pytest.mark.parametrize(("split", "parts"), [("128m", 2), ("5k", 3), ("60k", 1)])
def test_round_trip(spark, split, parts):
    rows = corpus()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = shared_path(spark, "warc")
        warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "'k' as key").repartition(parts), path)
        got = sorted((r.id or "", r.type, r.payload_digest, r.refers_to or "", r.payload_length, bytes(r.payload)) for r in warc.read(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want(rows)


def test_empty_table(spark):
    path = shared_path(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_damage_ends_the_chain(spark, tmp_path):
    record = lambda n, size: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{warc.URN}{n}>\r\ncontent-length: {size}\r\n\r\n{'b' * 5}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record(1, 5) + record(2, 5) + record(3, 4) + record(4, 5)).encode())
    assert sorted(r.id for r in warc.read(spark, str(tmp_path)).collect()) == ["1", "2", "3"]
