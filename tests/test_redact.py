import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions import redact

M = redact.REDACTED
CASES = [
    ("mail a.b+c@ex-ample.co.uk now", f"mail {M} now"),
    ("from 10.0.0.255 and 999.1.2.3", f"from {M} and {M}"),
    ("v6 2001:0db8:85a3:0000:0000:8a2e:0370:7334 end", f"v6 {M} end"),
    ("iban DE89370400440532013000 ok", f"iban {M} ok"),
    ("acct_123456 and ACCT-9876543", f"{M} and {M}"),
    ("card 4111 1111 1111 1111.", f"card {M}(card:…1111)."),
    ("card 4111-1111-1111-1111.", f"card {M}(card:…1111)."),
    ("94111 1111 1111 11119 and 4111 1111 1111 1111", f"94111 1111 1111 11119 and {M}(card:…1111)"),
    ("4111111111111111 x 5500005555555559", f"{M}(card:…1111) x {M}(card:…5559)"),
    ("amount 1234567890123 kept", "amount 1234567890123 kept"),
    ("twenty 12345678901234567890 digits", "twenty 12345678901234567890 digits"),
    ("é.müller@exämple.com", M),
    ("at 12:34:56 sharp", "at 12:34:56 sharp"),
    ("short fe80::1 form", f"short {M} form"),
    ("", ""),
]


@pytest.mark.parametrize(("raw", "want"), CASES)
def test_strings(spark, raw, want):
    assert redact.redact_text(raw) == want


def test_columns_agree_with_plain_version(spark):
    df = spark.createDataFrame([*CASES, (None, None)], "raw string, want string")
    assert all(r.out == r.want for r in df.select(redact.redact(F.col("raw")).alias("out"), "want").collect())


def test_documents_agree_with_plain_version(spark):
    for safe in (True, False):
        rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", redact.redact(F.col("text"), safe).alias("out")).collect()
        assert all(redact.redact_text(r.text, safe) == r.out for r in rows)


def test_maps_and_json(spark):
    df = spark.createDataFrame([({"Password": "x", "note": "mail a@b.org", "n": None},)], "m map<string,string>")
    assert df.select(redact.redact_map(F.col("m")).alias("m")).first().m == {"Password": M, "note": f"mail {M}", "n": None}
    value = {"a": [{"api_key": 5, "x": "1.2.3.4"}], "deep": None}
    for _ in range(200):
        value["deep"] = {"deep": value["deep"], "t": "a@b.org"}
    out = redact.redact_value(value)
    assert out["a"] == [{"api_key": M, "x": M}]
    level = out["deep"]
    while level:
        assert level["t"] == M
        level = level["deep"]
    df = spark.createDataFrame([(json.dumps({"ssn": 1, "u": ["a@b.org"]}),), ("not json a@b.org",), (None,)], "j string")
    got = [r[0] for r in df.select(redact.redact_json(F.col("j"))).collect()]
    assert json.loads(got[0]) == {"ssn": M, "u": [M]} and got[1:] == [f"not json {M}", None]
