"""The database table of relational_scan: odd rows, no rows, and executors that are other processes."""

import os
import subprocess
import sys

import pyspark

from riskloom.plans import registry
from riskloom.sources import files

SCHEMA = "s_suppkey long, s_name string, s_acctbal double"
ODD = [(None, "no key", 1.0), (-5, "", 2.5), (10**12, None, None), (-(2**63), "least", 1.0), (2**63 - 1, "greatest", 1.0), (1, 'a "quoted", one', -0.1), (2, "two\nlines\r\nand\rmore", 1e300), (3, "  spaces ", 5e-324), (4, "üñí 😀 \\ \\n", 123456789.123456789), (5, '"', 1 / 3), (6, "tab\t\x01", 0.1), (7, "x" * 100_000, 1.5), (8, ",", 1.0), (9, '""', 1.0), (9, '""', 1.0), (10, "NULL", 1.0)]

CLUSTER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", "file://" + {shared!r}).config("spark.driver.host", "127.0.0.1").config("spark.executorEnv.PYTHONPATH", "").config("spark.ui.enabled", "false").getOrCreate()
from riskloom.plans import registry
rows = registry.QUERIES["relational_scan"](spark, "/root/testdata/sf0.001")
print("FOUND", rows.rdd.getNumPartitions(), sorted(r.s_suppkey for r in rows.collect()))
"""


def scan(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/supplier.parquet")
    return sorted(map(tuple, registry.QUERIES["relational_scan"](spark, str(path)).collect()))


def test_odd_rows_come_back_as_they_were(spark, tmp_path):
    assert scan(spark, tmp_path, ODD) == sorted(r for r in ODD if r[0] is not None)


def test_balances_that_are_no_plain_numbers(spark, tmp_path):
    found = scan(spark, tmp_path, [(k, "x", float(v)) for k, v in enumerate(["nan", "inf", "-inf", "-0.0", "0.0"])])
    assert [str(b) for _, _, b in found] == ["nan", "inf", "-inf", "-0.0", "0.0"]


def test_a_table_without_rows_or_keys(spark, tmp_path):
    assert scan(spark, tmp_path / "none", []) == []
    assert scan(spark, tmp_path / "keyless", [(None, "x", 1.0)]) == []


def test_slices_follow_the_keys(spark):
    rows = spark.range(50_000, 60_000).selectExpr("id AS k", "'n' || id AS name")
    read = files.relational(spark, files.embedded(rows, "numbers", "k"), "numbers", "k", None, None, 4, driver=files.EMBEDDED)
    sizes = read.rdd.glom().map(len).collect()
    assert sum(sizes) == 10_000 and max(sizes) < 2_600


def test_executors_of_their_own_read_the_table(tmp_path):
    (tmp_path / "home" / "work").mkdir(parents=True)  # the executors' folders
    source = os.path.dirname(pyspark.__file__)
    for name in os.listdir(source):
        if name != "work":
            (tmp_path / "home" / name).symlink_to(os.path.join(source, name))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CLUSTER.format(root=root, shared=str(tmp_path / "shared"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert f"FOUND 8 {list(range(10))}" in done.stdout, done.stderr[-2000:]
