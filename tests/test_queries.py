"""Every query beside its SQL, at the smallest scale."""

import duckdb
import pytest

import verify
from riskloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in verify.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    said = verify.compare(spark, con, name, SF, registry.ORACLE_SQL.get(name))
    assert not said.startswith("DIFFERS"), said


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys\nfrom riskloom.plans import registry\nimport riskloom.streaming.silver, riskloom.streaming.state, riskloom.operators.ml\nassert not any(m.startswith('riskloom.' + 'llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)
