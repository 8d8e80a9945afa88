import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import timeline

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def make(spark, n=400, seed=1, hot=0.5):
    """Half of all rows belong to one key; many instants are shared."""
    rng = random.Random(seed)
    rows = [(i, 0 if rng.random() < hot else rng.randrange(1, 6), T0 + dt.timedelta(seconds=rng.randrange(0, 86_400 * 6, 600)), float(rng.randrange(9)), rng.choice("ab")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k long, at timestamp, v double, kind string")


@pytest.mark.parametrize("stretch", [7200, 86_400, 86_400 * 30])
def test_trailing_sees_across_borders(spark, stretch):
    rows, df = make(spark)
    out = timeline.trailing(df, "k", "at", {"n": (7200, F.count(F.lit(1))), "s": (3600, F.sum("v"))}, stretch)
    got = {r.id: (r.n, r.s) for r in out.collect()}
    for i, k, at, _, _ in rows:
        near = lambda s: [r for r in rows if r[1] == k and 0 <= (at - r[2]).total_seconds() <= s]  # noqa: B023, E731
        assert got[i] == (len(near(7200)), sum(r[3] for r in near(3600)))


@pytest.mark.parametrize("stretch", [3600, 86_400 * 7])
def test_last_and_running_cross_borders(spark, stretch):
    rows, df = make(spark, seed=2)
    last = timeline.last_before(df, "k", ["at", "id"], "at", F.when(F.col("kind") == "a", F.col("id")), "p", stretch)
    got = {r.id: (r.p, r.s) for r in timeline.running_sum(last, "k", ["at", "id"], "at", F.col("v"), "s", stretch).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    for n, (i, k, _, _, _) in enumerate(order):
        before = [r for r in order[:n] if r[1] == k]
        a = [r[0] for r in before if r[4] == "a"]
        assert got[i] == (a[-1] if a else None, sum(r[3] for r in before) + order[n][3])


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, "x", T0), (2, "x", T0 + dt.timedelta(1)), (3, "y", T0), (4, None, T0)], "id long, k string, at timestamp")
    right = spark.createDataFrame([(10, "x", T0), (11, "x", T0 - dt.timedelta(30)), (12, "y", T0 + dt.timedelta(1))], "rid long, k string, at timestamp")
    out = timeline.asof(left, right, "k", "at", "id", "rid", ["rid"])
    assert {r.id: r.rid for r in out.collect()} == {1: 11, 2: 10, 3: None, 4: None}


def test_near_in_time_keeps_components(spark):
    rows, df = make(spark, 300, seed=3)
    out = timeline.near_in_time(df.withColumn("e", F.col("id") % 4), "e", "k", ["at", "id"], "at", 3600)
    got = {r.id: (r.other, r.gap_us) for r in out.collect()}
    for i, k, at, _, _ in rows:
        others = [r for r in rows if r[0] % 4 == i % 4 and r[1] != k and (r[2], r[0]) < (at, i)]
        best = max(others, key=lambda r: (r[2], r[0]), default=None)
        want = best is not None and (at - best[2]).total_seconds() <= 3600
        assert (i in got) == want
        if want:
            assert got[i] == (best[1], int((at - best[2]).total_seconds() * 1_000_000))


def test_partitions_do_not_change_results(spark):
    _, df = make(spark, seed=4)
    runs = [sorted((r.id, r.session) for r in timeline.sessions(df.repartition(n), "k", ["at", "id"], "at", 1800).collect()) for n in (1, 6)]
    assert runs[0] == runs[1]


def test_dedup_takes_the_first_by_all_columns(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 7, "c"), (2, None, None), (None, 1, "z")], "k long, o long, v string")
    assert sorted(map(str, timeline.dedup(df, ["k"], [F.col("o")]).collect())) == sorted(map(str, spark.createDataFrame([(1, 5, "a"), (2, None, None), (None, 1, "z")], df.schema).collect()))
