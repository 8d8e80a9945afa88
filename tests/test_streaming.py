import datetime as dt
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from riskloom.streaming import silver as s
from riskloom.streaming import state

T0 = dt.datetime(2024, 1, 1, 12, tzinfo=dt.UTC)
BATCHES = [
    [("a", 0), ("b", 1), ("a", 0)],
    [("c", 40), ("a", 0), ("b2", 35)],
    [("late1", 5), ("d", 41), ("b2", 35), ("ooo", 33)],
    [("e", 60), ("late2", 20)],
]
SCHEMA = "event_id string, occurred_at timestamp, k string, amount long"


def feed(spark, path, batches, order=None):
    for i, rows in enumerate(batches):
        made = [(e, T0 + dt.timedelta(minutes=m), "k", 1) for e, m in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        found = [f for f in os.listdir(f"{path}/in") if f.endswith(".parquet") and not f.startswith("batch")]
        os.rename(f"{path}/in/{found[0]}", f"{path}/in/batch{i}.parquet")
        os.utime(f"{path}/in/batch{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def names(spark, path):
    return sorted(r[0] for r in spark.read.schema("event_id string").parquet(path).collect())


def test_late_rows_are_routed_and_every_row_is_counted(spark, tmp_path):
    feed(spark, str(tmp_path), BATCHES)
    handler = s.Silver(f"{tmp_path}/silver")
    s.run_silver(stream(spark, tmp_path), handler, str(tmp_path)).awaitTermination()
    assert names(spark, f"{tmp_path}/silver/on_time") == ["a", "b", "b2", "c", "d", "e", "ooo"]
    assert names(spark, f"{tmp_path}/silver/late") == ["late1", "late2"]
    c = handler.counters
    assert (c.on_time, c.late, c.duplicates, c.dead) == (7, 2, 3, 0)
    # a batch that runs again writes the same
    again = s.Silver(f"{tmp_path}/silver")
    again(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in/batch2.parquet"), 2)
    assert names(spark, f"{tmp_path}/silver/on_time") == ["a", "b", "b2", "c", "d", "e", "ooo"]
    assert again.counters.batches[2] == {"on_time": 2, "late": 1, "dead": 0, "duplicates": 1}


def test_a_row_at_the_watermark_is_on_time(spark, tmp_path):
    handler = s.Silver(f"{tmp_path}/silver")
    make = lambda rows: spark.createDataFrame([(e, T0 + dt.timedelta(minutes=m) if m is not None else None, "k", 1) for e, m in rows], SCHEMA)
    handler(make([("x", 30)]), 0)
    handler(make([("edge", 20), ("under", 19), (None, 25), ("no time", None)]), 1)
    assert handler.counters.batches[1] == {"on_time": 1, "late": 1, "dead": 2, "duplicates": 0}
    handler(make([]), 2)
    assert handler.counters.batches[2] == {"on_time": 0, "late": 0, "dead": 0, "duplicates": 0}


def test_checks_make_dead_letters(spark, tmp_path):
    handler = s.Silver(f"{tmp_path}/silver", checks=(("too much", F.col("amount") > 5),))
    handler(spark.createDataFrame([("x", T0, "k", 9), ("y", T0, "k", 1)], SCHEMA), 0)
    dead = spark.read.parquet(f"{tmp_path}/silver/dead").collect()
    assert [(r.event_id, r.errors) for r in dead] == [("x", ["too much"])]


def test_gold_does_not_depend_on_how_batches_are_cut(spark, tmp_path):
    rows = [[("a", 0), ("b", 1)], [("c", 8), ("d", 2)], [("e", 9), ("a", 0)]]
    results = []
    for name, cut in (("one", [[r for b in rows for r in b]]), ("three", rows)):
        path = f"{tmp_path}/{name}"
        feed(spark, path, cut)
        gold = s.Gold(s.Silver(f"{path}/silver"), f"{path}/gold", "k", "amount", 300)
        s.run_silver(stream(spark, path), gold, path).awaitTermination()
        results.append(sorted(map(tuple, gold.table(spark).collect())))
    start = int(T0.timestamp())
    assert results[0] == results[1] == [("k", start, 3, 3), ("k", start + 300, 2, 2)]


def test_a_query_resumes_after_a_stop(spark, tmp_path):
    feed(spark, str(tmp_path), BATCHES[:2])
    s.bronze(stream(spark, tmp_path), f"{tmp_path}/bronze", str(tmp_path)).awaitTermination()
    more = f"{tmp_path}/in/batch9.parquet"
    shutil.copy(f"{tmp_path}/in/batch0.parquet", more)
    os.utime(more, (1_700_000_100, 1_700_000_100))
    s.bronze(stream(spark, tmp_path), f"{tmp_path}/bronze", str(tmp_path)).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/bronze").count() == 9


@pytest.mark.parametrize("name", ["windows", "dedup", "sessions"])
def test_native_twins(spark, tmp_path, name):
    feed(spark, str(tmp_path), [[r for b in BATCHES for r in b]])
    source = stream(spark, tmp_path)
    made = {"windows": lambda: s.native_windows(source, "occurred_at", "k", 300), "dedup": lambda: s.native_dedup(source, "occurred_at", "event_id"), "sessions": lambda: s.native_sessions(source, "occurred_at", "k")}[name]()
    q = made.writeStream.format("memory").queryName(f"twin_{name}").outputMode("append" if name == "dedup" else "complete" if name == "windows" else "append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql(f"SELECT * FROM twin_{name}").collect()
    if name == "dedup":
        assert sorted(r.event_id for r in got) == ["a", "b", "b2", "c", "d", "e", "late1", "late2", "ooo"]
    if name == "windows":
        assert sum(r.n for r in got) == 12


class FileClient:
    def __init__(self, path):
        self.path = path
        os.makedirs(path, exist_ok=True)

    def put(self, key, value):
        with open(f"{self.path}/{key}", "w") as f:
            f.write(str(value["v"]))

    def close(self):
        pass


def test_reconcile_keeps_the_newest_per_key(spark, tmp_path):
    store = state.LatestStore()
    handler = state.reconcile(store, "k", "at")
    df = spark.createDataFrame([("x", 1, 5), ("x", 2, 6), ("y", 1, 7)], "k string, at long, v long")
    handler(df, 0)
    handler(df, 0)
    table = state.TableStore(f"{tmp_path}/store")
    for batch, rows in ((0, df), (0, df), (1, spark.createDataFrame([("x", 1, 9), ("z", 5, 1)], df.schema))):
        state.reconcile(table, "k", "at")(rows, batch)
    assert {(r.k, r["at"], r.v) for r in table.latest(spark, "k", "at").collect()} == {("x", 2, 6), ("y", 1, 7), ("z", 5, 1)}
    state.reconcile(state.RemoteStore(lambda: FileClient(f"{tmp_path}/remote")), "k", "at")(df, 0)
    assert {p: open(f"{tmp_path}/remote/{p}").read() for p in os.listdir(f"{tmp_path}/remote")} == {"x": "6", "y": "7"}  # written in the tasks
    assert store.rows == {"x": {"at": 2, "v": 6, "source": "RECONCILED"}, "y": {"at": 1, "v": 7, "source": "RECONCILED"}}
    assert store.batches == {0}


def test_stream_joins_profiles(spark, tmp_path):
    feed(spark, str(tmp_path), BATCHES[:1])
    profiles = spark.createDataFrame([("k", "known")], "k string, note string")
    q = state.enriched(stream(spark, tmp_path), profiles, "k").writeStream.format("memory").queryName("enriched").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.note for r in spark.sql("SELECT note FROM enriched").collect()} == {"known"}


def test_progress_is_reported(spark, tmp_path):
    feed(spark, str(tmp_path), BATCHES[:1])
    seen = state.Progress()
    spark.streams.addListener(seen)
    try:
        s.bronze(stream(spark, tmp_path), f"{tmp_path}/bronze", str(tmp_path)).awaitTermination()
        for _ in range(100):
            if seen.batches:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert sum(b["rows"] for b in seen.batches) == 3


def test_counts_live_in_state(spark, tmp_path):
    feed(spark, str(tmp_path), BATCHES[:2])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    out = {}
    try:
        # processing time never ends by itself here, so the query runs until both files are in, and is stopped
        q = state.velocity(stream(spark, tmp_path), "k").writeStream.foreachBatch(lambda df, b: out.update({r.account: r.n for r in df.collect()})).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
        for _ in range(300):
            if out.get("k") == 6 or q.exception():
                break
            time.sleep(0.2)
        q.stop()
        assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert out == {"k": 6}
