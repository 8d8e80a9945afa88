import random

import corpus_pipeline

def test_each_stage_takes_effect(spark, docs, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("abdefgiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = lambda n=150: " ".join(rng.choices(words, k=n))
    rows = [(i, text(), f"s{i % 3}") for i in range(200)]
    labels = [(i, 1, 0) for i in range(200)]
    for i in range(200, 260):
        rows.append((i, text(60) + " vilewort fiendling " + text(60) + " vilewort", "s0"))
        labels.append((i, 1, 1))
    rows.append((300, rows[0][1], "s0"))
    rows.append((301, rows[1][1] + " ", "s1"))
    near = rows[2][1].split()
    rows.append((302, " ".join([*near[:-1], "tail"]), "s2"))
    leak = text(40)
    rows.append((303, text(50) + " " + leak + " " + text(50), "s0"))
    rows += [(304, None, None), (305, "", "s1"), (306, "  ", "s2")]
    table = docs(rows)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs_now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_now, str(tmp_path))
        if name != "mixing":
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs_now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs_now.select("doc_id").collect()})
    everything = {r[0] for r in rows}
    assert everything - kept[0] == set(range(200, 260))
    assert kept[0] - kept[1] == {300, 305} and 301 in kept[1]
    shingles = {i: {" ".join(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t and t.split() else set() for i, t, _ in rows if i in kept[1]}
    order = sorted(shingles)
    root = {i: i for i in order}
    for i in order:
        for j in order:
            if j < i and (shingles[i] == shingles[j] or 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j])):
                root[i] = min(root[i], root[j])
    assert kept[1] - kept[2] == {i for i in order if root[i] != i} and {301, 302, 306} <= kept[1] - kept[2]
    assert kept[2] - kept[3] == {303}
    assert kept[3] == kept[4]
    last = {r.doc_id: r for r in docs_now.collect()}
    direct = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.taken for i, r in last.items()} == {i: r.taken for i, r in direct.items()}


def tables(spark, path, documents):
    documents.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_tables(spark, docs, tmp_path):
    sf = tables(spark, tmp_path, docs([]))
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == 0 and out.columns[-4:] == ["size", "source_size", "target", "taken"]


def test_odd_rows_and_clashing_columns(spark, docs, tmp_path):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "a null id is an id"), (None, "a null id is an id"), (1, None), (2, ""), (3, " "), (4, long), (5, long + " end"), (6, "same text here"), (6, "same text here"), (7, "an idiot said so")]
    table = docs(rows).selectExpr("*", "'mine' as score", "1 as target", "2 as node", "3 as label", "4 as window", "5 as item", "true as kept", "6 as keep_id", "7 as component", "8 as fp")
    sf = tables(spark, tmp_path, table)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, now, sf).columns == table.columns, name
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [f"{c}_input" if c in ("size", "target", "taken") else c for c in table.columns] + ["size", "source_size", "target", "taken"]
    got = out.collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
    # the toxic one goes; equal texts, empty ones and the longer near copy leave one row each
    assert ids == [(False, 1), (False, 4), (False, 6), (True, 0)]
    assert {r.score for r in got} == {"mine"} and {r.doc_id: r.size for r in got}[4] == 60_000
    assert sum(r.taken for r in got) <= 3 * sum(r.size for r in got)
