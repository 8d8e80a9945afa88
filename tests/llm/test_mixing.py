import random

from riskloom.llm import mixing


def water(sizes, weights=(5, 2, 1), cap=3):
    """The resharing as stated, step by step."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), sum(sizes.values())
    while free:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            free.remove(s)
            rest -= target[s]
    return target


def make(seed, sources, n):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 40))), rng.choice(sources)) for i in range(n)]


def check(out, rows):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = water(sizes), dict.fromkeys(sizes, 0)
    for r in out:
        assert r.size == len((r.text or "").split())
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2, (s, taken[s], want[s])


def test_targets_and_takings(docs):
    for seed, sources in ((1, ["a", "b", "c", "d", None]), (2, ["z"] * 8 + ["é", "Z", "tiny"]), (3, ["only"])):
        rows = make(seed, sources, 300) + [(900, None, "empty"), (901, "", "empty")]
        check(mixing.mix(docs(rows)).collect(), rows)


def test_reruns_agree_whatever_the_partitions(docs):
    table = docs(make(4, ["a", "b", "b", "b"], 400))
    runs = [sorted((r.doc_id, r.taken) for r in mixing.mix(table.repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_better_documents_come_first(docs):
    rows = [(i, "word " * 20 if i % 2 else "w#$% " * 20, "a") for i in range(400)] + [(1000 + i, "x " * 20, "b") for i in range(40)]
    rows += [(2000 + i, "y " * 20, "c") for i in range(400)]
    out = [r for r in mixing.mix(docs(rows)).collect() if r.source == "c"]
    assert sum(r.taken > 0 for r in out) < len(out)
    clean = [r.taken / r.size for r in mixing.mix(docs(rows)).collect() if r.source == "a" and r.doc_id % 2]
    noisy = [r.taken / r.size for r in mixing.mix(docs(rows)).collect() if r.source == "a" and not r.doc_id % 2]
    assert sum(clean) / len(clean) >= sum(noisy) / len(noisy)


def test_columns_nulls_repeats_and_empty_tables(docs):
    rows = [(1, "a b c", None), (1, "a b c", None), (None, "d e", None), (2, None, None), (3, "\t \n", "q"), (4, "k " * 100_000, "long")]
    table = docs(rows)
    out = mixing.mix(table)
    assert out.columns == [f"{c}_input" if c in ("taken", "size") else c for c in table.columns] + ["size", "source_size", "target", "taken"]
    assert {r.size_input for r in out.collect()} == {"x1", "x2", "x3", "x4", None}
    assert len(out.collect()) == len(rows)
    assert mixing.mix(docs([])).count() == 0
    assert [r.taken for r in mixing.mix(docs([(1, None, "s")])).collect()] == [0]


def test_very_many_sources(spark):
    rng = random.Random(7)
    sizes = {f"s{i:04d}" if i else None: rng.choice([0, 1, rng.randrange(1, 10_000)]) for i in range(500)}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = water(sizes)
    for many in (10_000, 10):  # in one place, and by ranges
        got = {r.source: r.target for r in mixing.targets(rows, (5.0, 2.0, 1.0), 3.0, many).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
