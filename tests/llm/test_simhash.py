import random

import numpy as np
import xxhash

from riskloom.llm import simhash
from riskloom.operators.graph import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def slow_components(fps, ids):
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    out = [None] * n
    for members in groups.values():
        known = [ids[m] for m in members if ids[m] is not None]
        for m in members:
            out[m] = min(known) if known else None
    return out


def corpus():
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = "changed"
            rows.append(" ".join(words))
    rows += ["", None, " \t\n", "one", "one two", "ONE Two", "Ärger ÄRGER", "a\x1fb\x85c", "x " * 70_000]
    return [(i if i % 17 else None, t) for i, t in enumerate(rows)]


def test_fingerprint_matches_definition():
    for text in ("", "a", "A b", "a B c", "a b c d a b c", "é É\x0bz q"):
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_near_duplicates_match_all_pairs(spark, docs):
    rows = corpus()
    rows += [rows[3], rows[3]]
    for limit in (512, 1):  # the second sends every bucket down the path of hot buckets
        got = simhash.near_duplicates(docs(rows), bucket_limit=limit).collect()
        assert len(got) == len(rows)
        fps = [slow_fingerprint(t) for _, t in rows]
        want = slow_components(fps, [i for i, _ in rows])
        key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0)
        assert sorted(((r.id, r.fp % (1 << 64), r.component) for r in got), key=key) == sorted(zip([i for i, _ in rows], fps, want, strict=True), key=key)


def test_links_of_a_crowded_bucket(spark):
    rng = np.random.default_rng(1)
    fps = {0, -1} | {int(x) for x in rng.integers(0, 1 << 12, 200)} | {int(x) << 40 for x in rng.integers(0, 1 << 10, 100)}
    nodes = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    order = sorted(fps)
    want = slow_components([f % (1 << 64) for f in order], order)
    for limit in (3, 10_000):
        roots = {r.node: r.component for r in components(simhash.links(nodes, limit), "a", "b").collect()}
        assert [roots.get(f, f) for f in order] == want


def test_long_chain_of_near_copies(spark):
    """Each fingerprint is a bit or two from the one before it and far from the rest, as along a document's versions."""
    rng = random.Random(2)
    chain = [rng.getrandbits(64)]
    while len(chain) < 400:
        chain.append(chain[-1] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = [x - (1 << 64) if x >> 63 else x for x in dict.fromkeys(chain)]
    got = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")), "a", "b").collect()
    assert {(r.node, r.component) for r in got} == {(x, min(signed)) for x in signed}


def test_empty_table(spark, docs):
    assert simhash.near_duplicates(docs([])).count() == 0
