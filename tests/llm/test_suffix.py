import hashlib
import random
from collections import Counter

import numpy as np

from riskloom.llm import suffix


def slow(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    base = word(300)
    rows = [(i, word(rng.randrange(400)) + base[rng.randrange(60) : rng.randrange(200, 300)] + word(rng.randrange(300))) for i in range(40)]
    return rows + [(40, "ab" * 400), (41, "ab" * 200 + "a"), (42, None), (43, ""), (None, base), (44, "x" * 450), (45, "x" * 201), (45, "x" * 201), (46, "x" * 200), (47, "é" * 150), (48, "é" * 100)]


def run(table):
    return sorted(tuple(r)[1:5] for r in suffix.without_repeats(table).collect())


def test_matches_brute_force(docs):
    rows = corpus()
    assert run(docs(rows)) == sorted(slow([(t or "").encode() for _, t in rows]))


def test_hot_anchors_small_chunks_and_blocks_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 4)
    monkeypatch.setattr(suffix, "CHUNK", 50)
    monkeypatch.setattr(suffix, "BLOCK", 256)
    rows = corpus()
    assert run(docs(rows)) == sorted(slow([(t or "").encode() for _, t in rows]))


def test_colliding_digests_remove_nothing_that_is_not_repeated(docs, monkeypatch):
    """Context digests of one bit and string hashes that all agree: only bytes decide."""
    rows = corpus()
    want = sorted(slow([(t or "").encode() for _, t in rows]))
    block, digests = suffix._block, suffix._digests

    def blind_block(data, at):
        pos, anchors, found = block(data, at)
        return pos, anchors, found & 1

    monkeypatch.setattr(suffix, "_block", blind_block)
    assert run(docs(rows)) == want
    monkeypatch.setattr(suffix, "HOT", 4)
    monkeypatch.setattr(suffix, "CHUNK", 50)
    assert run(docs(rows)) == want
    monkeypatch.setattr(suffix, "_digests", lambda sums_of, at: [d & 3 for d in digests(sums_of, at)])
    assert run(docs(rows)) == want


def test_kept_bytes_and_empty_table(docs):
    out = suffix.without_repeats(docs([(1, "keep " + "r" * 300), (2, "r" * 300 + " this")])).collect()
    assert sorted(bytes(r.kept) for r in out) == [b" this", b"keep "]
    assert suffix.without_repeats(docs([])).count() == 0


def test_sort_and_common_extensions():
    rng = random.Random(1)
    strings, groups = [], []
    for g in range(50):
        for _ in range(rng.randrange(1, 9)):
            strings.append(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))))
            groups.append(g)
    done = suffix.Sorted(strings, np.array(groups))
    assert [strings[i] for i in done.order] == [strings[i] for i in sorted(range(len(strings)), key=lambda i: (groups[i], strings[i]))]
    for k in range(1, len(strings)):
        a, b = strings[done.order[k - 1]], strings[done.order[k]]
        common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert done.common[k] == (common if groups[done.order[k - 1]] == groups[done.order[k]] else -1)


def test_collisions_are_noticed(monkeypatch):
    calls = []

    def blind(self, x, y):  # as if all hashes collided, under the first base only
        calls.append(self.base)
        return np.minimum(self.size[x], self.size[y]) if self.base == suffix.BASES[0] else real(self, x, y)

    real = suffix.Sorted.extension
    monkeypatch.setattr(suffix.Sorted, "extension", blind)
    done = suffix.Sorted([b"zz", b"ab", b"ac"], np.zeros(3, int))
    assert [int(i) for i in done.order] == [1, 2, 0]
    assert set(calls) == set(suffix.BASES[:2])
