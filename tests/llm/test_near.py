import random

import corpus_pipeline
from riskloom.llm import near


def slow_sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(texts):
    sets = [slow_sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if not x and not y or 5 * len(x & y) >= 4 * len(x | y):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    line = " ".join(word() for _ in range(12))
    texts = [line + " " + " ".join(word() for _ in range(rng.randrange(30, 120))) for _ in range(60)]
    for base in texts[:20]:
        for changes in (1, 2, 3, 4, 6):  # about 0.97 down to 0.5
            words = base.split()
            for at in rng.sample(range(len(words)), changes):
                words[at] = word()
            texts.append(" ".join(words))
    crowd = [word() for _ in range(150)]
    for _ in range(120):
        words = list(crowd)
        for at in rng.sample(range(150), rng.randrange(5)):
            words[at] = word()
        texts.append(" ".join(words))
    texts += ["", None, " \t", "one", "ONE", "one two", "a b c d e", "a b c d e f", " ".join(["x"] * 500), " ".join(["x"] * 900)]
    texts += [" ".join(f"v{i}" for i in range(49)), " ".join(f"v{i}" for i in range(40))]  # exactly 36 of 45
    return texts


def test_near_copies_match_all_pairs(spark, docs):
    texts = corpus()
    got = near.near_copies(docs(list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    mine, want = {}, {}
    for r in got:
        mine.setdefault(r.root, set()).add(r.id)
    for i, r in enumerate(slow_groups(texts)):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, mine.values())) > 60


def test_stage_joins_copies_at_the_similarity_asked_for(spark, docs):
    words = [f"w{i}" for i in range(204)]
    copy = words[:50] + ["other"] + words[51:120] + ["more"] + words[121:]  # 190 of 210 shingles
    far = ["z" if i % 20 == 10 else w for i, w in enumerate(words)]
    table = docs([(5, " ".join(words)), (7, " ".join(copy)), (8, " ".join(far)), (None, " ".join(words) + " end")])
    out = corpus_pipeline.drop_near_copies(spark, table, "")
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == [5, 8]


def test_empty_table(spark, docs):
    assert near.near_copies(docs([])).count() == 0
