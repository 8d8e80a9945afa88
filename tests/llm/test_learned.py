import random

import numpy as np
import pyarrow as pa

from riskloom.llm import quality, toxicity
from riskloom.llm.common import held_out, training_ids


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdefgiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(20, 200))
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.7)
        if toxic:
            for _ in range(rng.randrange(2, 8)):
                words[rng.randrange(len(words))] = rng.choice(["vilewort", "fi3ndling", "grimsüchtig", "grimsülich"])
        if not good:
            words = [w + rng.choice(["$$$", "%%%", "!!"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    return rows, labels


def held(spark, table):
    return {r[0] for r in table.filter(held_out(table["doc_id"])).select("doc_id").collect()}


def test_toxicity_holds_out_of_sample(spark, docs):
    rows, labels = corpus()
    table, marks = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(table, marks)
    got = {r.doc_id: r.score for r in toxicity.toxicity(table, lexicon).collect()}
    out = held(spark, table)
    assert np.mean([(got[i] >= 0.7) == bool(t) for i, _, t in labels if i in out]) > 0.97
    assert any(s.startswith("grimsü") for s in lexicon.weights)
    assert toxicity.load(toxicity.save(lexicon)) == lexicon


def test_folding_boundaries_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot\0": 3.0, "moron": 3.0, "clown\0": 2.0})
    hit = lambda t: lexicon.measure(t)[0]
    assert hit("You IDIOT!") == hit("you 1d10t") == hit("you іdіоt") == hit("idiot$$$") == 3.0
    assert toxicity.Lexicon({"oie\0": 1.0}).measure("013 o1e")[0] == 1.0 and toxicity.words("013 o1e ab 99") == {"oie"}
    assert hit("idiotic") == hit("xmoron") == 0.0
    assert hit("moronic") == 3.0
    assert hit("a clown fish") == 0.0 and hit("a clown") == 2.0 and hit("clown fish and a clown") == 2.0
    assert hit("ｉｄｉｏｔ") == hit("ïdïót") == hit("i\u200bdi\u00adot") == hit("𝐢𝐝𝐢𝐨𝐭") == hit("i.d.i.o.t") == hit("so i d-i*o t!") == hit("idiooooot") == 3.0
    assert hit("U.S.A. e.g. i. d. 1 2 3 4 5") == 0.0
    short, long = lexicon.score("idiot"), lexicon.score("idiot " + "word " * 10_000)
    assert short > long > 0


def test_an_open_stem_wins_over_the_word():
    lexicon = toxicity.Lexicon({"idiot\0": 2.0, "idiot": 3.0})
    assert [lexicon.measure(t)[0] for t in ("idiot", "idiots", "idiotic", "xidiot")] == [3.0, 3.0, 3.0, 0.0]


def naive_total(lexicon, low):
    """Every entry at every place."""
    folded, found, spared = toxicity.fold(low), {}, []
    for word, (size, weight, whole) in lexicon.entries().items():
        for at in range(len(folded) - size + 1):
            if folded[at : at + size] != word or at and low[at - 1].isalpha() or whole and low[at + size : at + size + 1].isalpha() or not any(map(str.isalpha, low[at : at + size])):
                continue
            if weight:
                found[at] = max(found.get(at, 0.0), weight)
            else:
                spared.append(range(at, at + size))
    return sum(w for at, w in found.items() if not any(at in s for s in spared))


def test_matches_like_a_naive_matcher():
    rng = random.Random(5)
    for _ in range(60):
        stems = {"".join(rng.choice("abo") for _ in range(rng.randrange(1, 5))) + rng.choice(["", "\0"]): rng.randrange(1, 5) / 2 for _ in range(12)}
        lexicon = toxicity.Lexicon(stems, exceptions=("abo ba", "oo"))
        for _ in range(20):
            text = "".join(rng.choice("abo0 ä.4\u0430") for _ in range(60))
            assert lexicon.measure(text)[0] == max(naive_total(lexicon, v) for v in toxicity.views(text))


def test_long_words_are_learned_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" + "bcdefgh" * 4]), pa.array([1], pa.int32())], names=["t", "label"])
    stems = {s for b in toxicity._stem_counts([batch]) for s in b.column(0).to_pylist()}
    assert "a" + "bcdefgh" * 4 + "\0" in stems and max(len(s) for s in stems if not s.endswith("\0")) == toxicity.LONGEST


def test_score_beside_a_column_of_its_name(spark, docs):
    table = docs([(1, "idiot"), (2, "x" * 100_000)]).selectExpr("*", "'mine' AS Score")
    out = toxicity.toxicity(table, toxicity.Lexicon({"idiot\0": 2.0}))
    assert out.columns == [*[c for c in table.columns if c != "Score"], "Score_input", "score"]
    assert all(r.Score_input == "mine" and 0 <= r.score <= 1 for r in out.collect())


def test_quality_holds_out_of_sample(spark, docs):
    rows, labels = corpus(seed=2)
    table, marks = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(table, marks)
    got = {r.id: r.score for r in quality.quality(table, model).collect()}
    out = held(spark, table)
    assert np.mean([(got[i] >= 0.5) == bool(q) for i, q, _ in labels if i in out]) > 0.97
    again = quality.fit(table.repartition(5), marks)
    assert {r.id: r.score for r in quality.quality(table, again).collect()} == got


def test_held_out_labels_change_nothing(spark, docs):
    rows, labels = corpus(300)
    table = docs(rows)
    out = held(spark, table)
    marks = lambda flip: spark.createDataFrame([(i, 1 - q if flip and i in out else q, 1 - t if flip and i in out else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert toxicity.learn(table, marks(False)) == toxicity.learn(table, marks(True))
    a, b = quality.fit(table, marks(False)), quality.fit(table, marks(True))
    assert np.array_equal(a.beta, b.beta) and np.array_equal(a.levels, b.levels)


def test_odd_rows_and_missing_labels(spark, docs):
    rows = [(1, None), (2, ""), (3, "word " * 60_000), (None, "x"), (4, "same"), (4, "same")]
    table = docs(rows)
    for labels in ([], [(4, None, None), (None, 1, 1)], [(4, 1, 0), (4, 0, 1), (3, 1, 0)]):
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        scores = [r.score for r in quality.quality(table, quality.fit(table, marks)).collect()]
        scores += [r.score for r in toxicity.toxicity(table, toxicity.learn(table, marks)).collect()]
        assert len(scores) == 12 and all(0 <= s <= 1 for s in scores)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(docs([]), quality.fit(docs([]), marks)).count() == 0
    assert toxicity.toxicity(docs([]), toxicity.learn(docs([]), marks)).count() == 0
    assert toxicity.toxicity(table, toxicity.learn(table, marks)).columns == [*table.columns, "score"]


def test_training_ids_are_bounded(spark):
    marks = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    a = training_ids(marks, "quality", 10).collect()
    assert len(a) == 10 and a == training_ids(marks.repartition(7), "quality", 10).collect()


def test_pool_rises():
    assert list(quality.pool(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4))) == [0.1, 0.4, 0.4, 0.9]


def test_pool_matches_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(30):
        v, w = rng.random(12), rng.integers(1, 5, 12).astype(float)
        mean = lambda a, b: np.average(v[a : b + 1], weights=w[a : b + 1])  # noqa: E731, B023
        want = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(quality.pool(v, w), want)


def test_quality_fit_matches_one_in_memory(spark, docs):
    rows, labels = corpus(400, seed=3)
    table, marks = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(table, marks, width=20)
    part = {r.doc_id: (r.label, r.part) for r in training_ids(marks, "quality", 20_000).selectExpr("doc_id", "label", "pmod(xxhash64(7, doc_id), 3) = 0 as part").collect()}
    stats = {i: s for i, s in zip((i for i, _ in rows), quality._stats_of(pa.array([t for _, t in rows])), strict=True)}
    s = np.array([stats[i] for i in part])
    assert np.allclose(model.mean, s.mean(axis=0)) and np.allclose(model.spread, s.std(axis=0) + 1e-6)
    x = model.features(np.array([stats[i] for i, (_, p) in part.items() if not p]))
    y = np.array([label for label, p in part.values() if not p], float)
    # ridge regression as least squares with one more row for each coefficient
    beta = np.linalg.lstsq(np.vstack([x, 0.1 * np.eye(x.shape[1])]), np.concatenate([y, np.zeros(x.shape[1])]), rcond=None)[0]
    assert np.allclose(x @ model.beta, x @ beta, atol=1e-6)
