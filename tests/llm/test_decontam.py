import os
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from riskloom.llm import decontam

QUESTION = "If Alice buys 12 apples at 3 dollars each and Bob sells 5 pears at 3 dollars, how much money does Alice have left over in the end?"
TWIN = "If Carol buys 40 apples at {} euros each and Dan sells 9 pears at {} euros, how much money does Carol have left over in the end?"
OTHER = "The quick brown fox jumps over the lazy dog while seven wise owls watch from old dark trees near the silent river bank."


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, place string")


def found(table, bench, **options):
    return {(r.id, r.item_id) for r in decontam.contaminated(table, bench, **options).collect()}


def test_parameters_change_but_slots_agree(spark, docs):
    bench = items(spark, [(1, QUESTION), (2, OTHER), (3, None), (4, "too short to match it")])
    table = docs([
        (1, "Intro text here. " + TWIN.format(7, 7) + " More."), (2, "Intro. " + TWIN.format(7, 8)), (3, OTHER.upper()), (4, None), (5, ""), (6, "too short to match"),
        (None, "x " * 50_000 + OTHER), (8, "nothing of the kind, the end of the line for all of us who write"), (9, " ".join(OTHER.split()[4:17])), (10, " ".join(OTHER.split()[4:14])),
        (11, OTHER + " gap. " + QUESTION), (11, OTHER + " gap. " + QUESTION),
    ])
    want = {(1, 1), (3, 2), (None, 2), (9, 2), (11, 1), (11, 2)}
    assert found(table, bench) == want
    assert found(table, bench, limit=0) == want  # the way without a broadcast
    out = decontam.without_contaminated(table, bench)
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 6, 8, 10]


def test_case_alone_hides_nothing(spark, docs):
    bench = items(spark, [(1, QUESTION), (2, OTHER)])
    table = docs([(1, QUESTION.lower()), (2, QUESTION.upper()), (3, QUESTION.title()), (4, OTHER.title()), (5, "%%% ".join(OTHER.split()))])
    assert found(table, bench) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)}


def test_empty_tables(spark, docs):
    assert found(docs([]), items(spark, [(1, QUESTION)])) == set()
    assert found(docs([(1, QUESTION)]), items(spark, [])) == set()
    assert found(docs([(1, QUESTION)]), items(spark, [(1, QUESTION), (None, QUESTION), (1, QUESTION)])) == {(1, 1), (1, None)}


def test_units_and_joined_numbers():
    words = decontam.Canonical()
    a, b = words.tokens("It weighs 5kg or 12 lbs, says Ann."), words.tokens("it weighs 77 g or 3 oz says Bob")
    assert list(a.hashes) == list(b.hashes)
    assert list(a.kinds) == [0, 0, 1, 2, 0, 1, 2, 0, 3]


def test_a_clash_leaves_out_only_its_windows(spark, docs):
    item = "Every morning 3 children carry baskets of apples from the old orchard to the village market where a trader named Smith pays them 3 dollars and then sells all of the fruit again to people who come by train from towns along the coast because they like to eat something fresh before the long day at work begins"
    changed = item.replace("pays them 3", "pays them 4")
    other = changed.replace("3 children", "9 children").replace("Smith", "Jones")  # 3 meets 9 and 4, the rest is free of it
    thin = " ".join(w if i % 11 else "zzz" for i, w in enumerate(changed.split()))  # a word in eleven changed as well
    table = docs([(1, item), (2, "Intro. " + changed), (3, other), (4, thin), (5, TWIN.format(7, 8)), (6, "no such text in here at all, only a few words of our own")])
    assert found(table, items(spark, [(1, item), (2, QUESTION)])) == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_items_of_any_length_are_found_word_for_word(spark, docs):
    """Planted copies of items of 1 to 60 words, some of numbers only; nothing else is found. Recall is 1."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    texts = {n: " ".join(word() for _ in range(n)) for n in range(1, 61)}
    texts |= {100: "What is 12 + 5 * 3 - 7?", 101: " ".join(str(rng.randrange(10_000)) for _ in range(40)), 102: "Who wrote Hamlet?", 103: "+ - *", 104: ""}
    filler = lambda n: " ".join(f"zz{rng.randrange(500)}" for _ in range(n))
    table = docs([(i, f"{filler(30)} {t} {filler(30)}") for i, t in texts.items()] + [(500 + i, filler(80)) for i in range(40)] + [(900, filler(5) + " What is 12 + 5 * 3 - 8? Who wrote Othello?")])
    bench = items(spark, list(texts.items()))
    want = {(i, i) for i in texts if i not in (103, 104)}
    assert found(table, bench) == want
    assert found(table, bench, limit=0) == want


def test_a_phrase_that_many_items_share(spark, docs, monkeypatch):
    """Windows of a crowd make no pairs by themselves, and every item is still found."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    phrase = " ".join(word() for _ in range(11))
    texts = {i: f"{phrase} {' '.join(word() for _ in range(rng.randrange(2, 30)))}" for i in range(60)}
    table = docs([(i, f"see {t} there") for i, t in texts.items()] + [(100 + i, f"{phrase} and then something else altogether") for i in range(30)])
    bench = items(spark, list(texts.items()))
    want = found(table, bench)
    assert {(i, i) for i in texts} <= want
    monkeypatch.setattr(decontam, "CROWD", 3)
    assert found(table, bench) == want


class Held:
    """A broadcast that stays here."""

    def __init__(self, value):
        self.value = value


def batch(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(texts, pa.string())], names=["id", "h", "t"])


def searched(bench, texts, monkeypatch):
    """Window rows of ``texts`` with the sieve and without it, and the texts that the sieve leaves to search."""
    rows = pa.Table.from_batches(decontam._item_windows(decontam.WIDTH, decontam.LITERALS)([batch(bench)]))
    words = pa.Table.from_batches(decontam._item_words([batch(bench)]))
    hashes = dict(zip(words["word"].to_pylist(), words["hash"].to_pylist(), strict=True))
    spelled = pa.array(list(hashes), pa.string()), np.array(list(hashes.values()), np.int64).view(np.uint64), np.unique(words["pair"].drop_null().to_numpy().view(np.uint64))
    widths = sorted(set(rows["words"].to_pylist()) - {0})
    wanted = Held(np.unique(rows["window"].to_numpy().view(np.uint64)))
    read, tokens = [], decontam.Canonical.tokens
    plain = pa.Table.from_batches(decontam._text_windows(decontam.WIDTH, decontam.LITERALS, widths, wanted)([batch(texts)]))
    with monkeypatch.context() as patched:
        patched.setattr(decontam.Canonical, "tokens", lambda self, text: read.append(text) or tokens(self, text))
        sieved = pa.Table.from_batches(decontam._text_windows(decontam.WIDTH, decontam.LITERALS, widths, wanted, Held(spelled))([batch(texts)]))
    return plain, sieved, read


def test_texts_of_other_words_are_not_searched(monkeypatch):
    """Nor are those of an item's words in another order; the cost of reading token by token is that of few texts."""
    rng = random.Random(10)
    bench = [" ".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("bcdfglmnprst") for _ in range(30)) for _ in range(40)]
    own = sorted({w for t in bench for w in t.split()})
    texts = [" ".join(rng.choice(own) for _ in range(200)) for _ in range(200)] + [" ".join(f"zz{chr(97 + rng.randrange(26))}" for _ in range(200)) for _ in range(200)]
    texts += [f"Intro. {t} More." for t in bench] + ["", "  ", "... !!"]
    plain, sieved, read = searched(bench, texts, monkeypatch)
    assert sieved.equals(plain) and set(sieved["id"].to_pylist()) == set(range(400, 440))
    assert len(read) < 50


def test_the_sieve_loses_nothing(monkeypatch):
    """Copies with other case, numbers, units, names, marks and joined tokens, beside letters that fold in odd ways."""
    rng = random.Random(11)
    odd = "ΟΔΟΣ is İstanbul or ℂarl at Ⅻth and 𝒜bc Ǆungla ßtraße ÉTÉ Ωmega of ﬁne STRASSE \u0663kg x2 5kg 12% A1b2c3 covid19 ² ①a"
    bench = [QUESTION, OTHER, f"{odd} {OTHER}", odd, "What is 12 + 5 * 3 - 7?", "Hamlet", "Who wrote Hamlet?", "in 5kg", "", "- *", "It weighs 5kg or 12 lbs, says Ann, and 7% of all that is left over goes to Bob."]

    def changed(text):
        words = []
        for w in text.split():
            w = rng.choice([w, w, w, w, w.upper(), w.title(), w.lower(), f"«{w}»,", f"{w}.", re.sub(r"\d+", str(rng.randrange(99)), w)])
            words += [w] + rng.choice([[], [], [], [], ["--"], ["7"], ["and"]] if rng.random() < 0.3 else [[]])
        return rng.choice([" ", "\u00a0", "\n\u2003"]).join(words)

    texts = [f"{changed(OTHER[:rng.randrange(60)])} {changed(rng.choice(bench))} {changed(QUESTION[:rng.randrange(60)])}" for _ in range(1500)] + bench
    for some in (bench, [t for t in bench if len(t.split()) > 12]):
        plain, sieved, _ = searched(some, texts, monkeypatch)
        assert plain.num_rows > 1500 and sieved.equals(plain)


def test_letters_that_arrow_and_python_take_alike():
    """What the sieve builds on, for every letter that it does not leave to the search."""
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    table = pa.array(letters, pa.string())
    assert [len(s) == 2 for s in pc.utf8_split_whitespace(pa.array([f"a{c}b" for c in letters])).to_pylist()] == [c.isspace() for c in letters]
    assert pc.match_substring_regex(table, decontam.DIGIT).to_pylist() == [bool(re.match(r"\d", c)) for c in letters]
    sure = [not o for o in pc.match_substring_regex(table, decontam.ODD).to_pylist()]
    assert [c for c, low, s in zip(letters, pc.utf8_lower(table).to_pylist(), sure, strict=True) if s and (low != c.lower() or c.isupper() and low == c)] == []
    assert pc.utf8_lower(pa.array(["ΑΣ"])).to_pylist() != ["ΑΣ".lower()] and not sure[letters.index("Σ")]


LONE_WORKERS = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.checkpoint.dir", {shared!r}).config("spark.sql.shuffle.partitions", "2").config("spark.executorEnv.PYTHONPATH", "").config("spark.ui.enabled", "false").getOrCreate()
from riskloom.llm import decontam
docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
bench = spark.createDataFrame([(7, "two three four five six seven eight nine ten")], "item_id long, text string")
print("FOUND", [tuple(r) for r in decontam.contaminated(docs, bench).select("id", "item_id").collect()])
"""


def test_workers_need_not_have_the_library(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", LONE_WORKERS.format(root=root, shared=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND [(1, 7)]" in done.stdout, done.stderr[-2000:]
