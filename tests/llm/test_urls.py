import itertools
import math
import random

from riskloom.llm import urls
from riskloom.llm.queries import URL_RULES


def test_host_path_and_longest_rule(spark):
    cases = {
        "http://example.com/en/x": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://WWW.Example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.example.com/en?x=/": ("a.example.com", "/en", "com/", "allow"),
        "http://notexample.net/es/": ("notexample.net", "/es/", "net/es/", "block"),
        "x://y://z.com/": ("y:", "//z.com/", None, "allow"),
        "http://com": ("com", "", None, "allow"),
        "http://É.com/?q": ("É.com", "/", "com/", "allow"),
        "http://a.com#/b": ("a.com", "", None, "allow"),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)] + [(None, "http://b.net/fr/", "x")], "page_id long, url string, host string")
    got = {r.id: tuple(r)[1:] for r in urls.judge(pages, URL_RULES).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i] == want
    assert got[None][2:] == ("net/fr/", "block")


def test_mined_rules_block(spark):
    rows = [(f"http://{'spam' if i % 3 == 0 else 'good'}{i}.example.org/{'buy' if i % 6 < 3 else 'read'}/{i}?ref=1", i % 3 == 0 and i % 6 < 3) for i in range(300)]
    mined = urls.mine(spark.createDataFrame([*rows, (None, True), ("http://x", None)], "url string, block boolean"), confidence=0.9)
    assert [(r.rule, r.blocked, r.seen) for r in mined.collect()] == [(["h:spam#", "p:buy"], 50, 50)]
    pages = spark.createDataFrame([(1, "http://spam4.other.net/buy/"), (2, "http://spam4.other.net/read"), (3, "http://fine.org/buy")], "page_id int, url string")
    assert {r.id: r.verdict for r in urls.judge(pages, [], mined).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_no_labels_no_rules(spark):
    empty = spark.createDataFrame([], "url string, block boolean")
    assert urls.mine(empty).count() == 0
    assert urls.mine(spark.createDataFrame([("http://a.b", False)], "url string, block boolean")).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id int, url string"), URL_RULES, urls.mine(empty)).count() == 0


def all_combinations(rows, least, confidence, lift, z):
    """Apriori without short cuts: every set of tokens of a blocked URL, counted over all URLs."""
    bad = [t for t, b in rows if b]
    base = len(bad) / len(rows)
    good = {}
    for items in bad:
        for k in range(1, len(items) + 1):
            for rule in map(frozenset, itertools.combinations(sorted(items), k)):
                if rule in good:
                    continue
                blocked, seen = sum(rule <= t for t in bad), sum(rule <= t for t, _ in rows)
                share = blocked / seen
                low = (share + z * z / (2 * seen) - z * math.sqrt(share * (1 - share) / seen + z * z / (4 * seen * seen))) / (1 + z * z / seen)
                good[rule] = blocked >= least and share >= confidence and low >= min(lift * base, (1 + base) / 2)
    kept = {r for r, ok in good.items() if ok}
    return {r for r in kept if not any(other < r for other in kept)}


def test_rules_match_all_combinations(spark):
    rng = random.Random(3)
    made = {}
    while len(made) < 600:
        words = rng.sample(["ab", "cd", "ef", "gh", "ij", "kl"], rng.randrange(1, 5))
        url = f"http://{words[0]}.org/{'/'.join(words[1:])}/{len(made)}"
        made[url] = ("cd" in words[1:] and "ef" in words) != (rng.random() < 0.15)
    table = spark.createDataFrame(list(made.items()), "url string, block boolean")
    items = {r.url: frozenset(r.t) for r in table.select("url", urls.tokens(table["url"]).alias("t")).collect()}
    want = all_combinations([(items[u], b) for u, b in made.items()], 20, 0.6, 1.5, 3.0)
    # tokens in the same URLs stand for one another: here that is the ending and the number
    always = {"h:org", "p:#"}
    got = {frozenset(r.rule) for r in urls.mine(table).collect()}
    assert {r - always for r in got} == {r - always for r in want} and got


def test_chance_makes_no_rules(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    rows = [(f"http://{rng.choice(words)}.{rng.choice(words)}.org/{rng.choice(words)}/{rng.choice(words)}?{rng.choice(words)}={i}", rng.random() < 0.25) for i in range(4000)]
    assert urls.mine(spark.createDataFrame(rows, "url string, block boolean")).count() == 0


def test_long_and_repeated_urls_and_clashing_columns(spark):
    long = "http://spam.org/" + "/".join(f"q{i}" for i in range(3000))
    rows = [(f"http://spam.org/{'/'.join('abcdefghijklmnopqrstuvwxyz')}/{i}", True) for i in range(40)] + [(f"http://good.org/{i}", False) for i in range(100)]
    mined = urls.mine(spark.createDataFrame(rows, "url string, block boolean"))  # 28 tokens that always stand together
    assert mined.count() == 1
    pages = spark.createDataFrame([(1, long + "/a", "x"), (1, long + "/a", "x"), (2, None, None), (3, "http://good.org/1", "x")], "page_id long, url string, verdict string").selectExpr("*", "'h' host", "1 id", "2 rule", "3 items", "4 token", "true hit")
    out = urls.judge(pages, URL_RULES, mined).collect()
    first = mined.first().rule[0]
    assert sorted((r.id, r.verdict) for r in out) == [(1, "block" if first in ("h:spam", "p:a") else "allow")] * 2 + [(2, "allow"), (3, "allow")]
