import hashlib
import re

from pyspark.sql import functions as F

from riskloom.llm import exact

ROWS = [(5, "a  b"), (3, "a\t\nb"), (9, "a b"), (1, None), (2, ""), (4, " "), (7, "a\xa0b"), (8, "long " * 50_000), (6, "long " * 50_000), (3, "a\t\nb"), (None, "a b"), (None, "alone")]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_matches_definition(docs):
    got = exact.exact_duplicates(docs(ROWS)).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(ROWS)
    sha = {hashlib.sha256(n.encode()).hexdigest(): n for n in groups}
    kept = {}
    for r in got:
        members = groups[sha[r.text_sha256]]
        assert r.group_size == len(members)
        assert r.keep_id == min((m for m in members if m is not None), default=None)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        if r.kept:
            assert r.id == r.keep_id
    assert set(kept.values()) == {1}  # a repeated row too stays once


def test_stage_keeps_columns(docs):
    table = docs(ROWS)
    out = exact.without_exact_duplicates(table)
    assert out.columns == table.columns
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(t) for _, t in ROWS})


def test_digests_that_texts_share_merge_nothing(docs, monkeypatch):
    """As if the digest had sixteen values: texts stay apart, in groups and in the last join."""
    plain = [sorted(map(str, f(docs(ROWS)).collect())) for f in (exact.exact_duplicates, exact.without_exact_duplicates)]
    monkeypatch.setattr(exact, "digest", lambda norm: F.substring(F.sha2(norm, 256), 1, 1))
    assert [sorted(map(str, f(docs(ROWS)).collect())) for f in (exact.exact_duplicates, exact.without_exact_duplicates)] == plain
    monkeypatch.setattr(exact, "digest", lambda norm: F.lit("same"))
    assert sorted(map(str, exact.exact_duplicates(docs(ROWS)).collect())) == plain[0]


def test_empty_table(docs):
    assert exact.exact_duplicates(docs([])).count() == 0
    assert exact.without_exact_duplicates(docs([])).count() == 0
