import pytest


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows of documents from (doc_id, text) or (doc_id, text, source), with columns that clash with inner names."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        made = spark.createDataFrame(full, DOCS)
        for extra in ("h", "id", "t", "key", "taken", "__h", "digest", "size"):
            made = made.selectExpr("*", f"concat('x', doc_id) as {extra}")
        return made

    return make
