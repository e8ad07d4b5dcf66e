"""Small document tables with every awkward case in them."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with those
    that operators use inside."""
    def make(pairs, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in pairs], DOCS)
        if extra:
            for name in ("key", "ids", "score", "kept", "words", "v", "set_id", "text_hash", "hits", "base", "tie", "page", "n_words", "window"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df
    return make


@pytest.fixture(scope="session")
def awkward():
    """Null and empty texts, null and repeated ids, repeated rows, a very long text."""
    return [(1, "The quick brown fox jumps over the lazy dog and runs away"), (1, "The quick brown fox jumps over the lazy dog and runs away"),
            (2, None), (3, ""), (None, "Some text without any id at all"), (None, None), (4, LONG), (5, "one"), (5, "another text under the same id"),
            (6, " \n\t "), (7, "Ünïcödé 漢字 🙂 ﬁ ▁  text"), (8, "x" * 20000)]
