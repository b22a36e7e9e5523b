import pytest

#: Columns that clash with names the operators use inside.
CLASHES = "row string, fp string, h string, root string, spans string, said string, a string, place string"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text, lang, source); each further column holds ``x``."""

    def make(values, parts=3):
        full = [
            (i, t, g, s, None if t is None else len(t), *["x"] * 8) for i, t, g, s in values
        ]
        return spark.createDataFrame(full, DOCUMENTS).repartition(parts)

    return make


@pytest.fixture
def odd(documents):
    """Nulls in each column, empty and blank texts, ties, repeated rows, and a very long text."""
    long = " ".join(f"word{i % 977} the of {i}" for i in range(60_000))
    return documents([
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "s0"),
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "s0"),
        (2, "the quick brown fox jumps over the lazy dog and runs away", None, None),
        (3, None, "en", "s1"), (4, "", "en", None), (5, " \t\n ", None, "s1"), (6, "12 34 -- !!", "de", "s0"),
        (None, "ein anderer text mit ganz anderen worten als zuvor", "de", "s1"),
        (None, None, None, None), (7, long, "en", "s0"), (8, "İstanbul ſ K ñandú 漢字 🎈", "es", "s2"),
    ])


@pytest.fixture
def none(documents):
    return documents([(1, "x", "en", "s")]).where("doc_id is null")
