import pytest

# Texts every operator must stand: null, empty, white space, one word, repeated rows, ties, unusual characters, a very long one.
ODD = [None, "", " \t\n ", "word", "word", "Zwei Wörter", "日本語 テキスト 🙂", "a b c d e f g h " * 3000, "x" * 30_000]


@pytest.fixture
def odd_docs(spark):
    """Odd texts, with columns whose names clash with what operators add."""
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", True, 7, "old") for i, t in enumerate(ODD)] + [(4, "word", "en", "s0", True, 7, "old")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept boolean, n_tokens int, copies string")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
