import pytest

#: Nulls, empty and long texts, ties, repeated rows, marks that only some normal forms keep.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it."),
    (2, "The quick  brown fox\tjumps over the lazy dog and runs away from it."),
    (3, "The quick brown fox jumps over the lazy dog and runs away from them."),
    (4, None),
    (5, ""),
    (6, "   \n\t "),
    (7, " "),
    (8, "one two three"),
    (9, "ONE two three"),
    (10, "I'll we've <|endoftext|> it's 42 x² ÅΣΣ Σ a\u0301b \u200b\u3000 c ß"),
    (11, "word " * 30_000),
    (12, "long" * 5_000),
    (13, "Some text.\nReleased under the MIT License.\nmore text"),
    (13, "Some text.\nReleased under the MIT License.\nmore text"),
    (None, "no identifier here at all"),
    (None, "one two three"),
    (14, "This work is licensed under the GNU General Public License, version 3."),
    (15, "The driver license is valid under the law of the land."),
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """Text rows with columns whose names the operators use inside."""
    rows = [(i, t, "en", float(k), k, "x") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, digest long, fp string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
