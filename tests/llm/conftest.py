import pytest

#: One row of each trouble: null id, null text, empty text, white space, repeats, one very long word, many words.
ROWS = [
    (1, "The cat sat on the mat. " * 12, "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, " \t\n\x0b ", "de", None),
    (None, "Der Hund läuft über die Straße, straße STRASSE.", "de", "b"),
    (None, None, None, None),
    (5, "the cat sat on the mat. " * 12, "en", "a"),
    (5, "the cat sat on the mat. " * 12, "en", "a"),
    (6, "x" * 30_000, "fr", "a"),
    (7, "uno dos tres " * 9_000, "es", "c"),
    (8, "emoji 😀  nbsp ß ẞ ﬁ İ <|endoftext|> 'tis don't 12345", "xx", "a"),
    (9, "same line here\nsame line here\nother\n\n", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


#: Extra columns with the names of every column that an operator makes on its way, and some of another kind.
CLASHES = (
    "words", "n_words", "score", "fp", "component_id", "key", "stratum", "n", "factor", "ids", "quality", "row", "root", "missing", "keys", "word", "salt_", "base_failed", "weight", "copies", "drawn", "copy", "lot", "measured",
    "__weight", "__text", "__words", "__n_words", "__score", "__fp", "__of", "__root", "__id", "__key", "__topic", "__lang", "__source", "__measured", "__factor", "__copies", "__drawn", "__copy", "__p", "__s", "__stratum", "__row", "__of_source",
)


@pytest.fixture(scope="session")
def docs(spark):
    """The rows of trouble, with extra columns whose names clash with an operator's own."""
    d = spark.createDataFrame(ROWS, SCHEMA)
    return d.selectExpr("*", *[f"1 AS `{c}`" for c in CLASHES], "7 AS topic", "length(text) AS n_chars")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, None), (9, 3, 0)], "doc_id long, quality int, toxic int")
