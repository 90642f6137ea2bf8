from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp long, score double"
#: Null and empty texts, null ids, repeated rows, ties, blanks only, other scripts, and a long text. The last columns' names clash with results.
TEXTS = [
    (1, "the cat sat on the mat", "en"),
    (1, "the cat sat on the mat", "en"),
    (2, None, "en"),
    (3, "", None),
    (None, "a row without an id", "en"),
    (4, " \t\n\x0b ", "de"),
    (5, "der Hund liegt auf der Matte und schläft", "de"),
    (6, "Привет, мир! 你好 é ß", None),
    (7, "one two three four five six seven eight nine " * 900, "en"),
    (8, "x" * 5000, "en"),
    (9, "12345 67890", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """A small table of awkward rows."""
    rows = [(i, t, lang, None, None, 9, 9, 9.0) for i, t, lang in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
