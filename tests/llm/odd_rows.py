import re

import pytest

ROWS = [
    # doc_id, text, lang, source, n_chars, and columns whose names clash with what operators add
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all today", "en", "b", 70, 9, "x"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it all today", "en", "a", 70, 9, "x"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it all today", "en", "a", 70, 9, "x"),
    (3, "The quick brown fox jumps over the lazy dog and runs away from it all tomorrow", "en", "a", 70, 9, "x"),
    (4, None, "en", None, 0, 9, "x"),
    (5, "", "en", "", 0, 9, "x"),
    (6, " \t\n ", "en", "c", 4, 9, "x"),
    (7, "one two", "de", "c", 7, 9, "x"),
    (8, "ONE two", "de", "c", 7, None, None),
    (9, "don't stop İstanbul ﬁn 12 été!!\x0bcafé\x1cbar <|endoftext|>", "fr", "b", 40, 9, "x"),
    (10, "word " * 3000, "en", "b", 15000, 9, "x"),
    (None, "lonely text without an id but with several words in it", "en", "d", 50, 9, "x"),
    (None, None, None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text, lower=True):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0d]+", text)
