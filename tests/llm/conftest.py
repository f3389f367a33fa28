import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, _text string, word string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows and names that operators use themselves."""
    long = " ".join(f"word{i % 977} the" for i in range(30_000))
    plain = "The quick brown fox jumps over the lazy dog and runs away from here. " * 4
    rows = [
        (1, plain, "en", "a", 1, 0.5, 1, "x", "y"),
        (1, plain, "en", "a", 1, 0.5, 1, "x", "y"),
        (2, None, "en", "a", None, None, None, None, None),
        (3, "", None, None, 0, 0.0, 0, "", ""),
        (4, " \t\n ", "de", "b", 4, 0.0, 0, "", ""),
        (None, "lone text without an id", "en", None, 1, 0.0, 0, "", ""),
        (5, long, "en", "c", len(long), 0.0, 0, "", ""),
        (6, "x", None, "b", 1, 0.0, 0, "", ""),
        (7, "Größe über alles ñandú 日本語 😀 '", "de", "c", 1, 0.0, 0, "", ""),
        (8, plain + "Once more.", "en", "a", 1, 0.0, 0, "", ""),
        (9, "### $$$ %%% &&& 12345", None, "a", 1, 0.0, 0, "", ""),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
