import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, mix_order int, rank_ int, row string, f0 double, t string, block string, component_id string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, repeated rows, ties, clashing column names."""
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 8
    rows = [
        (1, base, "en", "a", 1),
        (2, None, "en", "a", None),
        (3, "", "de", None, 0),
        (4, long, "en", "b", len(long)),
        (5, long + " tail", None, "b", 5),
        (6, base, "en", "a", 1),
        (7, "x", "fr", "c", 1),
        (7, "x", "fr", "c", 1),
        (None, "no id at all here", "en", None, None),
        (None, None, None, None, None),
        (9, "\n\n \t\x0b\x0c\r ", "es", "a", 6),
        (10, "ÄÖÜ naïve \u00a0 \u2028 text’s 日本語 \x1c end", "de", "c", 7),
        (11, "y" * 200_000, "en", "c", 8),
        (12, "x", "fr", "c", 1),
    ]
    return [(*r, "k", 1, 2, "row", 0.5, "t", "b", "c") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
