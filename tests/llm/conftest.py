import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, one of them without spaces, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))
    run = "+".join("".join(chr(97 + (i * i + 7 * j * j + i * j) % 23) for j in range(60)) for i in range(700))
    rows = [
        (1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 2), (3, " \t\n ", "en", "b", 4, "x", 3), (4, long, "de", "a", len(long), None, 4),
        (5, "one two three four five six seven", "en", None, 33, "x", 5), (5, "one two three four five six seven", "en", None, 33, "x", 5),
        (6, "one two three four five six seven", None, "b", 33, "x", 6), (7, "one", "fr", "a", 3, "x", 7), (None, "one two three four five six seven", "en", "a", 33, "x", 8), (8, "ONE two", "en", "c", 7, "y", 9),
        (9, run, "en", None, len(run), "x", 10),
    ]
    return spark.createDataFrame(rows, f"{DOCS}, kept string, component_id long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
