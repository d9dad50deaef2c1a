import pytest

LONG = " ".join(f"w{i % 997}x{i * i % 89}" for i in range(30_000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog, twice. " * 3,
    "The quick brown fox jumps over the lazy dog, twice. " * 3,
    "", " \t\n ", None, None, "a", "é中 \U0001f600 naïve café\n\n  two  spaces\r\nend ", LONG, LONG, "!!! ??? ###", "x" * 5000,
]
CLASH = ["id", "fp", "d", "t", "h", "row", "size", "start", "place", "part", "edge", "k", "n", "_s", "_t", "_d", "_v0", "_w", "_l", "_text", "n_words", "kept", "position", "target", "ids", "section", "score", "u", "v"]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, very long and repeated texts, ties in ids, null columns, and extra columns with clashing names."""
    rows = [(i if i != 5 else None, t, "en" if i % 2 else None, "s" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (3, "other text under an id that is taken", "en", "s", 36), rows[4]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return docs.orderBy("doc_id").collect()
