import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with the awkward cases: nulls, empty and long texts, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000))
    texts = [(1, "The quick brown fox jumps over the lazy dog again and again until night falls"), (2, None), (3, ""), (4, "   \n\t "),
             (5, "The quick brown fox jumps over the lazy dog again and again until night falls"), (6, "one"), (6, "one"), (None, "one"),
             (7, long), (8, long + " end"), (9, "Ünïcode wörds Ünïcode wörds und \x00 nul"), (None, None), (-4, "one"), (10, "a  b\u00a0c d e f")]
    rows = [(i, t, "en", "s", 1, "x", 2.0, i) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, n double, fp long")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
