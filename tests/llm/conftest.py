import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text, source) rows, with more columns that clash with results."""

    def make(rows, extra=False):
        data = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(data, DOC)
        if extra:
            from pyspark.sql import functions as F

            for name in ("fp", "size", "key", "kept", "n_words", "target", "component_id", "spans"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, "one", "a"),
    (3, "one", "a"),
    (4, "The quick brown fox jumps over the lazy dog near the river bank today", "b"),
    (5, "the QUICK brown fox jumps over the lazy dog near the river bank today", "b"),
    (None, "the quick brown fox jumps over the lazy dog near the river bank today", "b"),
    (6, "w " * 30_000, "c"),
    (7, " \t\n ", "c"),
    (8, "é 漢字 🙂 " * 50, None),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
