import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, schema="doc_id long, text string, source string"):
        return spark.createDataFrame([(*r, None)[:3] if len(r) < 3 else r for r in rows], schema)

    return make


AWKWARD = [
    (1, "the cat sat on the mat and looked at the dog for a very long time indeed"),
    (1, "the cat sat on the mat and looked at the dog for a very long time indeed"),
    (2, None),
    (3, ""),
    (4, " \t\r\n\x0b\x0c "),
    (None, "the cat sat on the mat and looked at the dog for a very long time indeed"),
    (None, None),
    (5, "The Cat sat on the mat and looked at the dog for a very long time indeed"),
    (6, "é 字 \x00 <|im_end|> <|endoftext|> 'tis odd text"),
    (7, "word " * 30_000),
    (8, "x"),
]


@pytest.fixture(scope="session")
def awkward(documents):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, and columns that clash."""
    from pyspark.sql import functions as F

    docs = documents(AWKWARD)
    clashing = ("kept", "score", "size", "target", "row", "node", "bucket", "label", "n_words", "part", "_id", "a", "b", "key", "value")
    return docs.withColumns({c: F.lit("clash") for c in clashing})
