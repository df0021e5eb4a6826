import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source)."""

    def make(*rows, lang="en"):
        full = [(r[0], r[1], lang, r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def vectors(spark):
    def make(*rows):
        return spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those the operators use."""
    from pyspark.sql import functions as F

    long = "word " * 30_000
    rows = docs((1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, None), (4, long), (5, "\t\n "), (6, "only", None))
    return rows.withColumns({c: F.lit(9) for c in ("row", "fp", "key", "copy", "size", "shard", "count", "ids", "start", "score", "part", "spans", "value", "component")})
