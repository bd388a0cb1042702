import pytest
from pyspark.sql import functions as F

#: Names the operators use inside; tables that have them as columns must do no harm.
CLASHING = ("_id", "_bad", "_hits", "_key", "_spans", "_gone", "blob", "fp", "hits", "spans", "kept", "value", "score", "start", "length", "ids",
            "n_words", "key", "_words", "_text", "_at", "_word", "_k0", "doc", "tag", "data", "ranges", "kmers", "votes", "component_id", "u", "v")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def table(spark):
    """``table([(doc_id, text), …])``: a documents table that has many clashing columns besides."""

    def make(rows):
        df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
        return df.withColumns({c: F.lit("x") for c in CLASHING}).repartition(3, "doc_id")

    return make


@pytest.fixture
def awkward():
    """Nulls, empty and very long texts, repeated rows."""
    long = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, "a"), (6, "a"), (6, "a"), (None, "a text without an id"), (None, None),
            (7, "ÄÖ 漢字 \U0001f600 é!"), (8, "-" * 5000), (9, "z" * 70_000)]
