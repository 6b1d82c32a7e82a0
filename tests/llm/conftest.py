"""Small tables with every awkward case."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows."""
    passage = "a passage that stands in more than one document, well over fifty bytes long, and says little"
    rows = [
        (1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, "  \t\n"), (None, "one two three four five six"), (None, None),
        (5, passage), (6, f"before {passage} after"), (7, f"{passage} {passage}"), (8, "x" * 70_000), (9, "é日本語 🎉 " * 40), (10, "word " * 30_000), (12, f"BEFORE {passage.upper()}"),
    ]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Extra columns with names that operators might use themselves."""
    from pyspark.sql import functions as F

    return awkward.withColumns({c: F.lit(i) for i, c in enumerate(["part", "size", "shard", "fp", "chunk", "p", "rate", "term", "tree", "ids", "body", "told"])})
