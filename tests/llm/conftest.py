import random

import pytest
from pyspark.sql import functions as F

#: Columns besides id, text and source, named like what the operators add.
CLASH = ("n_words", "items", "kept", "size", "value", "start", "row__", "id", "quality", "f")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and blank texts, repeated rows, copies, a very long text, clashing columns."""
    rng = random.Random(3)
    words = ["w%d" % rng.randrange(4000) for _ in range(30_000)]
    body = " ".join("k%d" % k for k in range(120)) + "."
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t\r\n", None), (4, "one", "b"), (5, " ".join(words), "b"), (6, body, "a"), (6, body, "a"), (7, body, None), (8, "Łódź żółć " * 40, "c"), (9, "x\n\nx\nx\n", "c"), (None, body, "a"), (10, "a" * 5000, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return frame.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), **{c: F.lit("clash") for c in CLASH}})


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.filter("false")
