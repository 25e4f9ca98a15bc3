import pytest
from pyspark.sql import types as T

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Build a documents table from (id, text) pairs; ids and texts may be null or repeat."""

    def build(pairs, source=lambda i: "s"):
        rows = [(i, t, "en", source(i), None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOC_SCHEMA)

    return build


@pytest.fixture(scope="session")
def clashing(spark):
    """A table whose extra columns have the names that operators use inside, dots and a struct."""

    def build(pairs):
        schema = T.StructType(
            [
                T.StructField("doc_id", T.LongType()),
                T.StructField("text", T.StringType()),
                T.StructField("score", T.StringType()),
                T.StructField("a.b", T.StringType()),
                T.StructField("n_words", T.StringType()),
                T.StructField("source", T.StringType()),
            ]
        )
        return spark.createDataFrame([(i, t, "own", "dot", "w", None) for i, t in pairs], schema)

    return build


LONG = "word other third " * 20_000
EDGES = [(1, None), (2, ""), (None, "no id here at all"), (4, LONG), (5, "same text twice"), (5, "same text twice"), (6, " \n\t ")]


@pytest.fixture(scope="session")
def edges():
    return EDGES
