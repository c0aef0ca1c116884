import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=()):
        """rows: (doc_id, text[, lang[, source]]); extra: names of further null columns."""
        full = [(*r, *[None] * (4 - len(r)), None, *[None] * len(extra)) for r in rows]
        schema = T.StructType([*DOCS.fields, *[T.StructField(c, T.StringType()) for c in extra]])
        return spark.createDataFrame(full, schema).repartition(4)

    return make


@pytest.fixture()
def rng():
    return random.Random(20240701)


#: Rows with nulls, empty and very long texts, ties and repeated rows.
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, "12 34 5678 ...", "en", "a"),
       (5, "word " * 60_000, "en", "b"), (6, "same text here for all of them", "en", "a"),
       (7, "same text here for all of them", None, "b"), (7, "same text here for all of them", None, "b"),
       (None, "same text here for all of them", "en", "a"), (None, None, None, None), (9, "é" * 300 + "\x00\x01", "fr", "a")]


@pytest.fixture()
def odd_rows():
    return list(ODD)


#: Column names that operators use themselves.
CLASHING = ("keep_id", "kept", "text_sha256", "sid", "token", "size", "target", "taken", "score", "item_id", "place", "n")


@pytest.fixture()
def clashing():
    return CLASHING
