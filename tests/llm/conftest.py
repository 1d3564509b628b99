import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def hard():
    """Texts with every awkward feature: null, empty, no words, one word, odd spaces, long, copies, near copies."""
    words = [f"w{(i * 7919) % 613}" for i in range(900)]
    long = " ".join(words)
    near = " ".join(words[:450] + ["changed"] + words[451:])
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "two  words \n\n"), (5, long), (6, long), (7, near), (8, "x" * 5000),
        (9, "é ▁ 漢字 <|endoftext|> it's\n é ▁ 漢字"), (10, "same line here\nsame line here\nother"), (11, "same line here"),
        (12, "Ab aB " * 300), (13, long[:1000] + " tail " + long[2000:3000]), (14, "one"), (None, "no id one two three"),
    ]
