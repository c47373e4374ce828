import pytest
from pyspark.sql import types as T

LONG = "one two three. " * 20000
ODD = [
    (1, "The cat and the dog are in the house of the man.", "en", "a", 48),
    (1, "The cat and the dog are in the house of the man.", "en", "a", 48),
    (2, None, "en", "a", None),
    (3, "", "de", "b", 0),
    (None, "Words without an id, and they are here.", None, None, 39),
    (4, LONG, "xx", "c", len(LONG)),
    (5, "é", "fr", None, 1),
    (6, " \n\t ", "fr", "c", 4),
    (7, "The cat and the dog are in the house of the man.", None, "a", -5),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with the names of helpers."""
    extra = ["key", "K", "size", "id", "kept", "score", "shard", "hilbert_index", "mix_key", "again_id", "dropped_id", "fine_key", "sketch", "f0", "n_tokens", "block"]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in extra if c != "K"]
    )
    return spark.createDataFrame([(*r, *["x"] * (len(extra) - 1)) for r in ODD], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
