import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # Names that operators give to their own columns.
    + [T.StructField(n, T.StringType()) for n in ("size", "fp", "id", "tie", "part", "score", "shard", "copies", "kept", "n_words", "host")]
)


def _row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), *["x"] * 11)


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with everything that may be odd: nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = prose(60)
    long = prose(60_000)
    first = prose(120)
    rows = [
        _row(1, first), _row(2, first), _row(2, first), _row(3, first + " " + passage), _row(4, prose(30) + " " + passage + " " + prose(20), "de", "b"),
        _row(5, None), _row(6, ""), _row(7, " \n\t "), _row(8, "ab cd", None, None), _row(None, prose(50)), _row(None, None, None, None), _row(9, long, "de", "b"), _row(10, "x" + long[:50_000], "de", "b"),
        _row(11, "éü ñ" * 60 + passage, "fr", "c"), _row(11, prose(12)), _row(12, "la la la la la " * 20), _row(13, "a" * 500), _row(14, "line one is here\nline one is here\n\nline two ▁ x  y"), _row(15, "<s> ünï 💡 \x00 ok　end ", "fr", "c"),
        *[_row(100 + k, prose(40 + k), rng.choice(["en", "de"]), rng.choice("abc")) for k in range(30)],
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
