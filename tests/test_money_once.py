"""Money text is cleaned once, however often its clean form is used."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import baht
from ledgerlens.functions.text import clean


@pytest.mark.parametrize("text, factor, want", [
    ("1,234.56", 1, 1235), ("(1,234.5)", 1, -1235), ("-7", 1000, -7000), ("(-7)", 1, -7), ("+ 7", 1, 7), ("๑๒.๕", 1_000_000, 12_500_000), (" .5 ", 1, 1), ("5.", 1, 5), ("", 1, None), ("1.2.3", 1, None), ("--5", 1, None), ("()", 1, None), (None, 1, None),
])
def test_money(spark, text, factor, want):
    frame = spark.createDataFrame([(text, factor)], "t string, f int")
    assert tuple(frame.select(baht(F.col("t"), factor), baht(F.col("t"), F.col("f"))).first()) == (want, want)


def test_the_text_is_cleaned_once(spark):
    times = lambda x: spark.createDataFrame([("1",)], "t string").select(x.alias("x"))._jdf.queryExecution().analyzed().toString().count("p{ASCII}")
    assert times(baht(F.col("t"))) == times(clean(F.col("t")))
