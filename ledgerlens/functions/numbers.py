"""Rounding, tolerances and money text. Three roundings coexist; each has its own name here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

_MONEY = "decimal(38,10)"


def round_half_even(x: Column, places: int = 0) -> Column:
    """For statistics and computed unit prices."""
    return F.bround(x, places)


def round_half_away(x: Column, places: int = 0) -> Column:
    """For money text, index factors and change percentages."""
    return F.round(x, places)


def baht(text: Column, factor: int | Column = 1) -> Column:
    """Money text as whole baht; null for blanks and what isn't a number.

    Commas and spaces go, local digits count, brackets or a minus sign make it negative. ``factor``: baht in the unit of the text, a number or a column.
    """

    def signed(plain: Column) -> Column:
        bracketed = plain.rlike(r"^\(.*\)$")
        inner = F.trim(F.when(bracketed, F.regexp_replace(plain, r"^\(|\)$", "")).otherwise(plain))
        minus = inner.startswith("-")
        digits = F.regexp_replace(F.regexp_replace(inner, r"^[-+]", ""), "[, ]", "")
        number = F.when(digits.rlike(r"^(\d+(\.\d*)?|\.\d+)$"), digits).try_cast(_MONEY)
        return F.when(bracketed != minus, -number).when(bracketed & minus, -number).otherwise(number)

    # As the one element of an array the clean text has a name: written out, it would be cleaned anew wherever it is used.
    # Plain digits and the dash for nothing are most of what sheets hold: these need none of it.
    value = F.when(text.rlike(r"^[0-9]+(\.[0-9]*)?$"), text.try_cast(_MONEY)).when(text != "-", F.get(F.transform(F.array(clean(text)), signed), F.lit(0)))
    return round_half_away(value * F.lit(factor).cast("decimal(10,0)")).cast("long")


def within(value: Column, expected: Column, share: float = 0.0001, least: float = 1000) -> Column:
    """Whether a value reconciles: within the larger of a share of what is expected and a fixed sum. Nothing expected: yes."""
    return expected.isNull() | (F.abs(value - expected) <= F.greatest(F.abs(expected) * share, F.lit(float(least))))


def percentage(part: Column, whole: Column, places: int = 2) -> Column:
    """100 * part / whole, 0 where there is nothing."""
    return round_half_away(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), places)


def rate(part: Column, whole: Column) -> Column:
    """part / whole; null where whole is null or 0."""
    return F.when(whole != 0, part / whole)


def in_range(value: Column, low: Column, high: Column, share: float) -> Column:
    return (value >= low * (1 - share)) & (value <= high * (1 + share))
