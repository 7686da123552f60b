"""Fiscal years and meeting dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import THAI_DIGITS, clean

ERA = "25"  # the first two digits of the years that are meant
FIRST_YEAR, LAST_YEAR = 2540, 2600
#: Years of two digits are read after a word for the budget or the year, within these; ranges are no longer than so many years.
FIRST_SHORT, LAST_SHORT, LONGEST_RANGE = 40, 79, 30
# Ends of the words that a year of two digits follows, fixed values.
YEAR_WORDS = ("งบประมาณ", "งบฯ", "งบ", "พ.ศ", "ปี")
#: Blanks, dots and colons between such a word and its year, at most.
MOST_BETWEEN = 4
# Month names and their abbreviations (dots and blanks left out), fixed values.
MONTHS = ("มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม")
SHORT_MONTHS = ("มค", "กพ", "มีค", "เมย", "พค", "มิย", "กค", "สค", "กย", "ตค", "พย", "ธค")


def numbers_in(cleaned: Column) -> Column:
    """The runs of digits of a text in order, each with the text since the one before: (gap, run)."""
    pattern = F.lit(r"(\D*)(\d+)")
    return F.transform(F.arrays_zip(F.regexp_extract_all(cleaned, pattern, F.lit(1)), F.regexp_extract_all(cleaned, pattern, F.lit(2))), lambda z: F.struct(z["0"].alias("gap"), z["1"].alias("run")))


def _era_year(four: Column) -> Column:
    return F.when((F.length(four) == 4) & four.startswith(ERA), four.cast("int"))


def _years_of_run(run: Column) -> Column:
    """Years inside a run of digits, from the left, none overlapping."""
    return F.transform(F.regexp_extract_all(run, F.lit(ERA + r"\d\d"), F.lit(0)), lambda y: y.cast("int"))


def _after_year_word(gap: Column) -> Column:
    """Whether a gap ends in a word for the year, with a few separators behind it."""
    word = F.rtrim(gap, F.lit(" .:"))
    between, out = F.length(gap) - F.length(word), F.lit(False)
    for end in YEAR_WORDS:
        own = F.substring(gap, F.length(word) + 1, F.lit(1)) == "." if "." in end else F.lit(False)  # an abbreviation's last dot is its own
        out = out | (word.endswith(end) & (between <= MOST_BETWEEN + own.cast("int")))
    return out


def fiscal_years(text: Column) -> Column:
    """Sorted distinct years of the local era that a text names: ranges as all their years, years of 4 digits, and of 2 after a word for them.

    One walk over the numbers: what is carried along is the year that a dash may make the start of a range. A year that ended one starts no other.
    """
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("years"), F.lit(None).cast("int").alias("open"))

    def step(state: Column, number: Column) -> Column:
        run, n = number["run"], F.length(number["run"])
        first, last = _era_year(F.substring(run, F.lit(1), F.least(n, F.lit(4)))), _era_year(F.right(run, F.lit(4)))
        joined = F.trim(number["gap"]).isin("-", "–") & state["open"].isNotNull() & first.isNotNull()
        span = F.when(joined & (first - state["open"]).between(0, LONGEST_RANGE), F.sequence(state["open"], first)).otherwise(none)
        short = F.when((n == 2) & run.cast("int").between(FIRST_SHORT, LAST_SHORT) & _after_year_word(number["gap"]), F.array(run.cast("int") + 2500)).otherwise(none)
        return F.struct(F.concat(state["years"], span, _years_of_run(run), short).alias("years"), F.when(joined & (n < 8), F.lit(None).cast("int")).otherwise(last).alias("open"))

    found = F.aggregate(numbers_in(clean(text)), start, step, lambda state: state["years"])
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y.between(FIRST_YEAR, LAST_YEAR))))


def targets_year(sheet: Column, year: int) -> Column:
    """Whether a sheet's name allows the year: all the years that it names are that one, or it names none."""
    return F.forall(_years_of_run(F.translate(sheet, THAI_DIGITS, "0123456789")), lambda y: y == year)


def meeting_date(folder: Column) -> Column:
    """The date of a text like "... 12 <month> 2569", in ISO form with the year of the local era; months in full or abbreviated."""
    found = numbers_in(clean(folder))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(found, lambda number: number["run"]))
    dated = F.transform(F.arrays_zip(found, before), lambda z: F.struct(F.right(z["1"], F.lit(2)).try_cast("int").alias("day"), F.translate(z["0"]["gap"], ". ", "").alias("name"), z["0"]["run"].alias("year"), z["0"]["gap"].alias("gap")))
    # The first number of four digits that another one goes before, with no bracket between them.
    date = F.get(F.filter(dated, lambda d: d["day"].isNotNull() & (F.length(d["year"]) == 4) & (F.length(d["gap"]) > 0) & ~d["gap"].rlike("[()]")), F.lit(0))
    month = F.greatest(F.array_position(F.array(*map(F.lit, MONTHS)), date["name"]), F.array_position(F.array(*map(F.lit, SHORT_MONTHS)), date["name"]))
    return F.when(month > 0, F.format_string("%04d-%02d-%02d", date["year"].cast("int"), month, date["day"]))


def meeting_number(folder: Column) -> Column:
    """The number that follows the word for the meeting's place in a row."""
    told = F.filter(numbers_in(clean(folder)), lambda number: F.rtrim(number["gap"]).endswith("ครั้งที่"))
    return F.get(told, F.lit(0))["run"].try_cast("int")
