"""Line-level queries: filters, orders, neighbours, look-ups by id."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import group_key
from ..schema import CORRUPT, LUMP_SUM, has

DEFAULT_LIMIT, MAX_LIMIT = 20, 50
ORDERS = {
    "amount_desc": (F.desc_nulls_last, "amount_thb"),
    "amount_asc": (F.asc_nulls_last, "amount_thb"),
    "unit_price_desc": (F.desc_nulls_last, "unit_price_thb"),
    "unit_price_asc": (F.asc_nulls_last, "unit_price_thb"),
    "year_desc": (F.desc_nulls_last, "fiscal_year_be"),
}


def clamped(value: int | None, low: int, high: int, default: int) -> int:
    return default if value is None else max(low, min(int(value), high))


def like_escaped(part: str) -> str:
    return "%" + part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def contains_ci(column: str, part: str) -> Column:
    """Case-insensitive substring; wildcards in the part are ordinary characters."""
    return F.col(column).ilike(like_escaped(part))


@dataclass(frozen=True)
class LineFilter:
    """What lines to take: everything given must hold; a list is any of its values; ``missing`` columns must be null."""

    datasets: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    item_keys: tuple[str, ...] = ()
    ministry_codes: tuple[str, ...] = ()
    provinces: tuple[str, ...] = ()
    agency_contains: str | None = None
    keyword: str | None = None
    min_amount: int | None = None
    max_amount: int | None = None
    missing: tuple[str, ...] = ()
    exclude_flags: tuple[str, ...] = (CORRUPT, LUMP_SUM)
    keyword_columns: tuple[str, ...] = field(default=("item_name_raw", "item_key"))

    def condition(self) -> Column:
        out = F.lit(True)
        for column, values in (("dataset", self.datasets), ("fiscal_year_be", self.years), ("item_key", self.item_keys), ("ministry_code", self.ministry_codes), ("province", self.provinces)):
            out = out & F.col(column).isin(*values) if values else out
        for column, low, high in (("fiscal_year_be", self.year_from, self.year_to), ("amount_thb", self.min_amount, self.max_amount)):
            out = out & (F.col(column) >= low) if low is not None else out
            out = out & (F.col(column) <= high) if high is not None else out
        for column in self.missing:
            out = out & F.col(column).isNull()
        out = out & contains_ci("agency", self.agency_contains) if self.agency_contains else out
        if self.keyword:
            found = F.lit(False)
            for column in self.keyword_columns:
                found = found | contains_ci(column, self.keyword)
            out = out & found
        for flag in self.exclude_flags:
            out = out & ~has(flag)
        return out


def matching(lines: DataFrame, wanted: LineFilter) -> DataFrame:
    return lines.filter(wanted.condition())


def top(lines: DataFrame, wanted: LineFilter, order: str = "amount_desc", limit: int | None = None) -> DataFrame:
    """The first matching lines in an order; ties by source_id."""
    how, column = ORDERS[order]
    return matching(lines, wanted).orderBy(how(column), F.asc("source_id")).limit(clamped(limit, 1, MAX_LIMIT, DEFAULT_LIMIT))


def total(lines: DataFrame, wanted: LineFilter) -> DataFrame:
    """How many lines match, beside a limited answer."""
    return matching(lines, wanted).agg(F.count(F.lit(1)).alias("total"))


def neighbours(lines: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """For each anchor (source_id), the lines of its sheet at most ``reach`` rows away, itself included.

    Lines meet by blocks of ``reach`` + 1 rows, an anchor in its own and the two beside it: no sheet is paired as a whole.
    """
    block = F.floor(F.col("source_row") / (reach + 1))
    at = lines.join(anchors.select("source_id").distinct(), "source_id", "left_semi")
    at = at.select(F.col("source_id").alias("anchor_id"), F.col("source_path").alias("a_path"), F.col("source_sheet").alias("a_sheet"), F.col("source_row").alias("a_row"), block.alias("own")).distinct()
    at = at.select("*", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("a_block"))
    same = (F.col("source_path") == F.col("a_path")) & F.col("source_sheet").eqNullSafe(F.col("a_sheet")) & (block == F.col("a_block"))
    near = F.col("source_row").between(F.col("a_row") - reach, F.col("a_row") + reach)
    return lines.join(at, same & near).select("anchor_id", "source_id", "source_row", (F.col("source_row") - F.col("a_row")).alias("distance"))


def by_ids(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Every asked id (column source_id) with its line's columns, and whether it was found."""
    asked = ids.select("source_id").distinct()
    return asked.join(lines.withColumn("found", F.lit(True)), "source_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def key_variants(lines: DataFrame, key: str) -> DataFrame:
    """All spellings of a key that differ in white space only."""
    return lines.filter(group_key(F.col("item_key")) == group_key(F.lit(key))).select("item_key").distinct()


def narrowed(lines: DataFrame, wanted: LineFilter, most: int) -> tuple[DataFrame, str]:
    """An explicit, reported back-off for too broad a question: only the latest 3, 2 or 1 years, until at most ``most`` lines match."""
    found = matching(lines, wanted)
    if found.limit(most + 1).count() <= most:
        return found, "all"
    years = [r[0] for r in found.filter(F.col("fiscal_year_be").isNotNull()).select("fiscal_year_be").distinct().orderBy(F.desc("fiscal_year_be")).limit(3).collect()]
    for n in (3, 2, 1):
        part = found.filter(F.col("fiscal_year_be").isin(*years[:n])) if years else found.limit(0)
        if n == 1 or part.limit(most + 1).count() <= most:
            return part, f"latest {n} years"
    raise AssertionError


def price_basis() -> Column:
    return F.when(F.col("unit_price_thb").isNotNull(), "unit_price").otherwise("amount_per_line")
