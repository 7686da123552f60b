"""Reconciliation and data-quality checks. Each gives rows that a report counts; none stops a run by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percentage, within

MONEY = ("amount_thb", "unit_price_thb", "revised_thb", "po_thb", "disbursed_thb", "disbursed_incl_po_thb", "reserved_thb", "carryover_thb")


def duplicate_ids(lines: DataFrame, examples: int = 20) -> DataFrame:
    """By dataset: how many ids are there more than once; and the smallest of them."""
    twice = lines.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    first = twice.withColumn("rn", F.row_number().over(Window.partitionBy("dataset").orderBy("source_id"))).filter(F.col("rn") <= examples)
    listed = first.groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_list("source_id")), ",").alias("examples"))
    return twice.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_duplicated")).join(listed, "dataset")


def missing_documents(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """source_doc_id, n: documents that lines name and the dimension lacks."""
    named = lines.filter(F.col("source_doc_id").isNotNull()).groupBy("source_doc_id").agg(F.count(F.lit(1)).alias("n"))
    return named.join(documents.select(F.col("doc_id").alias("source_doc_id")).distinct(), "source_doc_id", "left_anti")


def years_out_of_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    bad = F.col("fiscal_year_be").isNull() | ~F.col("fiscal_year_be").between(first, last)
    return lines.groupBy("dataset").agg(F.count_if(bad).alias("n_bad"), F.min("fiscal_year_be").alias("first_year"), F.max("fiscal_year_be").alias("last_year"))


def column_totals(lines: DataFrame, columns: tuple[str, ...] = MONEY, mask: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    value = (lambda c: F.col(c)) if mask is None else (lambda c: F.when(mask, F.col(c)))
    return lines.groupBy(*by).agg(*[F.sum(value(c)).alias(c) for c in columns])


def sums_by(lines: DataFrame, *by: str) -> DataFrame:
    """Amounts by columns, whole and split by capital spending."""
    capital = F.col("is_capital")
    return lines.groupBy(*by).agg(F.sum("amount_thb").alias("amount"), F.sum(F.when(capital, F.col("amount_thb"))).alias("capital"), F.sum(F.when(~capital, F.col("amount_thb"))).alias("current"))


def reconciled(sums: DataFrame, printed: DataFrame, keys: tuple[str, ...], share: float = 0.0001, least: float = 1.0) -> DataFrame:
    """All keys of both sides, nulls being a key too: sum, printed total, whether they agree."""
    right = printed.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("total").alias("printed"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    left = sums.withColumn("__l", F.lit(True))
    right = right.withColumn("__r", F.lit(True))
    both = left.join(right, on, "full")
    key = [F.when(F.col("__l"), F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in keys]
    got = F.coalesce("total", F.lit(0))
    return both.select(*key, got.alias("total"), "printed", (F.col("__l").isNotNull() & within(got, F.col("printed"), share, least)).alias("ok"))


def field_coverage(lines: DataFrame, columns: tuple[str, ...], by: str = "dataset") -> DataFrame:
    """Share of non-null values in percent."""
    return lines.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[percentage(F.count(c), F.count(F.lit(1))).alias(f"{c}_pct") for c in columns])


def containment(part: DataFrame, whole: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """How many rows of ``part`` have an equal in ``whole``; null equals null."""
    known = whole.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    hits = part.join(known, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_semi")
    counted = part.agg(F.count(F.lit(1)).alias("n_part")).withColumn("k", F.lit(1)).join(hits.agg(F.count(F.lit(1)).alias("n_contained")).withColumn("k", F.lit(1)), "k").drop("k")
    return counted.withColumn("pct", percentage(F.col("n_contained"), F.col("n_part")))


def absent_years(lines: DataFrame, key: str = "ministry_code") -> DataFrame:
    """key, year: the key has lines in the year before and the year after, but none in it."""
    seen = lines.filter(F.col(key).isNotNull() & F.col("fiscal_year_be").isNotNull()).select(key, "fiscal_year_be").distinct()
    after = F.lead("fiscal_year_be").over(Window.partitionBy(key).orderBy("fiscal_year_be"))
    gaps = seen.withColumn("next", after).filter(F.col("next") == F.col("fiscal_year_be") + 2)
    return gaps.select(key, (F.col("fiscal_year_be") + 1).cast("int").alias("year_be"))


def year_coverage(sums: DataFrame, expected: DataFrame, key: str = "ministry_code") -> DataFrame:
    """Sums by key and year beside those expected; rows of either side stay, with a status."""
    both = sums.join(expected.withColumnRenamed("amount", "expected"), [key, "year_be"], "full")
    status = F.when(F.col("amount").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(within(F.col("amount"), F.col("expected")), "ok").otherwise("differs")
    return both.withColumn("status", status)


def resolve_status(found: DataFrame, known: DataFrame, key: str, tolerance: float = 0.5) -> DataFrame:
    """Deviations in percent against known gaps: ok, known gap (within half a point of what was recorded), or new."""
    joined = found.join(known.select(key, F.col("pct").alias("known_pct")), key, "left")
    status = F.when(F.col("ok"), "ok").when(F.abs(F.col("pct") - F.col("known_pct")) <= tolerance, "known_gap").otherwise("new")
    return joined.withColumn("status", status)


def price_outliers(lines: DataFrame, thresholds: DataFrame, top: int = 15) -> DataFrame:
    """The dearest lines above their key's threshold."""
    hits = lines.join(thresholds, "item_key").filter(F.col("unit_price_thb") > F.col("threshold"))
    return hits.orderBy(F.desc("unit_price_thb"), "source_id").limit(top).select("source_id", "item_key", "unit_price_thb")
