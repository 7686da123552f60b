"""Price trends by group key and fiscal year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_away, round_half_even
from ..schema import usable_amount, usable_price
from . import quantiles

MIN_YEARS = 3
MIN_PRICES = 3
#: A year whose source is known to be incomplete.
INCOMPLETE_YEAR = 2562
SHOWN_POINTS = 10
BY_PRICE, BY_AMOUNT = "unit_price_per_line", "amount_per_line"


def points(lines: DataFrame) -> DataFrame:
    """group_key, year_be and the year's statistics of unit prices and of amounts. ``lines``: of catalog.grouped_lines."""
    dated = lines.filter(F.col("fiscal_year_be").isNotNull()).withColumn("year_be", F.col("fiscal_year_be"))
    keys, values = ("group_key", "year_be"), {"up": F.when(usable_price(), F.col("unit_price_thb")), "amt": F.when(usable_amount(), F.col("amount_thb"))}
    told = quantiles.spread(quantiles.value_counts(dated, keys, values), (*keys, "kind"), (0.25, 0.5, 0.75))
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    part = lambda k: round_half_even(F.col("p")[k]).cast("long")
    return told.groupBy(*keys).agg(
        of("up", F.col("n")).alias("up_n"), *[of("up", part(k)).alias(n) for k, n in enumerate(("up_p25", "up_median", "up_p75"))],
        of("amt", F.col("n")).alias("amt_n"), of("amt", part(1)).alias("amt_median"),
    )


def with_basis(found: DataFrame) -> DataFrame:
    """Each point with its series' basis; series of fewer than MIN_YEARS usable years go. Unit prices win ties."""
    series = Window.partitionBy("group_key")
    by_price, by_amount = F.coalesce(F.col("up_n") >= MIN_PRICES, F.lit(False)), F.coalesce(F.col("amt_n") >= 1, F.lit(False))
    up_years, amt_years = F.count_if(by_price).over(series), F.count_if(by_amount).over(series)
    counted = found.withColumns({"up_years": up_years, "amt_years": amt_years})
    counted = counted.withColumn("basis", F.when(F.col("up_years") >= F.col("amt_years"), BY_PRICE).otherwise(BY_AMOUNT))
    priced = F.col("basis") == BY_PRICE
    chosen = counted.filter((F.greatest("up_years", "amt_years") >= MIN_YEARS) & F.when(priced, by_price).otherwise(by_amount))
    return chosen.select(
        "group_key", "basis", "year_be", F.when(priced, F.col("up_n")).otherwise(F.col("amt_n")).alias("n"), F.when(priced, F.col("up_median")).otherwise(F.col("amt_median")).alias("median"),
        F.when(priced, F.col("up_p25")).alias("p25"), F.when(priced, F.col("up_p75")).alias("p75"), F.when(F.col("year_be") == INCOMPLETE_YEAR, "source_incomplete").alias("note"),
    )


def series(chosen: DataFrame) -> DataFrame:
    """group_key, basis, points in order of years."""
    point = F.struct("year_be", "n", "median", "p25", "p75", "note")
    return chosen.groupBy("group_key", "basis").agg(F.array_sort(F.collect_list(point)).alias("points"))


def change(chosen: DataFrame, value: str = "median", least: int = MIN_PRICES) -> DataFrame:
    """Change in percent from the first to the last of a series' shown points that rest on enough lines."""
    latest = Window.partitionBy("group_key").orderBy(F.desc("year_be"))
    shown = chosen.withColumn("__back", F.row_number().over(latest)).filter((F.col("__back") <= SHOWN_POINTS) & (F.col("n") >= least))
    ends = shown.groupBy("group_key").agg(F.min_by(value, "year_be").alias("first_value"), F.max_by(value, "year_be").alias("last_value"), F.min("year_be").alias("first_year"), F.max("year_be").alias("last_year"), F.count(F.lit(1)).alias("n_points"))
    moved = round_half_away((F.col("last_value") - F.col("first_value")) * 100.0 / F.col("first_value"), 2)
    return ends.withColumn("change_pct", F.when((F.col("n_points") > 1) & (F.col("first_value") > 0), moved))


def year_runs(chosen: DataFrame) -> DataFrame:
    """Runs of consecutive years in a series: group_key, from_year, to_year."""
    place = F.row_number().over(Window.partitionBy("group_key").orderBy("year_be"))
    runs = chosen.withColumn("__run", F.col("year_be") - place)
    return runs.groupBy("group_key", "__run").agg(F.min("year_be").alias("from_year"), F.max("year_be").alias("to_year")).drop("__run")
