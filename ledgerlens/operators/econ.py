"""Economic indicators: series, look-ups, adjustment of amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_away

MIN_POINTS = 3


def points(records: DataFrame) -> DataFrame:
    """indicator, unit, year_be, value: each indicator in its commonest unit (ties: the larger name), if it has points enough.

    ``records``: indicator, unit, year_be, value.
    """
    given = records.filter(F.col("value").isNotNull())
    units = given.groupBy("indicator", "unit").agg(F.count(F.lit(1)).alias("n"))
    best = units.withColumn("rn", F.row_number().over(Window.partitionBy("indicator").orderBy(F.desc("n"), F.desc("unit"))))
    kept = best.filter((F.col("rn") == 1) & (F.col("n") >= MIN_POINTS)).select("indicator", "unit")
    return given.join(kept, ["indicator", "unit"]).select("indicator", "unit", "year_be", "value")


def series(found: DataFrame) -> DataFrame:
    return found.groupBy("indicator", "unit").agg(F.array_sort(F.collect_list(F.struct("year_be", "value"))).alias("points"))


def lookup(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Every asked (indicator, year_be) with its value or null and a note. Nothing is interpolated."""
    hit = asked.join(found.select("indicator", "year_be", "unit", "value"), ["indicator", "year_be"], "left")
    return hit.withColumn("note", F.when(F.col("value").isNull(), "no data for this year"))


def adjust(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Amounts carried from one year's index to another's.

    ``requests``: request_id, amount_thb, indicator, from_year, to_year, allow_latest. The result adds to_year_used,
    factor (6 places), adjusted_thb, status, nearest_year. Only the target year may fall back to the latest one;
    where a year is missing, the nearest available one is named (ties: the earlier), and nothing computed.
    """
    at = found.select("indicator", F.col("year_be").alias("y"), F.col("value").alias("v"))
    latest = found.groupBy("indicator").agg(F.max("year_be").alias("last_year"), F.max_by("value", "year_be").alias("last_value"))
    base = requests.join(at.select("indicator", F.col("y").alias("from_year"), F.col("v").alias("from_value")), ["indicator", "from_year"], "left")
    both = base.join(at.select("indicator", F.col("y").alias("to_year"), F.col("v").alias("to_value")), ["indicator", "to_year"], "left").join(latest, "indicator", "left")
    fallback = F.col("to_value").isNull() & F.col("allow_latest") & F.col("last_year").isNotNull()
    target = F.when(fallback, F.col("last_value")).otherwise(F.col("to_value"))
    missing = F.when(F.col("from_value").isNull(), F.col("from_year")).when(target.isNull(), F.col("to_year"))
    both = both.withColumns({"__missing": missing, "factor": round_half_away(target / F.col("from_value"), 6), "to_year_used": F.when(fallback, F.col("last_year")).otherwise(F.col("to_year"))})
    lost = both.filter(F.col("__missing").isNotNull()).select("request_id", "indicator", "__missing")
    near = lost.join(at, "indicator").groupBy("request_id").agg(F.min_by("y", F.struct(F.abs(F.col("y") - F.col("__missing")), "y")).alias("nearest_year"))
    out = both.join(near, "request_id", "left")
    ok = F.col("__missing").isNull()
    status = F.when(F.col("from_value").isNull(), "from_year_missing").when(target.isNull(), "to_year_missing").when(fallback, "latest_used").otherwise("ok")
    return out.select("request_id", F.when(ok, F.col("to_year_used")).alias("to_year_used"), F.when(ok, F.col("factor")).alias("factor"),
                      F.when(ok, round_half_away(F.col("amount_thb") * F.col("factor"), 0).cast("long")).alias("adjusted_thb"), status.alias("status"), "nearest_year")


def token_cost(usage: DataFrame, prices: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Cost by model: the sum of tokens of each kind times its price for a million. ``usage``: model, kind, tokens; ``prices``: model, kind, price."""
    return usage.join(prices, ["model", "kind"]).groupBy("model").agg((F.sum(F.col("tokens") * F.col("price")) / 1e6 * multiplier).alias("cost"))
