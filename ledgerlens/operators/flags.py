"""Cross-row flags: price outliers per key, lump sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CORRUPT, LUMP_SUM, LUMP_SUM_PHRASE, PRICE_OUTLIER, lacks
from . import quantiles

#: A unit price is an outlier above this many times its key's 99.5th percentile.
OUTLIER_FACTOR = 10
OUTLIER_SHARE = 0.995


def outlier_thresholds(lines: DataFrame, skip_corrupt: bool = True) -> DataFrame:
    """item_key, threshold: exact percentile of positive prices. The validation report's own form keeps corrupt rows."""
    priced = lines.filter(F.col("item_key").isNotNull() & (F.col("unit_price_thb") > 0))
    priced = priced.filter(lacks(CORRUPT)) if skip_corrupt else priced
    counted = quantiles.value_counts(priced, ("item_key",), {"up": F.col("unit_price_thb")}).drop("kind")
    return quantiles.spread(counted, ("item_key",), (OUTLIER_SHARE,)).select("item_key", (F.col("p")[0] * OUTLIER_FACTOR).alias("threshold"))


def flag_lines(lines: DataFrame, phrase: str = LUMP_SUM_PHRASE, thresholds: DataFrame | None = None) -> DataFrame:
    """The lines with ``unit_price_outlier`` and ``lump_sum_category`` added to their flags. Null flags become a list.

    ``thresholds``: of outlier_thresholds, where they are written already. Spark knows the size of those, so that it need not
    shuffle and sort all lines by their keys, many of which are hot.
    """
    joined = lines.join(outlier_thresholds(lines) if thresholds is None else thresholds, "item_key", "left")

    def flag(condition, name: str):
        return F.when(condition, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    outlier = F.coalesce(F.col("unit_price_thb") > F.col("threshold"), F.lit(False))
    lump = F.coalesce(F.col("item_name_raw").contains(phrase), F.lit(False))
    flags = F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), flag(outlier, PRICE_OUTLIER), flag(lump, LUMP_SUM))
    return joined.withColumn("quality_flags", flags).drop("threshold").select(*lines.columns)
