"""Exact percentiles by group, of whole numbers, where one group may hold most of the rows.

Rows are counted by (group, value) first. Where the input is small, a group's distinct values meet in one aggregate: they can't be more than
the input's bytes. Beyond ``RANGED_FROM`` bytes counts are summed by ranges of values: ``PARTS`` to each doubling, at most some
1,000 of either sign to a group, whatever it holds. The running sums of these tell in which range a rank lies; only the values of these few
ranges are put in order, range by range, to find the value. So no task meets more of a group than its ranges or the values of one
range, and what is ordered can spill. Nothing is estimated: both ways give the same numbers, the choice is one of work only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 16
RANGED_FROM = 256 << 20


def value_counts(rows: DataFrame, keys: tuple[str, ...], values: dict[str, Column]) -> DataFrame:
    """keys, kind, value, n: how often each value of each named column occurs in a group; nulls don't count."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("value")) for kind, value in values.items()])
    long = rows.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*").filter(F.col("value").isNotNull())
    return long.groupBy(*keys, "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def range_of(value: Column) -> Column:
    """The number of a value's range; it never falls where values grow."""
    size = F.floor(F.log2(F.abs(value.cast("double")) + 1) * PARTS).cast("int")
    return F.when(value < 0, -size).otherwise(size)


def large_input(rows: DataFrame) -> bool:
    """Whether the files that ``rows`` come from hold RANGED_FROM bytes or more; looks at no more files than it takes to know."""
    spark, size = rows.sparkSession, 0
    for name in rows.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))  # names come encoded
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if size >= RANGED_FROM:
            return True
    return False


def spread(counts: DataFrame, keys: tuple[str, ...], shares: tuple[float, ...], ranged: bool | None = None) -> DataFrame:
    """keys, n, n_distinct, low, high and ``p``, the percentiles (between two values: in proportion), of counts (keys, value, n). Keys are not null."""
    if not (large_input(counts) if ranged is None else ranged):
        told = F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.min("value").alias("low"), F.max("value").alias("high")
        return counts.groupBy(*keys).agg(*told, F.percentile("value", F.array(*map(F.lit, shares)), F.col("n")).alias("p"))
    # Dealt by group and range once: sums, look-up and order within a range need no further exchange.
    by_range = counts.select(*keys, "value", "n", range_of(F.col("value")).alias("range")).repartition(*keys, "range")
    whole = Window.partitionBy(*keys)
    sums = by_range.groupBy(*keys, "range").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.min("value").alias("low"), F.max("value").alias("high"))
    told = sums.select(
        *keys, "range", "n", F.sum("n").over(whole.orderBy("range")).alias("upto"), F.sum("n").over(whole).alias("total"), F.sum("d").over(whole).alias("n_distinct"),
        F.min("low").over(whole).alias("low"), F.max("high").over(whole).alias("high"),
    )
    places = [F.lit(share) * (F.col("total") - 1) for share in shares]
    ranks = [(F.floor(place), F.ceil(place)) for place in places]
    holds = lambda rank: (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))
    any_rank = F.lit(False)
    for pair in ranks:
        any_rank = any_rank | holds(pair[0]) | holds(pair[1])
    picked = told.filter(any_rank).select(*keys, "range", (F.col("upto") - F.col("n")).alias("before"), "total", "n_distinct", "low", "high")
    inside = by_range.join(picked, [*keys, "range"])
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "range").orderBy("value")))
    ends = [F.max(F.when(holds(rank), F.col("value"))).alias(f"__{k}{end}") for k, pair in enumerate(ranks) for end, rank in zip("ab", pair, strict=True)]
    found = inside.groupBy(*keys).agg(F.max("total").alias("total"), F.max("n_distinct").alias("n_distinct"), F.max("low").alias("low"), F.max("high").alias("high"), *ends)

    def between(k: int) -> Column:
        a, b, place = F.col(f"__{k}a"), F.col(f"__{k}b"), places[k]
        return F.when(a == b, a.cast("double")).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b)

    return found.select(*keys, F.col("total").alias("n"), "n_distinct", "low", "high", F.array(*[between(k) for k in range(len(shares))]).alias("p"))
