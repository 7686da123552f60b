"""The price catalogue: one entry for each group key, with statistics, variants, names, agencies and samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_even
from ..functions.text import group_key
from ..schema import countable, usable_amount, usable_price
from . import quantiles

MAX_VARIANTS = 12
TOP_AGENCIES = 3
SAMPLES = 3
#: A key of at most this many characters, or a price spread of at least this factor, says little.
SHORT_KEY, WIDE_SPREAD = 12, 8


@dataclass(frozen=True)
class Thresholds:
    """An entry needs one of: so many lines, years, or distinct unit prices."""

    lines: int = 5
    years: int = 3
    prices: int = 2

    def raised(self) -> Thresholds:
        return Thresholds(self.lines + 1, self.years + 1, self.prices)

    def met(self) -> Column:
        return (F.col("n_lines") >= self.lines) | (F.col("n_years") >= self.years) | (F.col("n_unit_prices") >= self.prices)


def grouped_lines(flagged: DataFrame) -> DataFrame:
    return flagged.filter(countable()).withColumn("group_key", group_key(F.col("item_key")))


def eligibility(lines: DataFrame) -> DataFrame:
    """group_key, n_lines, n_years, years, n_unit_prices. ``lines``: of grouped_lines."""
    return lines.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct("fiscal_year_be").alias("n_years"),
        F.array_sort(F.collect_set("fiscal_year_be")).alias("years"), F.countDistinct(F.when(usable_price(), F.col("unit_price_thb"))).alias("n_unit_prices"),
    )


def adaptive_eligibility(counts: DataFrame, most_entries: int = 150_000, most_bytes: float = 8e6, packed: float = 1.0, start: Thresholds = Thresholds(), rounds: int = 10) -> tuple[DataFrame, Thresholds]:
    """Raises the thresholds until the catalogue is small enough in entries and in bytes.

    ``counts``: of ``eligibility``, or ``entries`` for their true size; a row counts with the bytes of its JSON times
    ``packed``, the share that compression leaves. All rounds are counted in one pass.
    """
    steps = [start]
    for _ in range(rounds):
        steps.append(steps[-1].raised())
    size = F.octet_length(F.to_json(F.struct(*counts.columns)))
    sized = counts.withColumn("__bytes", size)
    sums = [x for k, t in enumerate(steps[:-1]) for x in (F.count_if(t.met()).alias(f"n{k}"), F.coalesce(F.sum(F.when(t.met(), F.col("__bytes"))), F.lit(0)).alias(f"b{k}"))]
    found = sized.agg(*sums).first() if sums else {}
    now = next((t for k, t in enumerate(steps[:-1]) if found[f"n{k}"] <= most_entries and found[f"b{k}"] * packed <= most_bytes), steps[-1])
    return counts.filter(now.met()), now


def statistics(lines: DataFrame, value: str, usable: Column, prefix: str) -> DataFrame:
    """min, p25, median, p75, max, n of a value by group key, rounded half to even."""
    counted = lines.filter(usable).groupBy("group_key", value).agg(F.count(F.lit(1)).alias("__n"))
    spread = counted.groupBy("group_key").agg(
        F.min(value).alias(f"{prefix}_min"), F.expr(f"percentile({value}, array(0.25, 0.5, 0.75), __n)").alias("__p"), F.max(value).alias(f"{prefix}_max"), F.sum("__n").alias(f"{prefix}_n"),
    )
    parts = [round_half_even(F.col("__p")[i]).cast("long").alias(f"{prefix}_{n}") for i, n in enumerate(("p25", "median", "p75"))]
    return spread.select("group_key", f"{prefix}_min", *parts, f"{prefix}_max", f"{prefix}_n")


def price_statistics(lines: DataFrame) -> DataFrame:
    return statistics(lines, "unit_price_thb", usable_price(), "up")


def amount_statistics(lines: DataFrame) -> DataFrame:
    return statistics(lines, "amount_thb", usable_amount(), "amt")


def ranked(lines: DataFrame, value: str) -> DataFrame:
    """group_key, value, n, rn: a group's values by frequency, ties by the value."""
    counts = lines.filter(F.col(value).isNotNull()).groupBy("group_key", value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy("group_key").orderBy(F.desc("n"), F.asc(value))))


def variants(lines: DataFrame) -> DataFrame:
    """group_key, key (the commonest spelling), keys (up to MAX_VARIANTS, by frequency), keys_truncated."""
    found = ranked(lines, "item_key").filter(F.col("rn") <= MAX_VARIANTS + 1).groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("rn", "item_key"))).alias("__k"))
    keys = F.transform("__k", lambda x: x["item_key"])
    return found.select("group_key", keys[0].alias("key"), F.slice(keys, 1, MAX_VARIANTS).alias("keys"), (F.size("__k") > MAX_VARIANTS).alias("keys_truncated"))


def display_names(lines: DataFrame) -> DataFrame:
    return ranked(lines, "item_name").filter(F.col("rn") == 1).select("group_key", F.col("item_name").alias("display_name"))


def top_agencies(lines: DataFrame, top: int = TOP_AGENCIES) -> DataFrame:
    return ranked(lines, "agency").filter(F.col("rn") <= top).select("group_key", "rn", "agency", "n")


def samples(lines: DataFrame, top: int = SAMPLES) -> DataFrame:
    order = Window.partitionBy("group_key").orderBy(F.coalesce("amount_thb", F.lit(0)).desc(), F.asc("source_id"))
    return lines.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top).select("group_key", "rn", "source_id", "amount_thb")


def low_specificity() -> Column:
    """On the rounded statistics."""
    spread = F.when(F.col("up_p25") > 0, F.col("up_p75") / F.col("up_p25") >= WIDE_SPREAD)
    return (F.char_length("key") <= SHORT_KEY) | F.coalesce(spread, F.lit(False))


def summaries(lines: DataFrame) -> DataFrame:
    """Counts and statistics of each group; percentiles are of values counted before."""
    values = {"up": F.when(usable_price(), F.col("unit_price_thb")), "amt": F.when(usable_amount(), F.col("amount_thb"))}
    told = quantiles.spread(quantiles.value_counts(lines, ("group_key",), values), ("group_key", "kind"), (0.25, 0.5, 0.75))
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    parts = {"min": F.col("low"), "p25": F.col("p")[0], "median": F.col("p")[1], "p75": F.col("p")[2], "max": F.col("high"), "n": F.col("n")}
    columns = [of(kind, round_half_even(x).cast("long") if name in ("p25", "median", "p75") else x).alias(f"{kind}_{name}") for kind in values for name, x in parts.items()]
    wide = told.groupBy("group_key").agg(*columns, of("up", F.col("n_distinct")).alias("n_unit_prices"))
    years = lines.groupBy("group_key").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_set("fiscal_year_be")).alias("years"))
    found = years.join(wide, "group_key", "left").withColumns({"n_years": F.size("years").cast("long"), "n_unit_prices": F.coalesce("n_unit_prices", F.lit(0).cast("long"))})
    stats = [f"{p}_{n}" for p in ("up", "amt") for n in ("min", "p25", "median", "p75", "max", "n")]
    return found.select("group_key", "n_lines", "n_years", "years", "n_unit_prices", *stats)


def leading_values(lines: DataFrame) -> DataFrame:
    """Variants, display name and agencies of each group: the values of three columns are counted and ranked together."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("item_key", "item_name", "agency")])
    long = lines.select("group_key", F.explode(pairs).alias("x")).select("group_key", "x.*").filter(F.col("value").isNotNull())
    counts = long.groupBy("group_key", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("group_key", "kind").orderBy(F.desc("n"), F.asc("value"))
    kept = counts.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= F.when(F.col("kind") == "item_key", MAX_VARIANTS + 1).otherwise(TOP_AGENCIES))
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rn", "value")))), lambda x: x["value"])
    keys = F.col("__keys")
    found = kept.groupBy("group_key").agg(listed("item_key").alias("__keys"), listed("agency").alias("agencies"), F.max(F.when((F.col("kind") == "item_name") & (F.col("rn") == 1), F.col("value"))).alias("display_name"))
    return found.select("group_key", keys[0].alias("key"), F.slice(keys, 1, MAX_VARIANTS).alias("keys"), (F.size(keys) > MAX_VARIANTS).alias("keys_truncated"), "display_name", "agencies")


def entries(flagged: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The catalogue: three passes over the lines, and joins of parts that are partitioned alike."""
    lines = grouped_lines(flagged)
    picks = samples(lines).groupBy("group_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "source_id"))), lambda x: x["source_id"]).alias("sample_ids"))
    kept = summaries(lines).filter(thresholds.met())
    return kept.join(leading_values(lines), "group_key", "left").join(picks, "group_key", "left").withColumn("low_specificity", low_specificity())


def file_index(flagged: DataFrame, path: str = "path") -> DataFrame:
    """group_key, paths: the sorted distinct files that hold a group's lines."""
    return grouped_lines(flagged).groupBy("group_key").agg(F.array_sort(F.collect_set(path)).alias("paths"))


def resolve_keys(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """wanted (asked) with the entry of each: by its key, else by one of its variants, else by its whitespace-free form."""
    spelled = catalog.select("group_key", "key", F.explode("keys").alias("variant"))
    exact = wanted.join(catalog.select("group_key", "key"), F.col("asked") == F.col("key")).select("asked", "group_key", F.lit(1).alias("how"))
    variant = wanted.join(spelled, F.col("asked") == F.col("variant")).select("asked", "group_key", F.lit(2).alias("how"))
    squeezed = wanted.join(catalog.select("group_key"), group_key(F.col("asked")) == F.col("group_key")).select("asked", "group_key", F.lit(3).alias("how"))
    best = Window.partitionBy("asked").orderBy("how", "group_key")
    return exact.unionByName(variant).unionByName(squeezed).withColumn("__n", F.row_number().over(best)).filter(F.col("__n") == 1).drop("__n")
