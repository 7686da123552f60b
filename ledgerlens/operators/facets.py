"""Facets, coverage notes, deterministic samples, shard listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percentage
from ..schema import ORG_UNMAPPED

FACETS = ("dataset", "fiscal_year_be", "ministry", "province", "budget_type")


def facets(lines: DataFrame, columns: tuple[str, ...] = FACETS) -> DataFrame:
    """facet, value, n: counts of each column's values, nulls left out, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    long = lines.select(F.explode(pairs).alias("x")).select("x.*").filter(F.col("value").isNotNull())
    return long.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def flag_share(lines: DataFrame, by: str, flag: str = ORG_UNMAPPED) -> DataFrame:
    """Share in percent of a group's lines that carry a flag."""
    hit = F.count_if(F.array_contains("quality_flags", flag))
    return lines.groupBy(by).agg(F.count(F.lit(1)).alias("n"), hit.alias("hits"), percentage(hit, F.count(F.lit(1))).alias("pct"))


def flag_histogram(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def coverage_notes(spark, computed: DataFrame | None, literal: list[tuple[str, int | None, str]]) -> DataFrame:
    """dataset, year_be, note: the fixed notes and the computed ones."""
    fixed = spark.createDataFrame(literal, "dataset string, year_be int, note string")
    return fixed if computed is None else fixed.unionByName(computed)


def notes_for(files: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes that concern any of the files (dataset, year_be): same dataset, and no year on either side or the same one."""
    n = notes.select(F.col("dataset").alias("n_dataset"), F.col("year_be").alias("n_year"), "note")
    fits = F.col("n_year").isNull() | F.col("year_be").isNull() | (F.col("n_year") == F.col("year_be"))
    hits = files.distinct().join(n, (F.col("dataset") == F.col("n_dataset")) & fits)
    return hits.select(F.col("n_dataset").alias("dataset"), F.col("n_year").alias("year_be"), "note").distinct()


def sample(lines: DataFrame, by: tuple[str, ...], n: int) -> DataFrame:
    """The first n lines of each group by source_id."""
    order = Window.partitionBy(*by).orderBy("source_id")
    return lines.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).drop("rn")


def stratified_sample(lines: DataFrame, by: str, shares: dict[str, float], n: int, seed: int = 7) -> DataFrame:
    """About n lines with fixed shares by a column, in an order given by a seeded hash; what a small stratum lacks is topped up from all."""
    dice = F.xxhash64(F.lit(seed), "source_id")
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, s in shares.items() for x in (k, round(n * s))]), F.col(by)), F.lit(0))
    first = lines.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(dice, "source_id"))).filter(F.col("__n") <= quota).drop("__n")
    rest = lines.join(first.select("source_id"), "source_id", "left_anti").orderBy(dice, "source_id")
    missing = max(0, n - first.count())
    return first.unionByName(rest.limit(missing)) if missing else first


def top_values(lines: DataFrame, column: str, n: int) -> DataFrame:
    counts = lines.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(n)


def shard_path(lines: DataFrame) -> DataFrame:
    """The lines with the path of the shard that holds each: by year and ministry, by ministry, by province or by document."""
    d = F.col("dataset")
    unmapped = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_unmapped"))
    year = F.coalesce(F.col("fiscal_year_be").cast("string"), F.lit("unknown-year"))
    path = (
        F.when(d == "pbo_disbursement", F.concat_ws("/", d, year, unmapped("ministry_code")))
        .when(d == "act_2570_draft", F.concat_ws("/", d, unmapped("ministry_code")))
        .when(d == "committee_table", F.concat_ws("/", d, unmapped("source_doc_id")))
        .otherwise(F.concat_ws("/", d, unmapped("province")))
    )
    return lines.withColumn("path", path)


def shard_summary(located: DataFrame) -> DataFrame:
    """path, rows, first_id, last_id, years: what each shard holds."""
    years = F.array_join(F.array_sort(F.collect_set("fiscal_year_be")).cast("array<string>"), ",")
    return located.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.min("source_id").alias("first_id"), F.max("source_id").alias("last_id"), years.alias("years"))


def path_parts(paths: DataFrame) -> DataFrame:
    """Distinct datasets and second parts of shard paths."""
    part = F.split("path", "/")
    return paths.select(part[0].alias("dataset"), part[1].alias("part")).groupBy("dataset").agg(F.countDistinct("part").alias("n_parts"), F.min("part").alias("first_part"), F.max("part").alias("last_part"))


def numbered_paths(paths: DataFrame, width: int = 20) -> DataFrame:
    """path, index from 0 in order of the paths: a dictionary for lists of paths.

    Paths are numbered within blocks of equal first ``width`` characters, which keep their order; the blocks' sizes are
    summed up. The width only spreads the work.
    """
    blocks = paths.select("path").distinct().withColumn("__block", F.substring("path", 1, width))
    sizes = blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__block", (F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__block").orderBy("path"))
    return blocks.withColumn("__own", own).join(before, "__block").select("path", (F.col("__before") + F.col("__own") - 1).cast("int").alias("index"))


def resolved_paths(items: DataFrame, numbered: DataFrame, listed: DataFrame) -> DataFrame:
    """items (an index of a path in each row) with the path; indexes out of range and paths that no manifest lists are dropped."""
    return items.join(numbered.select("index", "path"), "index").join(listed.select("path").distinct(), "path", "left_semi").drop("index")


def shards_of(asked: DataFrame, allowed: DataFrame) -> DataFrame:
    """Of the paths that a caller names, those that the filter leaves; in the caller's other columns nothing changes."""
    return asked.join(allowed.select("path").distinct(), "path", "left_semi")


def first_shards(ranked: DataFrame, most: int) -> DataFrame:
    """path, place: the shards of ranked hits (rank, path) put together, each once at its first place, up to ``most``."""
    first = ranked.groupBy("path").agg(F.min("rank").alias("rank"))
    kept = first.orderBy("rank", "path").limit(most)
    return kept.select("path", F.row_number().over(Window.orderBy("rank", "path")).alias("place"))


def smallest(files: DataFrame, n: int, size: str = "bytes", name: str = "path") -> DataFrame:
    """The n smallest files, ties by name."""
    return files.orderBy(size, name).limit(n)
