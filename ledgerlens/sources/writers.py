"""Published outputs: shards, buckets, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import bucket_of
from ..operators.facets import stratified_sample
from ..schema import NOT_PUBLISHED

MAX_FILE_BYTES = 24_000_000


def records_per_file(rows: int, size: int, limit: int = MAX_FILE_BYTES) -> int:
    """Rows that fit a file, from the bytes that so many rows took."""
    return max(1, int(limit * 0.9 / max(1.0, size / max(1, rows))))


def write_shards(located: DataFrame, folder: str, bytes_per_row: float = 60.0, limit: int = MAX_FILE_BYTES, keep_others: bool = False) -> None:
    """Lines by their column ``path`` as Parquet partitions, sorted by what is asked for, in files of bounded size.

    The range of (path, sort columns) is what is dealt out: a large shard spreads over tasks, a small one fills a file.
    With ``keep_others`` only the shards that ``located`` holds are replaced.
    """
    order = "path", F.asc_nulls_last("agency"), F.asc_nulls_last("item_key"), F.asc("source_id")
    frame = located.select(*[c for c in located.columns if c not in NOT_PUBLISHED])
    parts = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    most = max(1, int(limit * 0.9 / bytes_per_row))
    out = dealt.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", most)
    out.option("partitionOverwriteMode", "dynamic" if keep_others else "static").partitionBy("path").parquet(folder)


def write_fitting_shards(located: DataFrame, folder: str, bytes_per_row: float = 60.0, limit: int = MAX_FILE_BYTES, rounds: int = 8) -> int:
    """``write_shards``, then again for shards that hold a file above the limit, in smaller slices each time; how many rounds it took.

    A file of one row can't be divided: such a shard is an error, as is one that still is too large in the end.
    """
    spark, left, per_row = located.sparkSession, located, bytes_per_row
    for n in range(1, rounds + 1):
        write_shards(left, folder, per_row, limit, keep_others=n > 1)
        sizes = spark.read.parquet(folder).select("path", F.col("_metadata.file_size").alias("size"))
        large = sizes.filter(F.col("size") > limit).groupBy("path").agg(F.max("size").alias("size"))
        worst = large.agg(F.max("size")).first()[0]
        if worst is None:
            return n
        if limit * 0.9 / per_row <= 1:
            break
        per_row = per_row * max(2.0, worst / limit)
        left = located.join(large.select("path"), "path", "left_semi")
    raise ValueError(f"files of {folder} stay above {limit} bytes")


def write_json(frame: DataFrame, folder: str, *order: str) -> None:
    """A small table (facets, organisations, sources, index series, a report) as one JSON file in a stated order."""
    frame.orderBy(*order).coalesce(1).write.mode("overwrite").json(folder)


def publish_sample(located: DataFrame, folder: str, by: str, shares: dict[str, float], n: int, limit: int = 1_500_000) -> int:
    """The same shards from about n lines with fixed shares; the bytes written, which must stay below a limit."""
    write_shards(stratified_sample(located, by, shares, n), folder)
    size = oversized(located.sparkSession, folder, 0).agg(F.sum("length")).first()[0] or 0
    if size > limit:
        raise ValueError(f"the sample takes {size} bytes, more than {limit}")
    return size


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards again, with each row's file: provenance, and pruning by ``path``."""
    return spark.read.option("mergeSchema", True).parquet(folder).withColumn("file", F.col("_metadata.file_path"))


def oversized(spark: SparkSession, folder: str, limit: int = MAX_FILE_BYTES) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length").filter(F.col("length") > limit)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """rel_path, bytes, sha256, partition of every published file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{parquet,json,gz}").load(folder)
    rel = F.regexp_replace("path", "^.*" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return files.select(rel.alias("rel_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.url_decode(F.regexp_extract(rel, "path=([^/]+)/", 1)).alias("partition"))


def content_version(rows: DataFrame, key: str) -> str:
    """A version of a table's content whatever its files: order and file boundaries don't matter."""
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    parts = rows.select(F.substring(F.sha1(F.col(key).cast("string")), 1, 2).alias("b"), digest.alias("d"))
    # Sums of digest words are free of order and can be combined map-side.
    words = [F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(8)]
    row = parts.agg(F.count(F.lit(1)).alias("n"), *words)
    return row.select(F.sha2(F.to_json(F.struct("*")), 256)).first()[0]


def write_buckets(series: DataFrame, folder: str, key: str = "group_key") -> None:
    """Gzipped JSON by the first hex digits of a key's hash."""
    series.withColumn("hh", bucket_of(F.col(key))).repartition("hh").sortWithinPartitions("hh", key).write.mode("overwrite").option("compression", "gzip").partitionBy("hh").json(folder)
