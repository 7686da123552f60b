"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a pattern for Spark's and DuckDB's regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch between the JVM and Python: texts are long, and several batches are held at a time.
BATCH_ROWS = 2_000


#: Bits of the map that says which keys may be among those that are looked for: 8 MB, however many these are.
SIEVE_BITS = 26
#: Deletes the shuffle files of a query when it ends; else they stay until the driver's heap happens to be collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, if they are above."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, or with underscores that make it new among the frame's columns."""
    while name.lower() in map(str.lower, frame.columns):
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none (tests on one machine), a temporary folder of this
    machine is taken and set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage: what is read later no longer depends on any executor,
    and a non-deterministic or costly plan runs once only. Its shuffle files go at once.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, True)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for frame in frames:
        folders = {f.rsplit("/", 1)[0] for f in frame.inputFiles()}
        for folder in (f for f in folders if f.rsplit("/", 1)[-1].startswith("staged-")):
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sieved(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """``rows`` with ``__may``: false only where no row of ``wanted`` has the same key. What is broadcast is a map of 2 ** SIEVE_BITS bits at most."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(0), *key), 64 - SIEVE_BITS) + 1
    bits = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("__bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "__bucket", "left").withColumn("__may", may).drop("__bucket", "__bits")


def running_sums(df: DataFrame, key: str, values: list[str], block: int = 1024) -> DataFrame:
    """Adds ``<value>_before`` for each value: its sum over rows with a smaller key.

    ``key`` is a unique non-negative whole number. Blocks of ``block`` neighbouring keys are
    summed first, blocks of blocks next; every window stays within one block, so no
    task ever holds all the rows.
    """
    level, top = df.withColumn("__b0", F.floor(F.col(key) / block).cast("long")), 0
    first = level.groupBy("__b0").agg(*[F.sum(v).alias(f"__s_{v}") for v in values])
    first = first.withColumn("__b1", F.floor(F.col("__b0") / block).cast("long"))
    second = first.groupBy("__b1").agg(*[F.sum(f"__s_{v}").alias(f"__t_{v}") for v in values])
    # Keys below 2**63 in blocks of 2**20 keys: the third level has few rows, as it counts only blocks that occur.
    second = second.withColumn("__top", F.floor(F.col("__b1") / block).cast("long"))
    third = second.groupBy("__top").agg(*[F.sum(f"__t_{v}").alias(f"__u_{v}") for v in values])

    def before(frame: DataFrame, by: str | None, order: str, names: dict[str, str]) -> DataFrame:
        w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumns({out: F.coalesce(F.sum(v).over(w), F.lit(0)) for v, out in names.items()})

    third = before(third, None, "__top", {f"__u_{v}": f"__p3_{v}" for v in values})
    second = before(second, "__top", "__b1", {f"__t_{v}": f"__p2_{v}" for v in values})
    first = before(first, "__b1", "__b0", {f"__s_{v}": f"__p1_{v}" for v in values})
    rows = before(level, "__b0", key, {v: f"__p0_{v}" for v in values})
    second = second.join(third.select("__top", *[f"__p3_{v}" for v in values]), "__top")
    first = first.join(second.select("__b1", *[f"__p2_{v}" for v in values], *[f"__p3_{v}" for v in values]), "__b1")
    out = rows.join(first.select("__b0", *[f"__p{i}_{v}" for i in (1, 2, 3) for v in values]), "__b0")
    sums = {f"{v}_before": sum((F.col(f"__p{i}_{v}") for i in (1, 2, 3)), F.col(f"__p0_{v}")) for v in values}
    return out.select(*df.columns, *[c.alias(n) for n, c in sums.items()])


@lru_cache(maxsize=4)
def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
