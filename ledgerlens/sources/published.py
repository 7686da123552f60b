"""The published fact table: written once, switched to as a whole, read with pruning.

A version is a folder of its own: ``facts`` by dataset and shard, sorted by item key, with bloom filters on item key and
source id; ``items``, which shards hold a key; ``shards``, what each shard holds. A version counts once its release is there: one
row below ``released``, whose ``_SUCCESS`` file comes last. Until then readers see the version before; a write that is
stopped leaves a folder that nothing refers to, and ``drop_stale`` takes it away.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import group_key
from ..operators.facets import shard_path
from ..operators.lines import LineFilter

#: Bytes of a row group: small enough that sorted keys leave most of them unread.
ROW_GROUP = 8 << 20
#: Bytes of input to a task that sorts lines: some 150,000 lines, which fit into its memory.
SORTED_AT_ONCE = 4 << 20
#: Shard names that may go to all executors at a time (some 50 bytes each).
MOST_NAMES = 200_000
_RELEASE = "seq int, version string, schema string, n_rows long, n_shards long"
_ITEMS = "group_key string, path string, n long"
_SHARDS = "path string, dataset string, n long, first_year int, last_year int, unknown_years long"


@dataclass(frozen=True)
class Release:
    seq: int
    version: str
    schema: str
    n_rows: int
    n_shards: int


def statuses(spark: SparkSession, pattern: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of what a pattern meets, on any file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found or ()]


def last_number(spark: SparkSession, root: str) -> str | None:
    return max((name.rsplit("/", 2)[1] for name, *_ in statuses(spark, f"{root}/released/*/_SUCCESS")), default=None)


def current(spark: SparkSession, root: str) -> Release | None:
    """The latest release under ``root``, if there is one."""
    seq = last_number(spark, root)
    if seq is None:
        return None
    row = spark.read.schema(_RELEASE).json(f"{root}/released/{seq}").first()
    return Release(**row.asDict())


def _write_version(lines: DataFrame, folder: str) -> tuple[str, int, int]:
    spark = lines.sparkSession
    size = sum(s[1] for name in lines.inputFiles() for s in statuses(spark, unquote(name)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SORTED_AT_ONCE)
    order = "dataset", "path", F.asc_nulls_last("item_key"), "source_id"
    dealt = shard_path(lines).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = dealt.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    # As large as the row group's distinct values ask for, not a megabyte each.
    out = out.option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in ("item_key", "source_id"):
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
    out.partitionBy("dataset", "path").parquet(f"{folder}/facts")
    facts = spark.read.parquet(f"{folder}/facts")
    year = F.col("fiscal_year_be").cast("int")
    shards = facts.groupBy("path", "dataset").agg(F.count(F.lit(1)).alias("n"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_if(year.isNull()).alias("unknown_years"))
    shards.write.parquet(f"{folder}/shards")
    items = facts.filter(F.col("item_key").isNotNull()).groupBy(group_key(F.col("item_key")).alias("group_key"), "path").agg(F.count(F.lit(1)).alias("n"))
    items = items.repartitionByRange(parts, "group_key").sortWithinPartitions("group_key", "path")
    items.write.option("parquet.bloom.filter.enabled#group_key", "true").parquet(f"{folder}/items")
    row = spark.read.schema(_SHARDS).parquet(f"{folder}/shards").agg(F.sum("n"), F.count(F.lit(1))).first()
    return facts.schema.json(), row[0] or 0, row[1]


def _release(spark: SparkSession, root: str, made: Release) -> None:
    # A second writer of the same number fails here: the folder exists.
    spark.createDataFrame([tuple(made.__dict__.values())], _RELEASE).coalesce(1).write.mode("errorifexists").json(f"{root}/released/{made.seq:010d}")


def publish(lines: DataFrame, root: str) -> Release:
    """Writes a new version of the (flagged) lines, then switches to it."""
    spark, before = lines.sparkSession, current(lines.sparkSession, root)
    version = uuid.uuid4().hex
    schema, n_rows, n_shards = _write_version(lines, f"{root}/versions/{version}")
    made = Release((before.seq if before else 0) + 1, version, schema, n_rows, n_shards)
    _release(spark, root, made)
    return made


def drop_stale(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Deletes all versions but the last ``keep`` that were released, those never released included; which ones."""
    last = spark.read.schema(_RELEASE).json(f"{root}/released/*").orderBy(F.desc("seq")).limit(keep).collect() if current(spark, root) else []
    there = {name.rsplit("/", 1)[1] for name, *_ in statuses(spark, f"{root}/versions/*")}
    gone = sorted(there - {r["version"] for r in last})
    for version in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{version}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


class Published:
    """One release, read with pruning. A reader keeps its release, whatever is published meanwhile; its files are listed once."""

    def __init__(self, spark: SparkSession, root: str):
        release = current(spark, root)
        if release is None:
            raise FileNotFoundError(f"nothing is published under {root}")
        self.spark, self.root, self.release = spark, root, release
        folder = f"{root}/versions/{release.version}"
        self._facts = spark.read.schema(StructType.fromJson(json.loads(release.schema))).parquet(f"{folder}/facts")
        self._items, self._shards = spark.read.schema(_ITEMS).parquet(f"{folder}/items"), spark.read.schema(_SHARDS).parquet(f"{folder}/shards")

    def up_to_date(self) -> Published:
        """This reader, or one of the release that came since."""
        return self if int(last_number(self.spark, self.root) or -1) == self.release.seq else Published(self.spark, self.root)

    def facts(self) -> DataFrame:
        return self._facts

    def items(self) -> DataFrame:
        """group_key, path, n: the shards that hold a key."""
        return self._items

    def shards(self) -> DataFrame:
        """path, dataset, n, first_year, last_year, unknown_years."""
        return self._shards

    def shards_for(self, wanted: LineFilter) -> DataFrame | None:
        """The shards that may hold what is wanted; None where nothing but the partition columns could tell."""
        years = [*wanted.years, *(y for y in (wanted.year_from, wanted.year_to) if y is not None)]
        if not years and not wanted.item_keys:
            return None
        low = min(wanted.years) if wanted.years else wanted.year_from
        high = max(wanted.years) if wanted.years else wanted.year_to
        found = self.shards()
        found = found.filter(F.col("last_year") >= low) if low is not None else found
        found = found.filter(F.col("first_year") <= high) if high is not None else found
        found = found.filter(F.col("dataset").isin(*wanted.datasets)) if wanted.datasets else found
        if wanted.item_keys:
            asked = self.items().filter(F.col("group_key").isin(*{"".join(k.split()) for k in wanted.item_keys}))
            found = asked if not years and not wanted.datasets else found.join(asked, "path", "left_semi")
        return found.select("path")

    def lines(self, wanted: LineFilter) -> DataFrame:
        """The facts in the shards that ``wanted`` can meet; its own condition still has to be put to them.

        The names of the shards are sent to all executors, which prune partitions before they are read. There are at most
        ``n_shards`` of them for each key; where that is too many, they are joined instead.
        """
        found, facts = self.shards_for(wanted), self.facts()
        if found is None:
            return facts
        few = self.release.n_shards * max(1, len(wanted.item_keys)) <= MOST_NAMES
        return facts.join(F.broadcast(found) if few else found, "path", "left_semi")

    def matching(self, wanted: LineFilter) -> DataFrame:
        return self.lines(wanted).filter(wanted.condition())

    def by_ids(self, ids: list[str]) -> DataFrame:
        """Lines by a few source ids: bloom filters leave out the row groups that can't hold them."""
        return self.facts().filter(F.col("source_id").isin(*ids))
