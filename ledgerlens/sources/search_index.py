"""A search index that is kept: segments of postings, merged with what is new, and released as a whole.

A segment holds ``postings`` (by the first letter of the term, sorted by term), ``spellings`` (the forms that its terms are found by),
``vocabulary`` (in how many items a term occurs; negative where items went), ``items`` (id, length, a mark of the text) and ``gone`` (ids whose
postings in earlier segments no longer count). ``refresh`` compares marks: where little has changed, a segment with the difference is added;
where much has, or segments are many, the index is built anew. Document count and total length stand in the release, so no query counts them.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, tokens
from ..operators import search
from .published import last_number
from .writers import content_version

#: A difference of more than this share of the items, or more segments, calls for a new build.
REBUILD_SHARE, MOST_SEGMENTS = 0.2, 8
_RELEASE = "seq int, segments array<string>, data_version string, n long, total long"
_TABLES = {
    "postings": "term string, id long, tf long, length int, head string",
    "spellings": "form string, term string",
    "vocabulary": "term string, df long",
    "items": "id long, length int, mark long",
    "gone": "id long",
}


@dataclass(frozen=True)
class IndexRelease:
    seq: int
    segments: list[str]
    data_version: str
    n: int
    total: int


def _head():
    """The first letter of a term as a folder name that differs in letters only."""
    return F.hex(F.encode(F.substring("term", 1, 1), "UTF-8"))


class KeptIndex:
    """The index under a root; ids are whole numbers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        seq = last_number(spark, root)
        self.release = IndexRelease(**spark.read.schema(_RELEASE).json(f"{root}/released/{seq}").first().asDict()) if seq is not None else IndexRelease(0, [], "", 0, 0)

    def _segment(self, name: str, table: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[table]).parquet(f"{self.root}/segments/{name}/{table}")

    def _all(self, table: str) -> DataFrame:
        parts = [self._segment(name, table) for name in self.release.segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _TABLES[table])

    def _living(self, table: str) -> DataFrame:
        """Rows of all segments whose ids no later segment has taken away."""
        out = None
        for name in self.release.segments:
            own = self._segment(name, table)
            out = own if out is None else out.join(self._segment(name, "gone"), "id", "left_anti").unionByName(own)
        return out if out is not None else self.spark.createDataFrame([], _TABLES[table])

    def postings(self) -> DataFrame:
        """term, id, tf, length, as ``search.build_index`` gives them."""
        return self._living("postings").select("term", "id", "tf", "length")

    # ---- writing

    def _write(self, items: DataFrame, gone: DataFrame) -> tuple[str, int, int]:
        """A segment of ``items`` (id, key) that takes the ids ``gone`` away from the segments before; how many items and terms more there are."""
        name, parts = uuid.uuid4().hex, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        folder = f"{self.root}/segments/{name}"
        split = items.select("id", F.size(tokens(fold(F.col("key")))).alias("length"), F.xxhash64("key").alias("mark"))
        split.write.parquet(f"{folder}/items")
        gone.select("id").distinct().write.parquet(f"{folder}/gone")
        postings = search.build_index(items).withColumn("head", _head())
        dealt = postings.repartitionByRange(parts, "head", "term", "id").sortWithinPartitions("head", "term", "id")
        dealt.write.option("parquet.bloom.filter.enabled#term", "true").partitionBy("head").parquet(f"{folder}/postings")
        own, left = self._segment(name, "postings"), self._segment(name, "gone")
        lost = self._living("postings").join(left, "id", "left_semi")
        change = own.select("term", F.lit(1).alias("d")).unionByName(lost.select("term", F.lit(-1).alias("d")))
        change.groupBy("term").agg(F.sum("d").cast("long").alias("df")).write.parquet(f"{folder}/vocabulary")
        spelt = search.spellings(self._segment(name, "vocabulary").filter("df > 0"))
        spelt.repartitionByRange(parts, "form").sortWithinPartitions("form").write.option("parquet.bloom.filter.enabled#form", "true").parquet(f"{folder}/spellings")
        more = self._segment(name, "items").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        less = self._living("items").join(left, "id", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return name, more[0] - less[0], more[1] - less[1]

    def _switch(self, segments: list[str], version: str, n: int, total: int) -> KeptIndex:
        made = IndexRelease(self.release.seq + 1, segments, version, n, total)
        self.spark.createDataFrame([tuple(asdict(made).values())], _RELEASE).coalesce(1).write.mode("errorifexists").json(f"{self.root}/released/{made.seq:010d}")
        return KeptIndex(self.spark, self.root)

    def build(self, items: DataFrame) -> KeptIndex:
        """The index of ``items`` (id, key) anew, as one segment."""
        empty = KeptIndex.__new__(KeptIndex)
        empty.spark, empty.root, empty.release = self.spark, self.root, IndexRelease(0, [], "", 0, 0)
        name, n, total = empty._write(items, self.spark.createDataFrame([], "id long"))
        return self._switch([name], content_version(items.select("id", "key"), "id"), n, total)

    def refresh(self, items: DataFrame) -> tuple[KeptIndex, str]:
        """The index of ``items`` (id, key), and what it took: ``fresh``, ``merged`` or ``rebuilt``."""
        version = content_version(items.select("id", "key"), "id")
        if self.release.segments and version == self.release.data_version:
            return self, "fresh"
        if not self.release.segments or len(self.release.segments) >= MOST_SEGMENTS:
            return self.build(items), "rebuilt"
        known = self._living("items").select(F.col("id").alias("k_id"), "mark")
        both = items.select("id", "key").join(known, F.col("id") == F.col("k_id"), "full")
        same = F.col("id").isNotNull() & F.col("k_id").isNotNull() & (F.xxhash64("key") == F.col("mark"))
        changed = both.filter(~F.coalesce(same, F.lit(False)))
        if changed.count() > REBUILD_SHARE * max(1, self.release.n):
            return self.build(items), "rebuilt"
        new = changed.filter(F.col("id").isNotNull()).select("id", "key")
        name, n, total = self._write(new, changed.filter(F.col("k_id").isNotNull()).select(F.col("k_id").alias("id")))
        return self._switch([*self.release.segments, name], version, self.release.n + n, self.release.total + total), "merged"

    # ---- reading

    def hits(self, terms: list[str]) -> DataFrame:
        """id, score, matched: as ``search.hits``, from stored spellings and the postings of the letters that are met."""
        matched = search.matched_terms(self._all("spellings"), terms)
        known = self._all("vocabulary").join(matched, "term").groupBy("term", "asked", "weight").agg(F.sum("df").alias("df")).filter("df > 0")
        # Few terms, each of which lies in one folder: the folders are pruned when the terms are known.
        small = known.withColumn("__head", _head())
        postings = self._living("postings").join(small.select(F.col("__head").alias("head")).distinct(), "head", "left_semi").drop("head")
        mean = self.release.total / self.release.n if self.release.n and self.release.total else 1.0
        return search.scored(postings, known, (self.release.n, mean))

    def ranked(self, items: DataFrame, query: str, years: tuple[int, ...] = (), priced_only: bool = False) -> DataFrame:
        """All hits with their rank_score; ``items``: id, key, n_lines, and years / has_unit_price where filtered by."""
        terms = search.query_terms(self.spark, query)
        return search.chosen(search.reranked(self.hits(terms), items, terms), years, priced_only)

    def search(self, items: DataFrame, query: str, limit: int = 10, years: tuple[int, ...] = (), priced_only: bool = False) -> DataFrame:
        """The best items, ties by id, with the number of all hits as ``total``."""
        return search.with_total(self.ranked(items, query, years, priced_only), limit)

    def suggestions(self, items: DataFrame, unknown_key: str, n: int = 5) -> DataFrame:
        """The nearest keys to one that isn't there."""
        return search.first_page(self.ranked(items, unknown_key), n).select("key")
