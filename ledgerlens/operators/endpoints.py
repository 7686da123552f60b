"""What a caller asks for: compositions of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import documents, facets, implied, lines, search, trends
from .lines import LineFilter

#: Price statistics of fewer values are of low reliability.
RELIABLE_FROM = 3


def query_budget_lines(source: DataFrame, wanted: LineFilter, order: str = "amount_desc", limit: int | None = None) -> DataFrame:
    """The first matching lines with their price basis, how many match in all, and whether the answer is cut."""
    n = lines.matching(source, wanted).count()
    most = lines.clamped(limit, 1, lines.MAX_LIMIT, lines.DEFAULT_LIMIT)
    found = lines.top(source, wanted, order, limit)
    return found.withColumns({"price_basis": lines.price_basis(), "total": F.lit(n), "truncated": F.lit(n > most)})


def implied_hint(answer: DataFrame) -> DataFrame:
    """An implied unit price of an answer's amounts that have no unit price; an estimate, not a fact."""
    return implied.implied_prices(answer.filter(F.col("price_basis") == "amount_per_line").withColumn("answer", F.lit(1)), "answer").drop("answer")


def notes_of(answer: DataFrame, notes: DataFrame) -> DataFrame:
    """Coverage notes on the data that an answer draws on."""
    return facets.notes_for(answer.select("dataset", F.col("fiscal_year_be").alias("year_be")), notes)


def search_catalog(index: DataFrame, items: DataFrame, statistics: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Search hits with price statistics (id, up_median, up_n) and how far these can be relied on."""
    hits = search.search(index, items, query, limit)
    known = hits.join(statistics, "id", "left")
    return known.withColumn("reliability", F.when(F.coalesce("up_n", F.lit(0)) < RELIABLE_FROM, "low").otherwise("normal"))


def price_trend(chosen: DataFrame, group_key: str, years: tuple[int, int] | None = None) -> DataFrame:
    """One item's series, its last points, and its change in percent."""
    own = chosen.filter(F.col("group_key") == group_key)
    own = own.filter(F.col("year_be").between(*years)) if years else own
    moved = trends.change(own).select("group_key", "change_pct")
    last = own.orderBy(F.desc("year_be")).limit(trends.SHOWN_POINTS)
    return last.join(moved, "group_key", "left")


def document_index(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """An index over several fields of the document dimension at once. ``docs``: id and the fields."""
    return search.build_index(docs.select("id", F.concat_ws(" ", *fields).alias("key")))


def find_documents(index: DataFrame, docs: DataFrame, query: str, limit: int = 10, kinds: tuple[str, ...] = (), years: tuple[int, ...] = ()) -> DataFrame:
    """Documents by their fields, then by facets."""
    allowed = documents.facet_filter(docs, kinds, years)
    return search.search(index, allowed.withColumn("n_lines", F.lit(0)), query, limit)


def suggestions(index: DataFrame, items: DataFrame, unknown_key: str) -> DataFrame:
    """The five nearest keys to one that isn't there."""
    return search.search(index, items, unknown_key, 5).select("key")
