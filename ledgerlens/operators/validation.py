"""The validation report: ten checks on normalised lines, hard ones (a failure stops a release) and soft ones (reported only).

``totals`` reads the lines once: every sum that a check needs is a grouping set of the same pass, the grand total among them, so a
lost executor counts nothing twice. The checks work on those sums; ids, prices and the rows of subset files are passes of their own.
Each check gives check, severity, subject, n (what was looked at), problems, status (``ok``, ``failed``, ``source_incomplete``,
``no_oracle``, ``no_summary``, ``warned``). An empty table has no findings, or those of a missing counterpart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percentage, within
from ..functions.text import clean
from ..schema import ORG_UNMAPPED, UPSTREAM_OCR, has
from . import checks, flags

HARD, SOFT = "hard", "soft"
AMOUNT_OUTLIER, YEAR_UNKNOWN = "amount_outlier", "year_unknown"
#: The dataset whose lines may lack a year, if they say so by a flag.
UNDATED = "committee_table"
#: Bounds of the checks, fixed values.
FIRST_YEAR, LAST_YEAR = 2558, 2570
FILE_TOTAL_PCT = 1.0
UNMAPPED_PCT = 5.0
KNOWN_GAP_POINTS = 0.5
GROUP = ("plan", "activity", "budget_type")
_YEAR = "fiscal_year_be"


def _levels(group: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    by_year = ("dataset", _YEAR)
    return {
        "all": (), "dataset": ("dataset",), "year": by_year, "ministry": (*by_year, "ministry"), "capital": (*by_year, "ministry", "is_capital"),
        "file": ("dataset", "source_path"), "group": ("dataset", "source_path", *group), "document": ("source_doc_id",),
    }


def _flagged(flag: str) -> Column:
    return F.coalesce(has(flag), F.lit(False))


def totals(lines: DataFrame, money: tuple[str, ...] = checks.MONEY, group: tuple[str, ...] = GROUP, years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR)) -> DataFrame:
    """level, its keys, n, counts of flags and of bad years, ``kept`` (amounts without outliers), sums of the money columns.

    A rolled-up key and a key that is null are told apart by ``level``. As many rows as there are groups: to be written by the caller.
    """
    levels = _levels(group)
    keys = list(dict.fromkeys(k for key in levels.values() for k in key))
    bit = {k: 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)}
    names = {sum(bit[k] for k in keys if k not in key): name for name, key in levels.items()}
    name = F.element_at(F.create_map(*[F.lit(x) for i, level in names.items() for x in (i, level)]), F.col("__id").cast("int"))
    undated = F.col(_YEAR).isNull() & ~((F.col("dataset") == UNDATED) & _flagged(YEAR_UNKNOWN))
    found = lines.groupingSets([list(key) for key in levels.values()], *keys).agg(
        F.grouping_id().alias("__id"), F.count(F.lit(1)).alias("n"), F.count_if(_flagged(UPSTREAM_OCR)).alias("n_ocr"), F.count_if(_flagged(ORG_UNMAPPED)).alias("n_unmapped"),
        F.count_if(~F.col(_YEAR).between(*years)).alias("n_out_of_range"), F.count_if(undated).alias("n_undated"), F.count_if(F.col("amount_thb") < 0).alias("n_negative"),
        F.sum(F.when(~_flagged(AMOUNT_OUTLIER), F.col("amount_thb"))).alias("kept"), *[F.sum(c).alias(c) for c in money],
    )
    return found.withColumn("level", name).drop("__id")


def _at(sums: DataFrame, level: str) -> DataFrame:
    return sums.filter(F.col("level") == level)


def _rows(frame: DataFrame, check: str, severity: str, subject: Column | str, n: Column | str, problems: Column, status: Column | None = None, bad: str = "failed") -> DataFrame:
    wrong = F.coalesce(problems, F.lit(0)).cast("long")
    told = F.when(wrong == 0, "ok").otherwise(bad) if status is None else status
    text = (F.col(subject) if isinstance(subject, str) else subject).cast("string")
    return frame.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), text.alias("subject"), (F.col(n) if isinstance(n, str) else n).cast("long").alias("n"), wrong.alias("problems"), told.alias("status"))


def printed_totals(sums: DataFrame, printed: DataFrame, gaps: DataFrame, dataset: str, money: tuple[str, ...]) -> DataFrame:
    """V1, by year: sums against totals printed in the source.

    ``printed``: level (year, ministry or capital), year_be, ministry, is_capital, column, expected (null: nothing to hold against).
    ``gaps``: year_be, oracle_total, coverage_pct of sources known to be incomplete. A year in it is ``source_incomplete`` while its
    coverage is within half a point of what was recorded, else failed; a year without printed totals is ``no_oracle``.
    """
    own = sums.filter(F.col("dataset") == dataset)
    long = own.filter(F.col("level").isin("year", "ministry", "capital")).select(
        "level", F.col(_YEAR).alias("y"), F.col("ministry").alias("m"), F.col("is_capital").alias("c"), F.explode(F.create_map(*[x for c in money for x in (F.lit(c), F.col(c))])).alias("k", "value")
    )
    left, right = printed.alias("p"), long.alias("s")
    same = (F.col("p.level") == F.col("s.level")) & (F.col("p.year_be") == F.col("y")) & F.col("p.ministry").eqNullSafe(F.col("m")) & F.col("p.is_capital").eqNullSafe(F.col("c")) & (F.col("p.column") == F.col("k"))
    held = left.join(right, same, "left").groupBy("p.year_be").agg(
        F.count("expected").alias("held"), F.count_if(~within(F.coalesce("value", F.lit(0)), F.col("expected"))).alias("wrong")
    )
    years = _at(own, "year").filter(F.col(_YEAR).isNotNull()).select(F.col(_YEAR).alias("year_be"), "n", "amount_thb")
    both = years.join(held, "year_be", "left").join(gaps, "year_be", "left")
    coverage = F.when(F.col("oracle_total") != 0, F.coalesce("amount_thb", F.lit(0)) * 100.0 / F.col("oracle_total")).otherwise(0.0)
    known = F.abs(coverage - F.col("coverage_pct")) <= KNOWN_GAP_POINTS
    status = (
        F.when(F.col("held").isNull(), "no_oracle").when(F.col("oracle_total").isNotNull(), F.when(known, "source_incomplete").otherwise("failed"))
        .when(F.col("wrong") == 0, "ok").otherwise("failed")
    )
    return _rows(both, "V1", HARD, "year_be", "n", F.col("wrong"), status)


def subset_files(sums: DataFrame, lines: DataFrame, titles: DataFrame, draft: DataFrame, datasets: tuple[str, ...]) -> DataFrame:
    """V2, by file of a subset of the draft: rows and amount are exactly those of its title; no title: ``no_oracle``.

    A soft row beside it counts lines without an equal in the draft, nulls being equal, by (item, amount), or with the agency where
    ``titles`` says format B. ``titles``: source_path, format, title_n, title_amount (both null: none); files it lacks are format A.
    """
    own = _at(sums, "file").filter(F.col("dataset").isin(*datasets)).join(titles, "source_path", "left")
    exact = (F.col("n") == F.col("title_n")) & (F.coalesce("amount_thb", F.lit(0)) == F.col("title_amount"))
    status = F.when(F.col("title_n").isNull(), "no_oracle").when(exact, "ok").otherwise("failed")
    hard = _rows(own, "V2", HARD, "source_path", "n", F.when(status == "failed", 1).otherwise(0), status)

    def keyed(frame: DataFrame) -> DataFrame:
        return frame.withColumns({"item": clean(F.col("item_name_raw")), "agency": F.col("agency_code")})

    subset = keyed(lines.filter(F.col("dataset").isin(*datasets))).join(titles.select("source_path", "format"), "source_path", "left")
    known = keyed(draft)
    with_agency = F.coalesce(F.col("format") == "B", F.lit(False))
    missed = []
    for part, key in ((subset.filter(with_agency), ("agency", "item", "amount_thb")), (subset.filter(~with_agency), ("item", "amount_thb"))):
        other = known.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct().withColumn("__hit", F.lit(1))
        hits = part.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]), "left")
        missed.append(hits.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__hit").isNull()).alias("unmatched")))
    soft = _rows(missed[0].unionByName(missed[1]), "V2", SOFT, "source_path", "n", F.col("unmatched"), bad="warned")
    return hard.unionByName(soft)


def scanned_files(sums: DataFrame, summaries: DataFrame, dataset: str, group: tuple[str, ...] = GROUP) -> DataFrame:
    """V3, by file with recognised text: its amounts without outliers against the sum of its summary, within 1 % (hard); groups that differ (soft).

    ``summaries``: source_path, the columns of ``group``, total. Files without a summary are ``no_summary``.
    """
    own = sums.filter(F.col("dataset") == dataset)
    files = _at(own, "file").filter("n_ocr > 0").select("source_path", "n", F.coalesce("kept", F.lit(0)).alias("got"))
    whole = summaries.groupBy("source_path").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("printed"))
    both = files.join(whole, "source_path", "left")
    off = F.when(F.col("printed") != 0, F.abs(F.col("got") - F.col("printed")) * 100.0 / F.abs(F.col("printed"))).otherwise(0.0)
    status = F.when(F.col("printed").isNull(), "no_summary").when(off <= FILE_TOTAL_PCT, "ok").otherwise("failed")
    hard = _rows(both, "V3", HARD, "source_path", "n", F.when(status == "failed", 1).otherwise(0), status)
    keys = ("source_path", *group)
    scanned = files.select("source_path").join(whole.select("source_path"), "source_path")
    got = _at(own, "group").join(scanned, "source_path", "left_semi").select(*keys, F.coalesce("kept", F.lit(0)).alias("total"))
    held = checks.reconciled(got, summaries.join(scanned, "source_path", "left_semi").select(*keys, "total"), keys)
    groups = held.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("wrong"))
    return hard.unionByName(_rows(groups, "V3", SOFT, "source_path", "n", F.col("wrong"), bad="warned"))


def unique_ids(sums: DataFrame, lines: DataFrame) -> DataFrame:
    """V4, by dataset: ids that are there more than once."""
    twice = lines.groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").groupBy("dataset").agg(F.count(F.lit(1)).alias("twice"))
    return _rows(_at(sums, "dataset").select("dataset", "n").join(twice, "dataset", "left"), "V4", HARD, "dataset", "n", F.col("twice"))


def documents_known(sums: DataFrame, docs: DataFrame) -> DataFrame:
    """V5: documents that lines name and the dimension (doc_id) lacks."""
    named = _at(sums, "document").filter(F.col("source_doc_id").isNotNull()).select("source_doc_id", "n")
    lost = named.join(docs.select(F.col("doc_id").alias("source_doc_id")).distinct().withColumn("hit", F.lit(1)), "source_doc_id", "left")
    return _rows(lost.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit").isNull()).alias("lost")), "V5", HARD, F.lit("documents"), "n", F.col("lost"))


def file_sizes(files: DataFrame, limit: int, total_limit: int) -> DataFrame:
    """V6: published files (length) above a limit, and all of them together above another."""
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("length") > limit).alias("large"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    single = _rows(seen, "V6", HARD, F.lit("files"), "n", F.col("large"))
    return single.unionByName(_rows(seen, "V6", HARD, F.lit("all files"), "n", (F.col("bytes") > total_limit).cast("int")))


def years_in_range(sums: DataFrame) -> DataFrame:
    """V7, by dataset: years out of range, or null without leave."""
    return _rows(_at(sums, "dataset"), "V7", HARD, "dataset", "n", F.col("n_out_of_range") + F.col("n_undated"))


def outlying_prices(lines: DataFrame) -> DataFrame:
    """V8: unit prices above ten times their key's 99.5th percentile, corrupt rows included. Soft."""
    priced = lines.filter(F.col("item_key").isNotNull() & (F.col("unit_price_thb") > 0)).select("item_key", "unit_price_thb")
    above = priced.join(flags.outlier_thresholds(lines, skip_corrupt=False), "item_key")
    seen = above.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("unit_price_thb") > F.col("threshold")).alias("wrong"))
    return _rows(seen, "V8", SOFT, F.lit("unit prices"), "n", F.col("wrong"), bad="warned")


def organisations_mapped(sums: DataFrame) -> DataFrame:
    """V9, by dataset: lines of unknown organisations; warned from 5 %. Soft."""
    share = percentage(F.col("n_unmapped"), F.col("n"), 10)
    return _rows(_at(sums, "dataset"), "V9", SOFT, "dataset", "n", F.col("n_unmapped"), F.when(share >= UNMAPPED_PCT, "warned").otherwise("ok"))


def files_listed(raw: DataFrame, sources: DataFrame, kind: str = "pdf") -> DataFrame:
    """V10: raw files (rel_path, kind) of a kind that the dimension does not list as that kind."""
    there = raw.filter(F.col("kind") == kind).select("rel_path").distinct()
    known = sources.filter(F.col("kind") == kind).select("rel_path").distinct().withColumn("hit", F.lit(1))
    seen = there.join(known, "rel_path", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit").isNull()).alias("lost"))
    return _rows(seen, "V10", HARD, F.lit(kind), "n", F.col("lost"))


def amounts(sums: DataFrame) -> DataFrame:
    """Beside the ten, from the grand total: negative amounts. Soft."""
    return _rows(_at(sums, "all"), "amounts", SOFT, F.lit("lines"), "n", F.col("n_negative"), bad="warned")


def report(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def verdict(found: DataFrame) -> DataFrame:
    """By check and severity: subjects, how many failed or are notable, whether it passes. Only a hard failure does not pass."""
    notable = F.count_if(F.col("status").isin("source_incomplete", "no_oracle", "no_summary", "warned"))
    failed = F.count_if(F.col("status") == "failed")
    by = found.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("subjects"), F.sum("problems").alias("problems"), failed.alias("failed"), notable.alias("notable"))
    return by.withColumn("passed", (F.col("severity") == SOFT) | (F.col("failed") == 0))
