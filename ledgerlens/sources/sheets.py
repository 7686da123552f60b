"""Spreadsheet layouts over rows of cells.

A workbook reader of any kind delivers rows (path, sheet, row_no, cells: array of strings); what a layout makes of
them is plain DataFrame work. Header rows are found by content, so that all files of a layout are read in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import source_id
from ..functions.numbers import baht, rate
from ..functions.text import clean, page_of
from ..schema import CORRUPT

# Column order of a disbursement workbook, fixed.
PBO_COLUMNS = ("year", "ministry", "agency", "strategy", "plan", "output_project", "activity", "budget_type", "capital_type", "item_name", "amount", "revised", "po", "disbursed", "disbursed_incl_po", "reserved", "carryover", "remaining_committed", "remaining_uncommitted", "remaining_in_progress", "remaining_reserved_extended", "remaining_total")
PBO_MONEY = PBO_COLUMNS[10:]
PBO_KEPT_MONEY = PBO_COLUMNS[10:17]
GRAND_TOTAL = "Grand Total"
#: Beyond this a money cell is damage, not money.
MAX_MONEY = 1e13
MILLION = 1_000_000

DRAFT_COLUMNS = ("min", "min_name", "agc", "agc_name", "group_budget", "plan_name", "output_name", "act_name", "objc", "objc_8_name", "cap_ncap", "item_name", "p_total_bud")
DRAFT_ALIASES = {"objc_8": "objc_8_name"}
LOCAL_COLUMNS = ("page", "plan", "work", "budget_group", "expense_category", "sub_category", "item", "amount", "department", "description", "legal_reference")
# Words of the sources, fixed values.
TOTAL_WORDS = ("รวม", "ยอดรวม", "รวมทั้งสิ้น", "ผลรวม")
UNIT_WORDS = {"ล้านบาท": 1_000_000, "พันบาท": 1_000, "บาท": 1}
#: A fuzzy header match needs at least this likeness.
HEADER_LIKENESS = 0.85


def cell(n: int) -> Column:
    """The n-th cell, from 0; null where blank or absent."""
    return F.nullif(F.trim(F.get("cells", F.lit(n))), F.lit(""))


def header_rows(rows: DataFrame, header: tuple[str, ...], within: int = 12) -> DataFrame:
    """path, sheet, header_row: the first row that begins with exactly these names (case and blanks aside)."""
    names = F.transform(F.slice("cells", 1, len(header)), lambda c: F.lower(F.trim(c)))
    hit = rows.filter((F.col("row_no") <= within) & (names == F.array(*[F.lit(h.lower()) for h in header])))
    return hit.groupBy("path", "sheet").agg(F.min("row_no").alias("header_row"))


def below_header(rows: DataFrame, headers: DataFrame) -> DataFrame:
    found = headers.select(F.col("path").alias("h_path"), F.col("sheet").alias("h_sheet"), "header_row")
    return rows.join(found, (F.col("path") == F.col("h_path")) & (F.col("sheet") == F.col("h_sheet")) & (F.col("row_no") > F.col("header_row"))).drop("h_path", "h_sheet", "header_row")


def named_cells(rows: DataFrame, header: tuple[str, ...]) -> DataFrame:
    return rows.select("path", "sheet", "row_no", *[cell(n).alias(c) for n, c in enumerate(header)])


def damaged(columns: tuple[str, ...]) -> Column:
    """Whether any money cell is text, or beyond all bounds."""
    out = F.lit(False)
    for c in columns:
        number = F.replace(F.col(c), F.lit(","), F.lit("")).try_cast("double")
        # What is no number has no size to compare: then it is damage if there is a text at all.
        out = out | F.when(F.trim(F.col(c)) == "-", False).otherwise(F.coalesce(F.abs(number) > MAX_MONEY, F.col(c).isNotNull()))
    return out


def disbursement_lines(rows: DataFrame, dataset: str = "pbo_disbursement") -> DataFrame:
    """Lines of disbursement workbooks: money in baht, all of it null in damaged rows, flags, identity. Total rows are left out."""
    body = named_cells(below_header(rows, header_rows(rows, PBO_COLUMNS)), PBO_COLUMNS)
    body = body.filter(~F.coalesce((F.col("year") == GRAND_TOTAL) | (F.col("ministry") == GRAND_TOTAL), F.lit(False))).withColumn("bad", damaged(PBO_MONEY))
    money = {c: F.when(~F.col("bad"), baht(F.col(c), MILLION)) for c in PBO_KEPT_MONEY}
    out = body.withColumns(money)
    flags = F.filter(F.array(F.when(F.col("item_name").isNull(), "empty_item_name"), F.when(F.col("bad"), CORRUPT), F.when(F.col("amount") < 0, "negative_amount")), lambda x: x.isNotNull())
    return out.select(
        source_id(F.lit(dataset), F.col("path"), F.col("sheet"), F.col("row_no")).alias("source_id"), F.lit(dataset).alias("dataset"), F.col("year").try_cast("int").alias("fiscal_year_be"),
        "ministry", "agency", "plan", "budget_type", F.col("item_name").alias("item_name_raw"), F.col("amount").alias("amount_thb"), F.col("revised").alias("revised_thb"), F.col("po").alias("po_thb"),
        F.col("disbursed").alias("disbursed_thb"), F.col("disbursed_incl_po").alias("disbursed_incl_po_thb"), F.col("reserved").alias("reserved_thb"), F.col("carryover").alias("carryover_thb"),
        rate(F.col("disbursed"), F.col("revised")).alias("disbursement_rate"), F.col("path").alias("source_path"), F.col("sheet").alias("source_sheet"), F.col("row_no").alias("source_row"), flags.alias("quality_flags"),
    )


def grand_totals(rows: DataFrame) -> DataFrame:
    """path, sheet, total: what a workbook's own total row says; an error column where it has more than one."""
    body = named_cells(below_header(rows, header_rows(rows, PBO_COLUMNS)), PBO_COLUMNS)
    hit = body.filter((F.col("year") == GRAND_TOTAL) | (F.col("ministry") == GRAND_TOTAL))
    return hit.groupBy("path", "sheet").agg(F.max(baht(F.col("amount"), MILLION)).alias("total"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


def draft_lines(rows: DataFrame, dataset: str = "act_2570_draft") -> DataFrame:
    """Lines of an act's draft: field-code header (one code may be written short), amounts in baht, rows without an item left out."""
    short = {v: k for k, v in DRAFT_ALIASES.items()}
    headers = header_rows(rows, DRAFT_COLUMNS, 6).unionByName(header_rows(rows, tuple(short.get(c, c) for c in DRAFT_COLUMNS), 6))
    body = named_cells(below_header(rows, headers), DRAFT_COLUMNS).filter(F.col("item_name").isNotNull())
    return body.select(source_id(F.lit(dataset), F.col("path"), F.col("sheet"), F.col("row_no")).alias("source_id"), F.lit(dataset).alias("dataset"), F.col("min").alias("ministry_code"), F.col("min_name").alias("ministry"),
                       F.col("agc").alias("agency_code"), F.col("agc_name").alias("agency"), F.col("item_name").alias("item_name_raw"), baht(F.col("p_total_bud")).alias("amount_thb"), F.col("row_no").alias("source_row"))


def local_lines(rows: DataFrame, dataset: str = "local_ordinance_2570", least: int = 100) -> DataFrame:
    """Lines of a local government's 11-column sheet; amounts below ``least`` are flagged."""
    body = named_cells(below_header(rows, header_rows(rows, LOCAL_COLUMNS)), LOCAL_COLUMNS).filter(F.col("item").isNotNull()).withColumn("amount_thb", baht(F.col("amount")))
    flags = F.filter(F.array(F.lit("upstream_ocr"), F.when(F.col("amount_thb") < least, "amount_outlier")), lambda x: x.isNotNull())
    return body.select(source_id(F.lit(dataset), F.col("path"), F.col("sheet"), F.col("row_no")).alias("source_id"), F.lit(dataset).alias("dataset"), "plan", "budget_group", "expense_category", F.col("item").alias("item_name_raw"),
                       "amount_thb", page_of(F.col("page")).alias("source_page"), "description", "legal_reference", F.col("row_no").alias("source_row"), flags.alias("quality_flags"))


def mapped_headers(rows: DataFrame, synonyms: dict[str, tuple[str, ...]], within: int = 12, needed: tuple[str, ...] = ()) -> DataFrame:
    """path, sheet, header_row, column, field: a sheet of unknown layout, its columns mapped by likeness to known names.

    The best row within reach is the header; in it, each field takes its likest column and each column one field.
    """
    known = rows.sparkSession.createDataFrame([(f, n, s.lower()) for f, names in synonyms.items() for n, s in enumerate(names)], "field string, rank int, synonym string")
    cells = rows.filter(F.col("row_no") <= within).select("path", "sheet", "row_no", F.posexplode("cells").alias("column", "cell")).withColumn("cell", F.lower(clean(F.col("cell")))).filter(F.length("cell") > 0)
    like = 1 - F.levenshtein("cell", "synonym") / F.greatest(F.length("cell"), F.length("synonym"))
    # Each text once against the few synonyms.
    scored = cells.select("cell").distinct().join(F.broadcast(known), F.abs(F.length("cell") - F.length("synonym")) <= F.greatest(F.length("cell"), F.length("synonym")) * (1 - HEADER_LIKENESS)).withColumn("score", like).filter(F.col("score") >= HEADER_LIKENESS)
    scored = cells.join(scored, "cell")
    order = [F.desc("score"), F.asc("rank"), F.asc("column")]
    place = ["path", "sheet", "row_no"]
    by_column = scored.withColumn("n", F.row_number().over(Window.partitionBy(*place, "column").orderBy(*order, "field"))).filter("n = 1")
    by_field = by_column.withColumn("n", F.row_number().over(Window.partitionBy(*place, "field").orderBy(*order))).filter("n = 1")
    rows_found = by_field.groupBy(*place).agg(F.collect_set("field").alias("fields"), F.count(F.lit(1)).alias("hits"))
    rows_found = rows_found.filter(F.size(F.array_intersect("fields", F.array(*map(F.lit, needed)).cast("array<string>"))) == len(needed))
    best = rows_found.withColumn("n", F.row_number().over(Window.partitionBy("path", "sheet").orderBy(F.desc("hits"), "row_no"))).filter("n = 1").select(*place)
    return by_field.join(best, place).select("path", "sheet", F.col("row_no").alias("header_row"), "column", "field")


def money_unit(hint: Column) -> Column:
    """The factor that a sheet states (millions, thousands, units); null where it states none: then nothing is mapped."""
    out = F.lit(None).cast("int")
    for word in reversed(UNIT_WORDS):
        out = F.when(hint.contains(word), UNIT_WORDS[word]).otherwise(out)
    return out


def without_subtotals(lines: DataFrame, item: str = "item_name_raw", agency: str = "agency") -> DataFrame:
    """Rows that begin with a word for total and name no agency are sums of others."""
    total = F.lit(False)
    for word in TOTAL_WORDS:
        total = total | F.coalesce(F.col(item).startswith(word), F.lit(False))
    return lines.filter(~(total & F.col(agency).isNull()))


def clamped_duplicates(files: DataFrame) -> DataFrame:
    """Files (path, content) by content: sha1, the first path, and the other paths of the same bytes."""
    marked = files.select("path", F.sha1("content").alias("sha1"))
    listed = marked.groupBy("sha1").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return listed.select("sha1", F.col("paths")[0].alias("path"), F.slice("paths", 2, 1_000_000).alias("duplicates"))
