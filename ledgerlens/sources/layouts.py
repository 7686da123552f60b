"""Layouts whose columns are found by content: summary sheets, subset lists, typed sheets, tables of unknown form.

As in ``sheets``, rows are (path, sheet, row_no, cells). Rows of a sheet are delivered without gaps, blank ones included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import source_id
from ..functions.numbers import baht
from ..functions.text import clean, page_of
from .sheets import mapped_headers, money_unit, without_subtotals

SUBSET_FLAG, TYPO_FLAG = "subset_of_act_2570_draft", "agency_from_divison_typo_column"
# Words and columns of the sources, fixed values.
LABEL_HEAD, LABEL_TOTAL = "ป้ายชื่อแถว", "ผลรวมทั้งหมด"
SPLITS, SPLIT_FIELDS = ("current", "capital", "total"), ("amount_thb", "revised_thb", "disbursed_thb")
SUBSET_HEAD_WORDS = ("กระทรวง", "หน่วยงาน")
SUBSET_FIELDS = {"บาท": "amount_thb", "ประจำ/ลงทุน": "cap_ncap_raw", "ประเภทรายจ่าย": "expense_category", "รายการ": "item_name_raw", "แผนงาน": "plan", "หน่วยงาน": "agency", "กระทรวง": "ministry"}
SUBSET_NEEDED = ("ministry", "agency", "plan", "item_name_raw", "amount_thb")
CAPITAL, CURRENT = "รายจ่ายลงทุน", "รายจ่ายประจำ"
TYPED_COLUMNS = {"REF_DOC_Page": "source_page", "Budgetary_Plan": "plan", "Budgetary_USER": "activity", "Budgetary_TYPE": "budget_type", "Budgetary_TYPE2": "expense_category", "Pre Project": "output_project", "Project": "item_name_raw", "number": "item_qty", "amount": "amount_thb", "Division": "agency", "Divison": "agency_typo", "FCY": "description"}
#: A subset list's header: within so many rows, with so many texts; its title so many rows above at most.
SUBSET_WITHIN, SUBSET_TEXTS, TITLE_ABOVE = 6, 5, 4
#: A table's header holds so many texts, a number follows within so many rows, its unit is stated so many rows above at most.
TABLE_TEXTS, NUMBER_WITHIN, UNIT_ABOVE = 4, 3, 6
_SHEET = ("path", "sheet")
SEPARATOR = "\x1f"
_FIGURE = r"(\d+(\.\d*)?|\.\d+)"


def _text(n: Column | int) -> Column:
    return F.nullif(F.trim(clean(F.get("cells", n if isinstance(n, Column) else F.lit(n)))), F.lit(""))


def _cleaned() -> Column:
    """All cells cleaned in one call, blank ones as empty texts."""
    plain = F.transform("cells", lambda c: F.translate(F.coalesce(c, F.lit("")), SEPARATOR, " "))
    return F.transform(F.split(clean(F.array_join(plain, SEPARATOR)), SEPARATOR), lambda c: F.trim(c))


def _below(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows below their sheet's header, with the other columns of ``heads`` (path, sheet, header_row, ...)."""
    return rows.join(heads, list(_SHEET)).filter(F.col("row_no") > F.col("header_row"))


def summary_totals(rows: DataFrame, sheet: str = "Sheet1") -> DataFrame:
    """path, kind, ministry, split, field, value: what a workbook's summary sheet says, in the sheet's own unit.

    A header of two cells is followed by one total for each ministry (kind sheet1_ministry; the grand total has no
    ministry), a wider one by a total row with three amounts for each of three splits (kind sheet1_total). Workbooks
    without such a sheet have no rows here.
    """
    own = rows.filter((F.col("sheet") == sheet))
    labelled = own.filter(F.get("cells", F.lit(0)) == LABEL_HEAD)
    heads = labelled.groupBy(*_SHEET).agg(F.min("row_no").alias("header_row"), F.min_by(F.size("cells"), "row_no").alias("width"))
    body = _below(own, heads).withColumn("name", _text(0)).filter(F.col("name").isNotNull())
    number = lambda n: F.regexp_replace(_text(n), ",", "").try_cast("double")
    total = F.col("name") == LABEL_TOTAL
    narrow = body.filter("width <= 2").select("path", F.lit("sheet1_ministry").alias("kind"), F.when(~total, F.col("name")).alias("ministry"), F.lit("total").alias("split"), F.lit("amount_thb").alias("field"), number(1).alias("value"))
    first = body.filter((F.col("width") > 2) & total).withColumn("n", F.row_number().over(Window.partitionBy(*_SHEET).orderBy("row_no"))).filter("n = 1")
    cells = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(f).alias("field"), number(1 + 3 * i + k).alias("value")) for i, s in enumerate(SPLITS) for k, f in enumerate(SPLIT_FIELDS)])
    wide = first.select("path", F.lit("sheet1_total").alias("kind"), F.lit(None).cast("string").alias("ministry"), F.inline(cells))
    return narrow.unionByName(wide)


def _claimed(words: tuple[str, ...]) -> Column:
    """The place of each word's column: from left to right a header cell goes to the first word that it holds and that has no column yet."""
    none = F.array(*[F.lit(None).cast("int")] * len(words))
    known = F.array(*map(F.lit, words))
    texts = F.transform("texts", lambda c, i: F.struct(i.alias("i"), c.alias("t")))

    def take(held: Column, cell: Column) -> Column:
        free = F.transform(held, lambda v, k: v.isNull() & F.contains(cell["t"], F.get(known, k)))
        won = F.array_position(free, True) - 1
        return F.transform(held, lambda v, k: F.when(k == won, cell["i"]).otherwise(v))

    return F.aggregate(texts, none, take)


def subset_headers(rows: DataFrame) -> DataFrame:
    """path, sheet, header_row, and the place of each field (null where the header has none), of subset lists."""
    top = rows.filter(F.col("row_no") <= SUBSET_WITHIN).withColumn("texts", _cleaned())
    named = F.exists("texts", lambda t: F.contains(t, F.lit(SUBSET_HEAD_WORDS[0])) | F.contains(t, F.lit(SUBSET_HEAD_WORDS[1])))
    hit = top.filter((F.size(F.filter("texts", lambda t: F.length(t) > 0)) >= SUBSET_TEXTS) & named)
    first = hit.groupBy(*_SHEET).agg(F.min("row_no").alias("header_row"), F.min_by("texts", "row_no").alias("texts"))
    placed = first.withColumn("at", _claimed(tuple(SUBSET_FIELDS)))
    return placed.select(*_SHEET, "header_row", *[F.get("at", F.lit(k)).alias(f"{c}_at") for k, c in enumerate(SUBSET_FIELDS.values())])


def subset_titles(rows: DataFrame) -> DataFrame:
    """path, sheet, n, amount_thb: the number of items and the sum that the title above a subset list states."""
    heads = subset_headers(rows).select(*_SHEET, "header_row")
    said = r"([\d,]+)\s*รายการ.*?งบรวม\s*([\d,]+)\s*บาท"
    above = rows.join(heads, list(_SHEET)).filter((F.col("row_no") < F.col("header_row")) & (F.col("row_no") >= F.col("header_row") - TITLE_ABOVE))
    cells = above.select(*_SHEET, "row_no", F.posexplode("cells").alias("at", "cell")).withColumn("cell", clean(F.col("cell"))).filter(F.col("cell").rlike(said))
    one = cells.groupBy(*_SHEET).agg(F.min_by("cell", F.struct("row_no", "at")).alias("title"))
    plain = lambda k: F.regexp_replace(F.regexp_extract("title", said, k), ",", "").cast("long")
    return one.select(*_SHEET, plain(1).alias("n"), plain(2).alias("amount_thb"))


def subset_lines(rows: DataFrame, dataset: str) -> DataFrame:
    """Lines of subset lists whose header has all needed fields; rows with a blank item (blank rows, totals) are left out."""
    heads = subset_headers(rows)
    for field in SUBSET_NEEDED:
        heads = heads.filter(F.col(f"{field}_at").isNotNull())
    value = {c: _text(F.col(f"{c}_at")) for c in SUBSET_FIELDS.values()}
    body = _below(rows, heads).filter(value["item_name_raw"].isNotNull())
    kind = value["cap_ncap_raw"]
    return body.select(
        source_id(F.lit(dataset), F.col("path"), F.col("sheet"), F.col("row_no")).alias("source_id"), F.lit(dataset).alias("dataset"), F.lit("central").alias("gov_level"),
        *[value[c].alias(c) for c in ("ministry", "agency", "plan", "expense_category", "cap_ncap_raw", "item_name_raw")], F.when(kind == CAPITAL, True).when(kind == CURRENT, False).alias("is_capital"),
        baht(F.get("cells", F.col("amount_thb_at"))).alias("amount_thb"), F.col("path").alias("source_path"), F.col("sheet").alias("source_sheet"), F.col("row_no").alias("source_row"), F.array(F.lit(SUBSET_FLAG)).alias("quality_flags"),
    )


def typed_lines(rows: DataFrame, dataset: str = "local_ordinance_2570") -> DataFrame:
    """Lines of sheets whose first row names typed columns in any order; rows without a project are left out.

    The agency is taken from a misspelt column where the right one is blank, and flagged.
    """
    names = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    heads = rows.filter(F.col("row_no") == 1).filter(F.array_contains(names, "Project") & F.array_contains(names, "amount"))
    heads = heads.select(*_SHEET, F.lit(1).alias("header_row"), *[F.nullif(F.array_position(names, c), F.lit(0)).alias(f"{f}_at") for c, f in TYPED_COLUMNS.items()])
    value = {f: _text((F.col(f"{f}_at") - 1).cast("int")) for f in TYPED_COLUMNS.values()}
    body = _below(rows, heads).filter(value["item_name_raw"].isNotNull())
    flags = F.filter(F.array(F.when(value["agency"].isNull() & value["agency_typo"].isNotNull(), TYPO_FLAG)), lambda x: x.isNotNull())
    plain = ("plan", "activity", "budget_type", "expense_category", "output_project", "item_name_raw", "description")
    return body.select(
        source_id(F.lit(dataset), F.col("path"), F.col("sheet"), F.col("row_no")).alias("source_id"), F.lit(dataset).alias("dataset"), *[value[c].alias(c) for c in plain],
        F.coalesce(value["agency"], value["agency_typo"]).alias("agency"), value["item_qty"].try_cast("double").alias("item_qty"), baht(F.get("cells", (F.col("amount_thb_at") - 1).cast("int"))).alias("amount_thb"),
        page_of(value["source_page"]).alias("source_page"), F.col("row_no").alias("source_row"), flags.alias("quality_flags"),
    )


def table_regions(rows: DataFrame) -> DataFrame:
    """path, sheet, header_row, first_row, last_row: the largest table of each sheet, the uppermost of equal ones.

    A header has TABLE_TEXTS cells that aren't numbers; the data begin with the first row that holds a number, at most
    NUMBER_WITHIN rows below, and end before two blank rows.
    """
    seen = rows.withColumn("__t", _cleaned()).withColumn("__t", F.filter("__t", lambda t: F.length(t) > 0))
    n_numbers = F.size(F.filter("__t", lambda t: F.regexp_replace(t, "[, ]", "").rlike(rf"^([-+]?{_FIGURE}|\([-+]?{_FIGURE}\))$")))
    order, upward = Window.partitionBy(*_SHEET).orderBy("row_no"), Window.partitionBy(*_SHEET).orderBy(F.desc("row_no"))
    marked = seen.select(*_SHEET, "row_no", (F.size("__t") - n_numbers >= TABLE_TEXTS).alias("head"), (n_numbers > 0).alias("number"), (F.size("__t") == 0).alias("blank"))
    stop = F.when(F.col("blank") & F.coalesce(F.lag("blank").over(order), F.lit(False)), F.col("row_no"))
    # The next stop below is the last one met from the bottom up: a frame that reaches to the end would be summed anew for each of its rows.
    marked = marked.withColumn("stop", stop).withColumns({
        "next_stop": F.min("stop").over(upward.rowsBetween(Window.unboundedPreceding, -1)),
        "bottom": F.max(F.when(~F.col("blank"), F.col("row_no"))).over(Window.partitionBy(*_SHEET)),
    })
    body = F.struct(F.col("row_no").alias("first_row"), F.coalesce(F.col("next_stop") - 2, F.col("bottom")).alias("last_row"))
    marked = marked.withColumn("body", F.min(F.when(F.col("number"), body)).over(order.rowsBetween(1, NUMBER_WITHIN)))
    found = marked.filter("head AND body IS NOT NULL").select(*_SHEET, F.struct((F.col("body.first_row") - F.col("body.last_row")).alias("size"), F.col("row_no").alias("header_row"), "body").alias("r"))
    return found.groupBy(*_SHEET).agg(F.min("r").alias("r")).select(*_SHEET, "r.header_row", "r.body.*")


def unknown_tables(rows: DataFrame, synonyms: dict[str, tuple[str, ...]], needed: tuple[str, ...] = ("item_name", "amount_thb"), regions: DataFrame | None = None) -> DataFrame:
    """path, sheet, header_row, first_row, last_row, columns (field to place), unit, reason: null where the table can be read.

    ``regions``: those of ``table_regions``, for callers that have written them; they are read several times.
    """
    regions = table_regions(rows) if regions is None else regions
    heads = rows.join(regions.select(*_SHEET, F.col("header_row").alias("row_no")), [*_SHEET, "row_no"])
    fields = mapped_headers(heads, synonyms, within=2**31 - 1).groupBy(*_SHEET).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "column")))).alias("columns"))
    near = rows.join(regions, list(_SHEET)).filter((F.col("row_no") >= F.col("header_row") - UNIT_ABOVE) & (F.col("row_no") < F.col("first_row")))
    units = near.groupBy(*_SHEET).agg(money_unit(clean(F.array_join(F.flatten(F.collect_list("cells")), " | "))).alias("unit"))
    every = rows.select(*_SHEET).distinct().join(regions, list(_SHEET), "left").join(fields, list(_SHEET), "left").join(units, list(_SHEET), "left")
    held = F.coalesce(F.map_keys("columns"), F.array().cast("array<string>"))
    lacking = F.size(F.array_except(F.array(*map(F.lit, needed)), held)) > 0
    reason = F.when(F.col("header_row").isNull(), "no table").when(lacking, "columns missing").when(F.col("unit").isNull(), "unit unknown")
    return every.withColumn("reason", reason)


def table_lines(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """path, sheet, row_no, item_name_raw, agency, amount_thb of the tables that can be read; rows without item or amount and sums are left out."""
    body = rows.join(tables.filter("reason IS NULL"), list(_SHEET)).filter(F.col("row_no").between(F.col("first_row"), F.col("last_row")))
    held = body.select(*_SHEET, "row_no", "unit", *[F.get("cells", F.col("columns")[f]).alias(f) for f in ("item_name", "agency", "amount_thb")])
    # Money in the sheet's own unit, so that its decimals are kept.
    found = held.select(*_SHEET, "row_no", *[F.nullif(F.trim(clean(F.col(f))), F.lit("")).alias(c) for f, c in (("item_name", "item_name_raw"), ("agency", "agency"))], baht(F.col("amount_thb"), F.col("unit")).alias("amount_thb"))
    return without_subtotals(found.filter("item_name_raw IS NOT NULL AND amount_thb IS NOT NULL"))
