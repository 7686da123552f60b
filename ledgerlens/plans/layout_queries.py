"""Registered queries over layouts found by content, and over the shards of published lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog, facets
from ..sources import layouts
from .standins import BUDGET, FLAGGED, budget_lines, flagged_lines, written

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _million(c: str):
    return F.concat(F.floor(F.col(c) / 1_000_000).cast("string"), F.lit("."), F.lpad((F.col(c) % 1_000_000).cast("string"), 6, "0"))


_SUMS = [(s, f) for s in layouts.SPLITS for f in layouts.SPLIT_FIELDS]
_KIND = {"current": "CASE WHEN NOT is_capital THEN {} END", "capital": "CASE WHEN is_capital THEN {} END", "total": "{}"}
_WIDE = " UNION ALL ".join(f"SELECT source_path AS path, 'sheet1_total' AS kind, NULL AS ministry, '{s}' AS split, '{f}' AS field, sum({_KIND[s].format(f)})::BIGINT::DOUBLE / 1e6 AS value FROM b WHERE fiscal_year_be % 2 = 1 GROUP BY source_path" for s, f in _SUMS)


@query(f"""WITH {BUDGET}, b AS (SELECT * FROM budget WHERE dataset = 'pbo_disbursement')
SELECT source_path AS path, 'sheet1_ministry' AS kind, ministry, 'total' AS split, 'amount_thb' AS field, sum(amount_thb)::BIGINT::DOUBLE / 1e6 AS value FROM b WHERE fiscal_year_be % 2 = 0 GROUP BY source_path, GROUPING SETS ((ministry), ())
UNION ALL {_WIDE}""")
def summary_sheet_totals(spark, d):
    """Summary sheets, in even years one total for each ministry, in odd years one row of nine sums."""
    lines = budget_lines(spark, d).filter("dataset = 'pbo_disbursement'").withColumn("path", F.col("source_path"))
    even, odd = lines.filter("fiscal_year_be % 2 = 0"), lines.filter("fiscal_year_be % 2 = 1")
    place = lambda n: (F.lit("Sheet1").alias("sheet"), n.alias("row_no"))
    total = F.lit(layouts.LABEL_TOTAL)
    by = even.groupBy("path", "ministry", "ministry_code").agg(F.sum("amount_thb").alias("v"))
    narrow = by.select("path", *place(F.col("ministry_code").cast("long") + 10), F.array("ministry", _million("v")).alias("cells"))
    every = even.groupBy("path").agg(F.sum("amount_thb").alias("v"))
    foot = every.select("path", *place(F.lit(100_000).cast("long")), F.array(total, _million("v")).alias("cells"))
    head = every.select("path", *place(F.lit(2).cast("long")), F.array(F.lit(layouts.LABEL_HEAD), F.lit("sum")).alias("cells"))
    which = {"current": ~F.col("is_capital"), "capital": F.col("is_capital"), "total": F.lit(True)}
    sums = odd.groupBy("path").agg(*[F.sum(F.when(which[s], F.col(f))).alias(f"{s}_{f}") for s, f in _SUMS])
    wide = sums.select("path", *place(F.lit(9).cast("long")), F.array(total, *[F.coalesce(_million(f"{s}_{f}"), F.lit("-")) for s, f in _SUMS]).alias("cells"))
    wide_head = sums.select("path", *place(F.lit(4).cast("long")), F.array(F.lit(layouts.LABEL_HEAD), *[F.lit("x")] * 9).alias("cells"))
    rows = narrow.unionByName(foot).unionByName(head).unionByName(wide).unionByName(wide_head)
    return layouts.summary_totals(rows)


def _subset_lists(spark, d):
    """Draft lines as a list: a title at row 2, a header at row 3, items below, some of them blank."""
    lines = budget_lines(spark, d).filter("dataset = 'act_2570_draft'").withColumn("path", F.col("source_path"))
    item = F.when(F.substring("source_id", 1, 2) != "2d", F.col("item_name_raw")).otherwise(" ")
    kind = F.when(F.col("is_capital"), layouts.CAPITAL).when(F.col("fiscal_year_be") % 2 == 0, layouts.CURRENT).otherwise("-")
    body = lines.select("path", F.lit("s").alias("sheet"), (F.col("source_row") + 10).alias("row_no"), F.array(F.lit("1"), "ministry", "agency", "plan", item, kind, F.format_number("amount_thb", 0)).alias("cells"))
    files = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_thb").alias("v"))
    title = files.select("path", F.lit("s").alias("sheet"), F.lit(2).alias("row_no"), F.array(F.lit(""), F.concat(F.format_number("n", 0), F.lit(" รายการ  |  งบรวม "), F.format_number("v", 0), F.lit(" บาท  | x"))).alias("cells"))
    names = F.array(*map(F.lit, ("ลำดับ", "กระทรวง", "หน่วยงาน", "แผนงาน", "รายการ", "ประจำ/ลงทุน", "งบประมาณ (บาท)")))
    return body.unionByName(title).unionByName(files.select("path", F.lit("s").alias("sheet"), F.lit(3).alias("row_no"), names.alias("cells")))


@query(f"""WITH {BUDGET} SELECT substr(sha1('act_2570_partial|' || source_path || '|s|' || (source_row + 10)), 1, 16) AS source_id, ministry, agency, plan, item_name_raw, amount_thb,
CASE WHEN is_capital THEN true WHEN fiscal_year_be % 2 = 0 THEN false END AS is_capital FROM budget WHERE dataset = 'act_2570_draft' AND substr(source_id, 1, 2) <> '2d'""")
def subset_list_lines(spark, d):
    return layouts.subset_lines(_subset_lists(spark, d), "act_2570_partial").select("source_id", "ministry", "agency", "plan", "item_name_raw", "amount_thb", "is_capital")


@query(f"WITH {BUDGET} SELECT source_path AS path, 's' AS sheet, count(*) AS n, sum(amount_thb)::BIGINT AS amount_thb FROM budget WHERE dataset = 'act_2570_draft' GROUP BY source_path")
def subset_list_titles(spark, d):
    return layouts.subset_titles(_subset_lists(spark, d))


@query(f"""WITH {BUDGET} SELECT substr(sha1('local_ordinance_2570|' || source_path || '|' || source_sheet || '|' || (source_row + 1)), 1, 16) AS source_id, plan, item_name_raw, amount_thb, item_qty::DOUBLE AS item_qty, agency,
CASE WHEN substr(source_id, 1, 1) < '4' THEN 'agency_from_divison_typo_column' ELSE '' END AS quality_flags FROM budget WHERE dataset = 'local_ordinance_2570' AND substr(source_id, 1, 2) <> '2d'""")
def typed_sheet_lines(spark, d):
    """Sheets with named columns in an order of their own; of some lines the agency stands in the misspelt column."""
    lines = budget_lines(spark, d).filter("dataset = 'local_ordinance_2570'").select(F.col("source_path").alias("path"), F.col("source_sheet").alias("sheet"), "*")
    lost = F.substring("source_id", 1, 1) < "4"
    item = F.when(F.substring("source_id", 1, 2) != "2d", F.col("item_name_raw")).otherwise("")
    given = {"Divison": F.when(lost, F.col("agency")), "Project ": item, "amount": F.col("amount_thb").cast("string"), "number": F.col("item_qty").cast("string"), "Budgetary_Plan": F.col("plan"), "Division": F.when(~lost, F.col("agency")), "FCY": F.lit("x")}
    body = lines.select("path", "sheet", (F.col("source_row") + 1).alias("row_no"), F.array(*given.values()).alias("cells"))
    head = body.select("path", "sheet").distinct().select("path", "sheet", F.lit(1).alias("row_no"), F.array(*map(F.lit, given)).alias("cells"))
    found = layouts.typed_lines(body.unionByName(head))
    return found.select("source_id", "plan", "item_name_raw", "amount_thb", "item_qty", "agency", F.array_join("quality_flags", "|").alias("quality_flags"))


_NAMES = {"item_name": ("item_name", "item"), "amount_thb": ("amount", "budget amount"), "agency": ("agency",)}


def _tables(spark, d):
    """Committee lines as tables in thousands: a title, a header, a blank row, the lines, a sum, two blank rows and a note."""
    lines = budget_lines(spark, d).filter("dataset = 'committee_table'").select(F.col("source_path").alias("path"), F.col("source_sheet").alias("sheet"), "*")
    place = F.row_number().over(Window.partitionBy("path", "sheet").orderBy("source_id"))
    thousand = lambda c: F.concat(F.floor(F.col(c) / 1000).cast("string"), F.lit("."), F.lpad((F.col(c) % 1000).cast("string"), 3, "0"))
    body = lines.select("path", "sheet", (place + 4).alias("row_no"), F.array("agency", "item_name_raw", thousand("amount_thb"), "plan").alias("cells"))
    books = lines.groupBy("path", "sheet").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("amount_thb").alias("v"))
    # Of one ministry no unit is stated, of another the header lacks the item.
    title = F.when(F.col("sheet") == "2", "x").otherwise("ตาราง (พันบาท)")
    second = F.when(F.col("sheet") == "9", "remark").otherwise("Item_Name")
    blank = F.array(F.lit(""), F.lit(" "))
    extra = [(F.lit(1), F.array(title)), (F.lit(2), F.array(F.lit("agency"), second, F.lit("Amount"), F.lit("plan"))), (F.lit(3), blank), (F.lit(4), blank), (F.col("n") + 5, F.array(F.lit(""), F.lit("รวมทั้งสิ้น"), thousand("v"))),
             (F.col("n") + 6, blank), (F.col("n") + 7, blank), (F.col("n") + 8, F.array(F.lit("note"), F.lit("7")))]
    around = F.array(*[F.struct(n.cast("int").alias("row_no"), cells.alias("cells")) for n, cells in extra])
    # What a layout makes of the rows reads them several times.
    return written(body.unionByName(books.select("path", "sheet", F.inline(around))), "tables")


def _unknown(rows):
    return layouts.unknown_tables(rows, _NAMES, regions=written(layouts.table_regions(rows), "regions"))


@query(f"""WITH {BUDGET} SELECT source_path AS path, source_sheet AS sheet, 2 AS header_row, 5 AS first_row, count(*)::INT + 5 AS last_row, CASE WHEN source_sheet <> '2' THEN 1000 END AS unit,
CASE source_sheet WHEN '9' THEN 'columns missing' WHEN '2' THEN 'unit unknown' END AS reason FROM budget WHERE dataset = 'committee_table' GROUP BY ALL""")
def unknown_tables(spark, d):
    return _unknown(_tables(spark, d)).select("path", "sheet", "header_row", "first_row", "last_row", "unit", "reason")


@query(f"""WITH {BUDGET} SELECT source_path AS path, source_sheet AS sheet, item_name_raw, agency, amount_thb FROM budget WHERE dataset = 'committee_table' AND source_sheet NOT IN ('2', '9')""")
def unknown_table_lines(spark, d):
    rows = _tables(spark, d)
    return layouts.table_lines(rows, written(_unknown(rows), "unknown")).select("path", "sheet", "item_name_raw", "agency", "amount_thb")


# ---- shards


_PATH = """CASE dataset WHEN 'pbo_disbursement' THEN dataset || '/' || fiscal_year_be || '/' || ministry_code WHEN 'act_2570_draft' THEN dataset || '/' || ministry_code
  WHEN 'committee_table' THEN dataset || '/' || source_doc_id ELSE dataset || '/' || coalesce(province, '_unmapped') END"""


def _located(spark, d):
    return facets.shard_path(flagged_lines(spark, d))


@query(f"WITH {FLAGGED} SELECT DISTINCT group_key, path FROM (SELECT *, {_PATH} AS path FROM cl) WHERE path NOT LIKE 'committee_table/%'")
def item_shard_paths(spark, d):
    """Indexes of shards back to paths; some point beyond the dictionary, some at shards that the manifest no longer lists."""
    index = catalog.file_index(_located(spark, d)).select("group_key", F.explode("paths").alias("path"))
    numbered = facets.numbered_paths(index)
    held = index.join(numbered, "path").select("group_key", "index")
    held = held.unionByName(held.select("group_key", (F.col("index") + 10_000_000).alias("index")))
    return facets.resolved_paths(held, numbered, numbered.filter("path NOT LIKE 'committee_table/%'")).select("group_key", "path")


@query(f"WITH {BUDGET}, p AS (SELECT *, {_PATH} AS path FROM budget) SELECT DISTINCT path FROM p WHERE dataset IN ('pbo_disbursement', 'committee_table') AND fiscal_year_be IN (2540, 2541)")
def shards_of_caller(spark, d):
    located = facets.shard_path(budget_lines(spark, d))
    asked = located.filter("dataset IN ('pbo_disbursement', 'committee_table')").select("path").distinct().unionByName(spark.createDataFrame([("no such shard",)], "path string"))
    return facets.shards_of(asked, located.filter("fiscal_year_be IN (2540, 2541)"))


@query(f"""WITH {FLAGGED}, p AS (SELECT *, {_PATH} AS path FROM cl), r AS (SELECT group_key, row_number() OVER (ORDER BY count(*) DESC, group_key) AS rank FROM p GROUP BY group_key),
f AS (SELECT path, min(rank) AS rank FROM p JOIN r USING (group_key) GROUP BY path) SELECT path, (row_number() OVER (ORDER BY rank, path))::INT AS place FROM f ORDER BY place LIMIT 30""")
def first_shards(spark, d):
    """The shards of the items with most lines, each once, 30 at most."""
    lines = catalog.grouped_lines(_located(spark, d))
    best = lines.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))
    # The order itself is the rank: no number is needed.
    ranked = lines.select("group_key", "path").distinct().join(best, "group_key").select(F.struct((-F.col("n")).alias("n"), "group_key").alias("rank"), "path")
    return facets.first_shards(ranked, 30)


@query(f"WITH {BUDGET} SELECT path, count(*) AS rows FROM (SELECT *, {_PATH} AS path FROM budget) GROUP BY path ORDER BY rows, path LIMIT 10")
def smallest_shards(spark, d):
    return facets.smallest(facets.shard_summary(facets.shard_path(budget_lines(spark, d))), 10, "rows").select("path", "rows")
