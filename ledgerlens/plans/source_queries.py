"""Registered queries over layouts, item names, organisations and published shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, years
from ..functions.places import PROVINCES
from ..operators import checks, facets, items, normalize, orgs, proposals
from ..sources import files, sheets, writers
from .standins import BUDGET, budget_lines, scratch, table, written

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _workbooks(spark, d):
    """Disbursement lines as rows of cells: a header at row 3, a total row last, some damaged cells."""
    lines = budget_lines(spark, d).filter("dataset = 'pbo_disbursement'")
    million = lambda c: F.concat(F.floor(F.col(c) / 1_000_000).cast("string"), F.lit("."), F.lpad((F.col(c) % 1_000_000).cast("string"), 6, "0"))
    bad = F.substring("source_id", 1, 2) == "1c"
    given = [F.col("fiscal_year_be").cast("string"), F.col("ministry"), F.col("agency"), F.lit("s"), F.col("plan"), F.lit("o"), F.lit("a"), F.col("budget_type"), F.lit("c"), F.when(F.substring("source_id", 1, 2) != "2d", F.col("item_name_raw")).otherwise("")]
    money = [million("amount_thb"), million("revised_thb"), F.lit("-"), F.when(bad, "see note").otherwise(million("disbursed_thb")), *[F.lit("-")] * 8]
    body = lines.select(F.col("source_path").alias("path"), F.lit("Sheet1").alias("sheet"), (F.col("source_row") + 10).alias("row_no"), F.array(*given, *money).alias("cells"))
    files = lines.groupBy(F.col("source_path").alias("path")).agg(F.sum("amount_thb").alias("amount_thb"))
    head = F.struct(F.lit(3).cast("long").alias("row_no"), F.array(*[F.lit(c.upper()) for c in sheets.PBO_COLUMNS]).alias("cells"))
    foot = F.struct(F.lit(2_000_000_000).cast("long").alias("row_no"), F.concat(F.array(F.lit(sheets.GRAND_TOTAL)), F.array_repeat(F.lit(""), 9), F.array(million("amount_thb"))).alias("cells"))
    # A layout reads the rows twice, for the header and for what is below.
    return written(body.unionByName(files.select("path", F.lit("Sheet1").alias("sheet"), F.inline(F.array(head, foot)))), "workbooks")


@query(f"""WITH {BUDGET} SELECT substr(sha1('pbo_disbursement|' || source_path || '|Sheet1|' || (source_row + 10)), 1, 16) AS source_id, fiscal_year_be, agency,
  CASE WHEN substr(source_id, 1, 2) <> '2d' THEN item_name_raw END AS item_name_raw, CASE WHEN substr(source_id, 1, 2) <> '1c' THEN amount_thb END AS amount_thb, CASE WHEN substr(source_id, 1, 2) <> '1c' THEN disbursed_thb END AS disbursed_thb,
  round(CASE WHEN substr(source_id, 1, 2) <> '1c' AND revised_thb <> 0 THEN disbursed_thb / revised_thb END, 6) AS disbursement_rate,
  array_to_string(list_filter([CASE WHEN substr(source_id, 1, 2) = '2d' THEN 'empty_item_name' END, CASE WHEN substr(source_id, 1, 2) = '1c' THEN 'corrupt_row' END], lambda x: x IS NOT NULL), '|') AS quality_flags
FROM budget WHERE dataset = 'pbo_disbursement'""")
def workbook_lines(spark, d):
    found = sheets.disbursement_lines(_workbooks(spark, d))
    return found.select("source_id", "fiscal_year_be", "agency", "item_name_raw", "amount_thb", "disbursed_thb", F.round("disbursement_rate", 6).alias("disbursement_rate"), F.array_join("quality_flags", "|").alias("quality_flags"))


@query(f"WITH {BUDGET} SELECT source_path AS path, 'Sheet1' AS sheet, sum(amount_thb)::BIGINT AS total, false AS ambiguous FROM budget WHERE dataset = 'pbo_disbursement' GROUP BY source_path")
def workbook_totals(spark, d):
    return sheets.grand_totals(_workbooks(spark, d))


_FIELDS = {"item_name": ("item_name", "item"), "amount_thb": ("amount", "budget amount"), "agency": ("agency",), "plan": ("plan",)}


@query(f"WITH {BUDGET} SELECT DISTINCT source_path AS path, 'Sheet1' AS sheet, 3 AS header_row, c.c AS \"column\", c.f AS field FROM budget, (VALUES (2, 'agency'), (4, 'plan'), (9, 'item_name'), (10, 'amount_thb')) AS c(c, f) WHERE dataset = 'pbo_disbursement'")
def workbook_headers(spark, d):
    return sheets.mapped_headers(_workbooks(spark, d), _FIELDS, needed=("item_name", "amount_thb", "plan"))


_PROVINCES = "[" + ", ".join(f"'{p}'" for p in PROVINCES) + "]"


def _named_parts(spark, d):
    """Part names with a quantity and a place."""
    places = F.array(*map(F.lit, PROVINCES))
    marker = F.when(F.col("p_partkey") % 3 == 0, "จำนวน").otherwise("ใหม่")
    name = F.concat_ws(" ", "p_name", marker, F.col("p_size").cast("string"), F.lit("เครื่อง ตำบลช้างเผือก"), F.concat(F.lit("จังหวัด"), places[(F.col("p_partkey") % 77).cast("int")]))
    return table(spark, d, "part").withColumn("item_name_raw", name)


# What follows a part's name, and what the parser must make of it: key, quantity, unit, province, tambon, specification, flags.
_ENDINGS = (
    (" จำนวน 12 ชุด", "", 12, "ชุด", None, None, "", ""),
    (" 3 คัน", "", 3, "คัน", None, None, "", ""),
    (" 2 คัน 5 คัน", "", 5, "คัน", None, None, "", "qty_parsed_low_conf"),
    (" จำนวน 4 เครื่อง พร้อม 2 ชุด", " พร้อม", 4, "เครื่อง", None, None, "", "qty_parsed_low_conf"),
    (" กว้าง 4.50 เมตร", " กว้าง 4.5 เมตร", None, None, None, None, "4.5 เมตร", ""),
    (" ขนาด 1,260 ลูกบาศก์เมตร ตำบลโคกก่อง จังหวัดตรัง", " ขนาด 1260 ลูกบาศก์เมตร", None, None, "ตรัง", "โคกก่อง", "1260 ลูกบาศก์เมตร", ""),
    (" ระยะทาง 1,200 เมตร", "", 1200, "เมตร", None, None, "", "qty_is_measure"),
    (" พื้นที่ 35 ไร่ จ.เลย", "", 35, "ไร่", "เลย", None, "", "qty_is_measure"),
    (" 30,000 บีทียู", " 30000 บีทียู", None, None, None, None, "30000 บีทียู", ""),
    (" แบบติดผนัง 18000 BTU จำนวน 2 เครื่อง", " แบบติดผนัง 18000 btu", 2, "เครื่อง", None, None, "18000 BTU|ติดผนัง", ""),
    (" AC0405", " ac0405", None, None, None, None, "", ""),
    (" IPv6 7 ชุด", " ipv6", 7, "ชุด", None, None, "", ""),
    (" ต.นาดี,บ้านใหม่ อ.เมือง จ.พังงา", "", None, None, "พังงา", "นาดี", "", ""),
    (" หมู่ที่ 3,5 ตำบลนาโยง", "", None, None, None, "นาโยง", "", ""),
    (" โรงเรียนวัดใหม่ ตำบลบางแก้ว จังหวัดชลบุรี", "", None, None, "ชลบุรี", "บางแก้ว", "", ""),
    (" ก่อสร้างโรงเรียนวัดใหม่ ตำบลบางแก้ว", " ก่อสร้างโรงเรียนวัดใหม่", None, None, None, "บางแก้ว", "", "org_tail_uncertain"),
    (" กรุงเทพมหานคร", "", None, None, "กรุงเทพมหานคร", None, "", ""),
    (" เทศบาลเมืองลำพูน", "", None, None, "ลำพูน", None, "", ""),
    (" บ้านพัก 6 หลัง", " บ้านพัก", 6, "หลัง", None, None, "", ""),
    (" บ้านคลอง16 หมู่ 2", "", None, None, None, None, "", ""),
    (" (แบบพิเศษ) 0.50 ตัน", " แบบพิเศษ 0.5 ตัน", None, None, None, None, "0.5 ตัน", ""),
    (" ติดตั้งระบบความยาวรวม", " ติดตั้งระบบ", None, None, None, None, "", ""),
)


def _ending_values() -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join(f"({k}, {', '.join(quote(v) for v in row)})" for k, row in enumerate(_ENDINGS))


@query(f"""SELECT p_partkey, lower(p_name) || key AS item_key, province, tambon, qty::DOUBLE AS item_qty, unit AS item_unit, specs, flags
FROM part JOIN (VALUES {_ending_values()}) AS e(k, ending, key, qty, unit, province, tambon, specs, flags) ON k = p_partkey % {len(_ENDINGS)}""")
def parse_items(spark, d):
    endings = F.array(*[F.lit(row[0]) for row in _ENDINGS])
    named = table(spark, d, "part").withColumn("item_name_raw", F.concat("p_name", endings[(F.col("p_partkey") % len(_ENDINGS)).cast("int")]))
    found = items.parse_items(named)
    return found.select("p_partkey", "item.item_key", "item.province", "item.tambon", "item.item_qty", "item.item_unit", F.array_join("item.spec_tokens", "|").alias("specs"), F.array_join("item.quality_flags", "|").alias("flags"))


@query(f"""WITH x AS (SELECT *, p_partkey % 3 = 0 OR p_size < 20 AS sure, CASE WHEN p_partkey % 11 = 0 THEN ['corrupt_row'] WHEN p_partkey % 13 = 0 THEN ['upstream_ocr'] ELSE []::VARCHAR[] END AS own FROM part)
SELECT p_partkey::VARCHAR AS source_id, 2560 AS fiscal_year_be, 2017 AS fiscal_year_ce, CASE p_partkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'state_enterprise' WHEN 2 THEN 'central' ELSE 'local' END AS gov_level,
  CASE WHEN p_partkey % 5 = 0 THEN 'ตรัง' ELSE {_PROVINCES}[1 + p_partkey % 77] END AS province, CASE WHEN p_partkey % 7 = 0 THEN 99 WHEN sure AND p_size > 0 AND NOT list_contains(own, 'corrupt_row') THEN round_even(round(p_retailprice * 1000)::BIGINT / p_size, 0)::BIGINT END AS unit_price_thb,
  CASE WHEN p_partkey % 2 = 0 THEN true ELSE false END AS is_capital, array_to_string(list_concat(own, CASE WHEN p_size >= 20 AND p_partkey % 3 <> 0 THEN ['qty_parsed_low_conf'] ELSE [] END), '|') AS quality_flags,
  round(CASE WHEN p_size % 10 <> 0 THEN 5.0::DOUBLE / (p_size % 10) END, 6) AS disbursement_rate FROM x""")
def normalized_lines(spark, d):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    raw = _named_parts(spark, d).select(
        k.cast("string").alias("source_id"), F.lit(2560).alias("fiscal_year_be"), F.when(k % 4 == 0, "75000").when(k % 4 == 1, "50000").when(k % 4 == 2, "12").otherwise(none).alias("ministry_code"), F.lit("เทศบาลเมือง").alias("agency"),
        F.when(k % 5 == 0, "ตรัง").alias("province"), F.when(k % 7 == 0, 99).cast("long").alias("unit_price_thb"), F.round(F.col("p_retailprice") * 1000).cast("long").alias("amount_thb"), F.when(k % 2 == 0, "รายจ่ายลงทุน").otherwise("รายจ่ายประจำ").alias("budget_type"),
        F.when(k % 11 == 0, F.array(F.lit("corrupt_row"))).when(k % 13 == 0, F.array(F.lit("upstream_ocr"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"), F.lit(5).cast("long").alias("disbursed_thb"), (F.col("p_size") % 10).cast("long").alias("revised_thb"), "item_name_raw",
    )
    found = normalize.facts(raw)
    return found.select("source_id", F.col("fiscal_year_be").cast("int").alias("fiscal_year_be"), F.col("fiscal_year_ce").cast("int").alias("fiscal_year_ce"), "gov_level", "province", "unit_price_thb", "is_capital", F.array_join("quality_flags", "|").alias("quality_flags"), F.round("disbursement_rate", 6).alias("disbursement_rate"))


@query("""WITH f AS (SELECT n_nationkey, n_name, s_suppkey, s_name, s_suppkey % 9 = 4 AS lost, s_suppkey % 9 = 5 AS spoilt, s_suppkey % 7 NOT IN (3, 5) AND s_suppkey % 11 = 6 AS hurt FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT *, s_suppkey % 7 <> 5 AND NOT (lost AND hurt) AS found FROM f)
SELECT CASE WHEN lost THEN 'nowhere' WHEN spoilt THEN 'Xinistry of ' || n_name ELSE 'Ministry of ' || n_name END AS ministry,
  CASE WHEN s_suppkey % 7 = 3 THEN s_name || '  ' WHEN s_suppkey % 7 = 5 THEN 'unheard of ' || s_suppkey WHEN hurt THEN 'X' || substr(s_name, 2) ELSE s_name END AS agency,
  CASE WHEN found OR NOT lost THEN n_nationkey::VARCHAR END AS ministry_code, CASE WHEN found THEN s_suppkey::VARCHAR END AS agency_code,
  CASE WHEN NOT found THEN 'none' WHEN hurt OR spoilt THEN 'fuzzy' ELSE 'exact' END AS method, CASE WHEN found THEN '' WHEN lost THEN 'ministry_unmapped|org_unmapped' ELSE 'org_unmapped' END AS flags FROM r""")
def resolve_orgs(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    facts = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_nationkey").cast("string").alias("min_code"), F.concat(F.lit("Ministry of "), "n_name").alias("min_name"), F.col("s_suppkey").cast("string").alias("agc_code"), F.col("s_name").alias("agc_name"), F.col("s_suppkey").alias("row_no"))
    k, spoilt = F.col("row_no"), lambda c: F.concat(F.lit("X"), F.substring(c, 2, 1_000))
    ministry = F.when(k % 9 == 4, "nowhere").when(k % 9 == 5, spoilt(F.col("min_name"))).otherwise(F.col("min_name"))
    agency = F.when(k % 7 == 3, F.concat("agc_name", F.lit("  "))).when(k % 7 == 5, F.concat(F.lit("unheard of "), k.cast("string"))).when(k % 11 == 6, spoilt(F.col("agc_name"))).otherwise(F.col("agc_name"))
    asked = facts.select(ministry.alias("ministry"), agency.alias("agency"))
    return orgs.resolve(asked, orgs.organisations(facts)).select("ministry", "agency", "ministry_code", "agency_code", "method", F.array_join("flags", "|").alias("flags"))


_PATH = """CASE dataset WHEN 'pbo_disbursement' THEN dataset || '/' || fiscal_year_be || '/' || ministry_code WHEN 'act_2570_draft' THEN dataset || '/' || ministry_code
  WHEN 'committee_table' THEN dataset || '/' || source_doc_id ELSE dataset || '/' || coalesce(province, '_unmapped') END"""


@query(f"WITH {BUDGET} SELECT path, count(*) AS n, sum(amount_thb)::BIGINT AS amount_thb, true AS in_manifest FROM (SELECT *, {_PATH} AS path FROM budget) GROUP BY path")
def published_shards(spark, d):
    """Writes the shards into the shared folder, reads them back, and sees that the manifest lists each."""
    folder = scratch(spark, "shards")
    writers.write_shards(facets.shard_path(budget_lines(spark, d)), folder)
    listed = writers.manifest(spark, folder).select(F.url_decode("partition").alias("path")).distinct().withColumn("in_manifest", F.lit(True))
    back = writers.read_shards(spark, folder).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_thb").alias("amount_thb"))
    return back.join(listed, "path", "left").withColumn("in_manifest", F.coalesce("in_manifest", F.lit(False)))


# ---- layouts that the disbursement workbooks don't have


_FIELD_CELLS = {"min": "ministry_code", "min_name": "ministry", "agc_name": "agency", "item_name": "item_name_raw", "p_total_bud": "amount_thb"}


@query(f"""WITH {BUDGET} SELECT substr(sha1('act_2570_draft|' || source_path || '|Data|' || (source_row + 10)), 1, 16) AS source_id, ministry_code, ministry, agency, item_name_raw, amount_thb
FROM budget WHERE dataset = 'act_2570_draft' AND substr(source_id, 1, 2) <> '2d'""")
def draft_workbook_lines(spark, d):
    """Field-code headers at row 2, in odd years with the short name of one code; rows without an item are left out."""
    rows = budget_lines(spark, d).filter("dataset = 'act_2570_draft'")
    item = F.when(F.substring("source_id", 1, 2) != "2d", F.col("item_name_raw")).otherwise(" ")
    cells = F.array(*[item if c == "item_name" else F.col(_FIELD_CELLS[c]).cast("string") if c in _FIELD_CELLS else F.lit("-") for c in sheets.DRAFT_COLUMNS])
    body = rows.select(F.col("source_path").alias("path"), F.lit("Data").alias("sheet"), (F.col("source_row") + 10).alias("row_no"), cells.alias("cells"))
    short = {v: k for k, v in sheets.DRAFT_ALIASES.items()}
    heads = [F.array(*map(F.lit, sheets.DRAFT_COLUMNS)), F.array(*[F.lit(short.get(c, c)) for c in sheets.DRAFT_COLUMNS])]
    odd = F.right("path", F.lit(4)).cast("int") % 2 == 1
    head = body.select("path").distinct().select("path", F.lit("Data").alias("sheet"), F.lit(2).alias("row_no"), F.when(odd, heads[1]).otherwise(heads[0]).alias("cells"))
    return sheets.draft_lines(body.unionByName(head)).select("source_id", "ministry_code", "ministry", "agency", "item_name_raw", "amount_thb")


@query(f"""WITH {BUDGET}, b AS (SELECT *, CASE WHEN substr(source_id, 1, 2) = '1c' THEN 50 ELSE amount_thb END AS a FROM budget WHERE dataset = 'local_ordinance_2570')
SELECT substr(sha1('local_ordinance_2570|' || source_path || '|' || source_sheet || '|' || (source_row + 10)), 1, 16) AS source_id, plan, item_name_raw, a AS amount_thb, (source_row % 90)::INT AS source_page,
  CASE WHEN a < 100 THEN 'upstream_ocr|amount_outlier' ELSE 'upstream_ocr' END AS quality_flags FROM b""")
def local_workbook_lines(spark, d):
    rows = budget_lines(spark, d).filter("dataset = 'local_ordinance_2570'")
    amount = F.when(F.substring("source_id", 1, 2) == "1c", F.lit("50")).otherwise(F.col("amount_thb").cast("string"))
    given = {"page": F.concat((F.col("source_row") % 90).cast("string"), F.lit("/90")), "plan": F.col("plan"), "item": F.col("item_name_raw"), "amount": amount}
    cells = F.array(*[given.get(c, F.lit("x")) for c in sheets.LOCAL_COLUMNS])
    body = rows.select(F.col("source_path").alias("path"), F.col("source_sheet").alias("sheet"), (F.col("source_row") + 10).alias("row_no"), cells.alias("cells"))
    head = body.select("path", "sheet").distinct().select("path", "sheet", F.lit(1).alias("row_no"), F.array(*[F.lit(f" {c} ") for c in sheets.LOCAL_COLUMNS]).alias("cells"))
    found = sheets.local_lines(body.unionByName(head))
    return found.select("source_id", "plan", "item_name_raw", "amount_thb", F.col("source_page").cast("int").alias("source_page"), F.array_join("quality_flags", "|").alias("quality_flags"))


@query(f"""WITH {BUDGET}, b AS (SELECT source_id, CASE WHEN substr(source_id, 1, 1) < '4' THEN 'รวม' || item_name_raw ELSE item_name_raw END AS item, CASE WHEN substr(source_id, 2, 1) > '7' THEN agency END AS agency FROM budget)
SELECT source_id FROM b WHERE NOT (item LIKE 'รวม%' AND agency IS NULL)""")
def lines_without_subtotals(spark, d):
    item = F.when(F.substring("source_id", 1, 1) < "4", F.concat(F.lit(sheets.TOTAL_WORDS[0]), "item_name_raw")).otherwise(F.col("item_name_raw"))
    marked = budget_lines(spark, d).withColumns({"item_name_raw": item, "agency": F.when(F.substring("source_id", 2, 1) > "7", F.col("agency"))})
    return sheets.without_subtotals(marked).select("source_id")


@query("""WITH s AS (SELECT 'd' || s_nationkey AS f, s_name, s_suppkey FROM supplier), p AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'other' ELSE f END AS f, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' vol 2' ELSE '' END AS stem FROM s)
SELECT s.f || '/' || s_name || '.xlsx' AS sheet_path, p.f || '/' || p.stem || '.pdf' AS pdf_path FROM s JOIN p ON s.f = p.f AND starts_with(p.stem, s_name)""")
def sheets_with_pdfs(spark, d):
    k, folder = F.col("s_suppkey"), F.concat(F.lit("d"), F.col("s_nationkey").cast("string"))
    suppliers = table(spark, d, "supplier")
    books = suppliers.select(F.concat(folder, F.lit("/"), "s_name", F.lit(".xlsx")).alias("path"))
    pdfs = suppliers.select(F.concat(F.when(k % 3 == 0, "other").otherwise(folder), F.lit("/"), "s_name", F.when(k % 2 == 0, " vol 2").otherwise(""), F.lit(".pdf")).alias("path"))
    return files.paired_pdfs(books, pdfs)


@query("""WITH f AS (SELECT c_custkey AS k, (c_custkey % 40) / 10 AS pct FROM customer), j AS (SELECT k, pct, CASE WHEN k % 3 = 0 THEN pct + (k % 5) / 4 END AS known FROM f)
SELECT k, CASE WHEN pct < 1 THEN 'ok' WHEN abs(pct - known) <= 0.5 THEN 'known_gap' ELSE 'new' END AS status FROM j""")
def check_statuses(spark, d):
    found = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), ((F.col("c_custkey") % 40) / 10).alias("pct"))
    known = found.filter("k % 3 = 0").select("k", (F.col("pct") + (F.col("k") % 5) / 4).alias("pct"))
    return checks.resolve_status(found.withColumn("ok", F.col("pct") < 1), known, "k").select("k", "status")


@query("""WITH x AS (SELECT o_orderkey AS line_id, o_orderkey % 7 AS n, (o_orderkey % 50)::DOUBLE AS q, o_totalprice AS p FROM orders),
y AS (SELECT line_id, CASE n WHEN 2 THEN q + 1 ELSE q END AS qty, CASE n WHEN 2 THEN 5.0 WHEN 4 THEN 9.0 ELSE p END::DOUBLE AS unit_price_thb FROM x) SELECT *, round(qty * unit_price_thb, 2) AS total_thb FROM y""")
def edited_lines(spark, d):
    """Of some lines a new quantity and price, of others a price and a quantity out of bounds, which is ignored."""
    n, q = F.col("o_orderkey") % 7, (F.col("o_orderkey") % 50).cast("double")
    orders = table(spark, d, "orders")
    edits = orders.filter(n.isin(2, 4)).select(F.col("o_orderkey").alias("line_id"), F.when(n == 2, q + 1).otherwise(-1.0).alias("qty"), F.when(n == 2, 5.0).otherwise(9.0).alias("unit_price_thb"))
    found = proposals.edited(orders.select(F.col("o_orderkey").alias("line_id"), q.alias("qty"), F.col("o_totalprice").cast("double").alias("unit_price_thb")), edits)
    return found.withColumn("total_thb", F.round("total_thb", 2))


@query("SELECT o_orderkey AS ref, round(o_totalprice)::BIGINT + CASE WHEN o_orderkey % 7 = 5 THEN 1 ELSE 0 END AS amount_thb, o_orderkey % 7 = 3 AS corrected FROM orders")
def comparables_corrected(spark, d):
    n, amount = F.col("o_orderkey") % 7, F.round("o_totalprice").cast("long")
    orders = table(spark, d, "orders")
    given = orders.select(F.col("o_orderkey").alias("ref"), (amount + F.when(n.isin(3, 5), 1).otherwise(0)).cast("long").alias("amount_thb"))
    return proposals.corrected_comparables(given, orders.filter(n != 5).select(F.col("o_orderkey").alias("ref"), amount.alias("amount_thb")), ("amount_thb",))


@query("""WITH x AS (SELECT c_custkey AS k, c_name AS n FROM customer)
SELECT k, CASE k % 4 WHEN 0 THEN (k % 90)::INT WHEN 1 THEN (k % 90)::INT END AS page, CASE WHEN length(n) > 12 THEN substr(n, 1, 12) || '…' ELSE n END AS short,
  CASE k % 3 WHEN 0 THEN 'องค์การบริหารส่วนตำบล' || k WHEN 1 THEN 'เทศบาลเมือง' || k ELSE 'x' || k END AS gov, regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(sha1(n), 1, 6) AS slug,
  'say ' || k || ',5 ' || n AS quote, k % 2 = 0 OR k % 2 <> 0 AND k % 5 = 0 AS this_year, k % 100 = 25 AS holds FROM (SELECT k, n FROM x)""")
def text_helpers(spark, d):
    k, n = F.col("c_custkey"), F.col("c_name")
    s = k.cast("string")
    page = F.when(k % 4 == 0, F.concat((k % 90).cast("string"), F.lit(" / 90"))).when(k % 4 == 1, (k % 90).cast("string")).when(k % 4 == 2, "p. 3").otherwise("")
    gov = F.when(k % 3 == 0, F.concat(F.lit("อบต. "), s)).when(k % 3 == 1, F.concat(F.lit("ทม."), s)).otherwise(F.concat(F.lit("x"), s))
    sheet = F.when(k % 2 == 0, "Data").when(k % 5 == 0, "ปี ๒๕๗๐ Data 2570").otherwise("Data 2570-2571")
    held = text.holds_number(F.concat(F.lit("a "), (k % 100).cast("string"), F.lit(" b 125 c 25.5 d 1,250")), "25")
    return table(spark, d, "customer").select(k.alias("k"), text.page_of(page).alias("page"), text.shortened(n, 12).alias("short"), text.expand_local_gov(gov).alias("gov"), text.slug(n).alias("slug"),
                                              F.replace(text.quoted(F.concat(F.lit('“Say’ '), s, F.lit(",๕   "), n)), F.lower(n), n).alias("quote"), years.targets_year(sheet, 2570).alias("this_year"), held.alias("holds"))


_ROOTS = """CASE o_orderkey % 6 WHEN 0 THEN 'PBO/2567/k' || o_orderkey || '.xlsx' WHEN 1 THEN 'OPEN SSO/งบ 67/k.pdf' WHEN 2 THEN 'กมธ.ติดตามงบ/ครั้งที่ ' || o_orderkey % 50 || ' (12 มกราคม 2569)/topic  ' || o_custkey || '/x/office ' || o_custkey % 9 || '/ปี 2568.pdf'
  WHEN 3 THEN 'งบประมาณ  north ' || o_custkey % 7 || '/' || o_orderkey % 4 || ' - ' || CASE o_custkey % 3 WHEN 0 THEN 'ฟังก์ชัน' WHEN 1 THEN 'เทศบาล x' ELSE 'plain' END || '/2566-2568.pdf' WHEN 4 THEN 'กมธ.ติดตามงบ/ครั้งที่ ' || o_orderkey % 50 || '/only/k.pdf' ELSE 'other 2565/ปี 2566/k.pdf' END"""


@query(f"""SELECT o_orderkey AS k, {_ROOTS} AS rel_path, CASE WHEN m = 0 THEN 'pbo' WHEN m = 1 THEN 'open_sso' WHEN m = 3 THEN 'province_budget' ELSE 'committee' END AS collection, CASE WHEN m IN (2, 4) THEN (o_orderkey % 50)::INT END AS meeting_no,
  CASE WHEN m = 2 THEN '2569-01-12' END AS meeting_date, CASE m WHEN 2 THEN 'topic ' || o_custkey WHEN 4 THEN 'only' END AS topic, CASE m WHEN 1 THEN 'สำนักงานประกันสังคม' WHEN 2 THEN 'office ' || o_custkey % 9 END AS agency_guess, CASE WHEN m = 3 THEN 'north ' || o_custkey % 7 END AS province,
  CASE WHEN m = 3 THEN CASE o_custkey % 3 WHEN 0 THEN 'central' WHEN 1 THEN 'local' END END AS gov_level, CASE WHEN m = 3 THEN CASE o_custkey % 3 WHEN 0 THEN 'ฟังก์ชัน' WHEN 1 THEN 'เทศบาล x' ELSE 'plain' END END AS level,
  CASE m WHEN 0 THEN '2567' WHEN 1 THEN '2567' WHEN 2 THEN '2568' WHEN 3 THEN '2566,2567,2568' WHEN 5 THEN '2565' ELSE '' END AS fiscal_years FROM (SELECT *, o_orderkey % 6 AS m FROM orders)""")
def inventory_fields(spark, d):
    """What the folders of a path say, for a path made of each order."""
    paths = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr(_ROOTS).alias("rel_path"))
    found = paths.withColumn("of", files.folder_fields(F.col("rel_path"))).select("k", "rel_path", "of.*")
    return found.withColumn("fiscal_years", F.array_join("fiscal_years", ","))
