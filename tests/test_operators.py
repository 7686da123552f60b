"""Operators whose rules SQL can't show: parsers, chunks, validation, implied prices, sources and sinks."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import documents, facets, flags, items, orgs, proposals, search
from ledgerlens.operators.implied import implied_base
from ledgerlens.sources import files, sheets, writers
from ledgerlens.streaming.ingest import ingest_new_files, latest


@pytest.mark.parametrize(
    "amounts, want",
    [
        ([279000, 223200, 139500], (27900, 3)), ([335000, 134000, 100500, 67000, 33500], (33500, 5)), ([27900], None), ([27900, 55800], None), ([500001, 500002, 500003, 500004], None),
        ([100000, 200000, 500000], None), ([279000, 223200, 139500, 999999], (27900, 3)), ([279000, 223200, 111111, 222223, 350009], None), ([27900] * 3, None), ([279000, 223200, 139499], None),
    ],
)
def test_implied_price(amounts, want):
    values, counts = np.unique(amounts, return_counts=True)
    assert implied_base(values, counts) == want


@pytest.mark.parametrize(
    "name, want",
    [
        ("เครื่องพิมพ์ จำนวน 5 เครื่อง ตำบลช้างเผือก อำเภอเมืองเชียงใหม่ จังหวัดเชียงใหม่", {"item_key": "เครื่องพิมพ์", "item_qty": 5.0, "item_unit": "เครื่อง", "province": "เชียงใหม่", "tambon": "ช้างเผือก", "quality_flags": []}),
        ("ก่อสร้างถนน กว้าง 4 เมตร ระยะทาง 1,200 เมตร จังหวัดลำปาง", {"item_qty": 1200.0, "item_unit": "เมตร", "province": "ลำปาง", "quality_flags": ["qty_is_measure"], "spec_tokens": ["4 เมตร"]}),
        ("รถยนต์ 2 คัน 3 คัน", {"item_qty": 3.0, "quality_flags": ["qty_parsed_low_conf"]}),
        ("AC0405 pump", {"item_qty": None, "item_key": "ac0405 pump"}),
        ("จังหวัดลำปาง", {"item_key": "จังหวัดลำปาง", "province": "ลำปาง"}),
        ("เครื่องปรับอากาศ 30,000 บีทียู", {"item_key": "เครื่องปรับอากาศ 30000 บีทียู", "spec_tokens": ["30000 บีทียู"]}),
    ],
)
def test_item_names(name, want):
    got = items.parse_name(name)
    assert {k: got[k] for k in want} == want
    assert items.parse_name(got["item_key"])["item_key"] == got["item_key"] != ""


def test_items_are_parsed_once_a_name(spark):
    lines = spark.createDataFrame([(k, ["จำนวน 25 ชุด", "25 ชุด", None][k % 3], 100 * k) for k in range(9)], "id int, item_name_raw string, amount_thb long")
    got = items.parse_items(lines)
    assert got.count() == 9 and got.filter("item.item_qty = 25").count() == 6
    priced = got.withColumn("p", items.computed_price(F.array().cast("array<string>"), F.col("item.item_qty"), F.col("amount_thb"), F.lit(None).cast("long"), F.col("item_name_raw")))
    assert priced.filter("p is not null").select("item_name_raw").distinct().count() == 1


def test_organisations(spark):
    facts = spark.createDataFrame([("1", "Ministry of Roads", "11", "Highway Dept", 1), ("1", "Ministry of Roads", "11", "Highway Dept", 2), ("1", "Min Roads", "11", "Highways Bureau", 3), ("2", "Ministry of Water", "21", "Dams", 4)], "min_code string, min_name string, agc_code string, agc_name string, row_no int")
    master = orgs.organisations(facts)
    asked = spark.createDataFrame([("Min Roads", "Highways Bureau"), ("Ministry of Roads", "Highway Deptt"), ("Unknown", "Dams"), ("Ministry of Water", "Highway Dept"), ("Ministry of Roads", None)], "ministry string, agency string")
    got = {(r["ministry"], r["agency"]): (r["ministry_code"], r["agency_code"], r["method"], r["flags"]) for r in orgs.resolve(asked, master).collect()}
    assert got["Min Roads", "Highways Bureau"] == ("1", "11", "alias", [])
    assert got["Ministry of Roads", "Highway Deptt"][:3] == ("1", "11", "fuzzy")
    assert got["Unknown", "Dams"] == ("2", "21", "exact", [])
    assert got["Ministry of Water", "Highway Dept"] == ("2", None, "none", ["org_unmapped"])
    assert got["Ministry of Roads", None][1] is None
    extended = orgs.with_synthetic(master.filter("level = 'ministry'"), ["Roads", "Space"])
    assert [r["name"] for r in extended.filter("synthetic").collect()] == ["Space"]


def greedy(lines, limit):
    out = []
    for line in lines:
        if out and len(out[-1]) + 1 + len(line) <= limit:
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


def test_chunks(spark):
    texts = ["a\n\nbb\n" + "c" * 50 + "\nd\n" + "e" * 9, "", None, "x" * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in documents.chunks(docs, limit=12).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    want = {k: greedy([x for x in t.split("\n") if x.strip()], 12) for k, t in enumerate(texts) if t}
    assert got == want


def test_table_blocks_and_document_reading(spark):
    cells = spark.createDataFrame([(1, 0, None, ["x"]), (1, 1, "t", ["a"]), (1, 2, "t", ["b"]), (1, 3, None, ["y"]), (1, 4, "t", ["c"])], "doc_id long, atom_no int, table_id string, row array<string>")
    assert sorted(r["rows"] for r in documents.table_blocks(cells).collect()) == [[["a"], ["b"]], [["c"]]]
    chunks = spark.createDataFrame([(1, 0, 1, "Alpha Beta"), (1, 1, 2, "gamma" * 500), (2, 0, 1, "alpha")], "doc_id long, chunk_no int, page int, text string")
    assert [r["chunk_no"] for r in documents.read(chunks, 1, query="ALPHA  beta").collect()] == [0]
    assert len(documents.read(chunks, 1, page=2).first()["text"]) == 2001
    dims = spark.createDataFrame([(1, "pdf", [2569]), (2, "other", [2570]), (3, "xlsx", [2570])], "doc_id long, kind string, fiscal_years array<int>")
    assert [r["doc_id"] for r in documents.facet_filter(dims, years=(2570,)).collect()] == [3]
    state = documents.enriched(dims.withColumn("has_text_layer", F.lit(None).cast("boolean")), spark.createDataFrame([(1, True)], "doc_id long, has_text_layer boolean"), chunks, spark.createDataFrame([(2,)], "source_doc_id long"))
    assert {r["doc_id"]: r["extracted"] for r in state.collect()} == {1: "text", 2: "table", 3: "none"}


def test_search_ranks_the_closest_first(spark):
    keys = ["air conditioner 18000 btu", "air conditioner 24000 btu", "printer laser", "air pump", "conditioner"]
    catalog = spark.createDataFrame([(n, k, 10, [2569], n % 2 == 0) for n, k in enumerate(keys)], "id int, key string, n_lines int, years array<int>, has_unit_price boolean")
    index = search.build_index(catalog)
    assert search.search(index, catalog, "air conditionr 18000").first()["id"] == 0
    assert [r["id"] for r in search.search(index, catalog, "print").collect()] == [2]
    assert search.search(index, catalog, "zzzz").count() == 0
    assert all(r["has_unit_price"] for r in search.search(index, catalog, "air", priced_only=True, years=(2569,)).collect())
    assert search.query_terms(spark, "12 air") == ["air"] and search.query_terms(spark, "12") == ["12"]


def test_flags_keep_null_semantics(spark):
    lines = spark.createDataFrame([("a", "k", "n", 10, ["x"]), ("b", "k", "n", 10_000_000, None), ("c", None, "n gizmo", None, [])], "source_id string, item_key string, item_name_raw string, unit_price_thb long, quality_flags array<string>")
    got = {r["source_id"]: r["quality_flags"] for r in flags.flag_lines(lines, "gizmo").collect()}
    # Null flags are unknown: such a row sets no threshold, but can be above it.
    assert got == {"a": ["x"], "b": ["unit_price_outlier"], "c": ["lump_sum_category"]}


def test_proposal_edits_and_comparables(spark):
    lines = spark.createDataFrame([("l1", 2.0, 100.0), ("l2", 1.0, 50.0)], "line_id string, qty double, unit_price_thb double")
    got = {r["line_id"]: r["total_thb"] for r in proposals.edited(lines, spark.createDataFrame([("l1", 3.0, None), ("l2", 1e12, 60.0)], "line_id string, qty double, unit_price_thb double")).collect()}
    assert got == {"l1": 300.0, "l2": 60.0}
    fixed = proposals.corrected_comparables(spark.createDataFrame([("r", 5), ("s", 6)], "ref string, price int"), spark.createDataFrame([("r", 7)], "ref string, price int"), ("price",)).orderBy("ref").collect()
    assert [(r["price"], r["corrected"]) for r in fixed] == [(7, True), (6, False)]


def test_stratified_sample(spark):
    lines = spark.range(1000).select(F.col("id").cast("string").alias("source_id"), F.when(F.col("id") < 30, "rare").otherwise("common").alias("budget_type"))
    got = facets.stratified_sample(lines, "budget_type", {"rare": 0.5, "common": 0.5}, 100)
    counts = {r["budget_type"]: r["count"] for r in got.groupBy("budget_type").count().collect()}
    assert counts == {"rare": 30, "common": 70} and got.select("source_id").distinct().count() == 100


def test_shards_manifest_and_versions(spark, tmp_path):
    lines = spark.createDataFrame([(f"{k:04d}", f"d/{k % 3}", ["x", None][k % 2], "key") for k in range(600)], "source_id string, path string, agency string, item_key string")
    folder = str(tmp_path / "out")
    writers.write_shards(lines, folder, bytes_per_row=100_000)
    listed = writers.manifest(spark, folder).collect()
    assert {r["partition"] for r in listed} == {"d/0", "d/1", "d/2"} or {r["partition"] for r in listed} == {"d%2F0", "d%2F1", "d%2F2"}
    assert writers.read_shards(spark, folder).count() == 600 and writers.oversized(spark, folder).count() == 0
    assert writers.content_version(lines, "source_id") == writers.content_version(lines.repartition(7), "source_id") != writers.content_version(lines.filter("source_id <> '0001'"), "source_id")
    assert writers.records_per_file(1000, 1_000_000, 100_000) == 90
    writers.write_buckets(lines.select(F.col("source_id").alias("group_key")), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).count() == 600


def test_inventory(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "ครั้งที่ 2 12 มิถุนายน 2569").mkdir()
    (raw / "ครั้งที่ 2 12 มิถุนายน 2569" / "plan.pdf").write_bytes(b"%PDF-1.7 x")
    (raw / "copy.bin").write_bytes(b"%PDF-1.7 x")
    (raw / "t.xlsx").write_bytes(b"PK\x03\x04 xl/workbook.xml")
    got = files.inventory(spark, str(raw)).orderBy("rel_path").collect()
    assert [(r["rel_path"], r["kind"]) for r in got] == [("copy.bin", "pdf"), ("t.xlsx", "xlsx")]
    assert len(got[0]["duplicates"]) == 1
    assert files.not_done(files.inventory(spark, str(raw)), files.inventory(spark, str(raw)).limit(0)).count() == 2
    pages = spark.createDataFrame([(1, 1, "fine text"), (2, 1, "��ab")], "doc_id long, page int, text string")
    assert [r["doc_id"] for r in files.readable_pages(pages).collect()] == [1]
    pairs = files.paired_pdfs(spark.createDataFrame([("a/b.xlsx",)], "path string"), spark.createDataFrame([("a/b vol 1.pdf",), ("a/c.pdf",)], "path string"))
    assert [r["pdf_path"] for r in pairs.collect()] == ["a/b vol 1.pdf"]


def test_json_sources(spark, tmp_path):
    from pyspark.sql.types import LongType, StructType

    with gzip.open(tmp_path / "x.json.gz", "wt") as out:
        out.write('{"a": 1}\n{"a": "no"}\n')
    schema = StructType().add("a", LongType())
    rows = files.read_json(spark, str(tmp_path / "x.json.gz"), schema, strict=False)
    good, bad = files.valid_and_rejected(rows.cache(), F.col("a").isNotNull())
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(Exception):
        files.read_json(spark, str(tmp_path / "x.json.gz"), schema).collect()


def test_sheets(spark):
    kind = "path string, sheet string, row_no int, cells array<string>"
    draft = list(sheets.DRAFT_COLUMNS)
    short = [c if c != "objc_8_name" else "objc_8" for c in draft]
    rows = [("a", "Data", 1, draft), ("a", "Data", 2, ["1", "m", "11", "ag", "g", "p", "o", "a", "x", "y", "z", "item", "1,000.5"]), ("a", "Data", 3, ["1"] * 11 + ["", "5"]), ("b", "Data", 2, short), ("b", "Data", 3, ["2"] * 11 + ["thing", "7"])]
    got = sheets.draft_lines(spark.createDataFrame(rows, kind)).orderBy("amount_thb").collect()
    assert [(r["item_name_raw"], r["amount_thb"]) for r in got] == [("thing", 7), ("item", 1001)]
    local = [("c", "s", 1, list(sheets.LOCAL_COLUMNS)), ("c", "s", 2, ["3/9", "p", "w", "g", "e", "s", "chairs", "50", "d", "", "l"])]
    line = sheets.local_lines(spark.createDataFrame(local, kind)).first()
    assert (line["source_page"], line["amount_thb"], line["quality_flags"]) == (3, 50, ["upstream_ocr", "amount_outlier"])
    totals = spark.createDataFrame([("รวมทั้งสิ้น", None), ("รวม", "x"), ("chairs", None)], "item_name_raw string, agency string")
    assert sheets.without_subtotals(totals).count() == 2
    units = spark.createDataFrame([("หน่วย: ล้านบาท",), ("พันบาท",), ("บาท",), ("?",)], "h string").select(sheets.money_unit(F.col("h"))).collect()
    assert [r[0] for r in units] == [1_000_000, 1000, 1, None]
    dup = sheets.clamped_duplicates(spark.createDataFrame([("z", bytearray(b"1")), ("a", bytearray(b"1")), ("m", bytearray(b"2"))], "path string, content binary")).orderBy("path").collect()
    assert [(r["path"], r["duplicates"]) for r in dup] == [("a", ["z"]), ("m", [])]


def test_incremental_ingest(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    one.coalesce(1).write.parquet(source)
    ingest_new_files(spark, source, target, state, one.schema)
    ingest_new_files(spark, source, target, state, one.schema)
    assert spark.read.parquet(target).count() == 2
    spark.createDataFrame([(2, "c"), (3, "d")], one.schema).coalesce(1).write.mode("append").parquet(source)
    ingest_new_files(spark, source, target, state, one.schema)
    rows = spark.read.parquet(target)
    assert rows.count() == 4 and latest(rows, "k").count() == 3
    assert os.path.isdir(state)
