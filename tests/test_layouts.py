"""Layouts found by content, on small sheets with odd rows; shards by place."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import facets, implied
from ledgerlens.sources import layouts

SCHEMA = "path string, sheet string, row_no long, cells array<string>"
NAMES = {"item_name": ("item_name", "item"), "amount_thb": ("amount",), "agency": ("agency",)}


@pytest.fixture
def sheet(spark):
    def made(**sheets):
        return spark.createDataFrame([(p, "Sheet1", n, cells) for p, rows in sheets.items() for n, cells in enumerate(rows, start=1)], SCHEMA)

    return made


def test_summary_sheets(sheet):
    narrow = [["x"], ["ป้ายชื่อแถว", "sum"], ["M1", "1,000.5"], ["M2", "-"], [None, "5"], ["ผลรวมทั้งหมด", "2000"]]
    wide = [["ป้ายชื่อแถว"] + ["c"] * 9, ["k"] + ["1"] * 9, ["ผลรวมทั้งหมด"] + [str(i) for i in range(1, 9)]]
    got = layouts.summary_totals(sheet(a=narrow, b=wide, c=[["nothing"]])).collect()
    assert {(r["ministry"], r["value"]) for r in got if r["path"] == "a"} == {("M1", 1000.5), ("M2", None), (None, 2000.0)}
    assert [r["value"] for r in got if r["path"] == "b"] == [1, 2, 3, 4, 5, 6, 7, 8, None]
    assert {r["path"] for r in got} == {"a", "b"}


def test_subset_lists(sheet):
    rows = [["12 รายการ | งบรวม 1,234 บาท | x"], ["ที่", "กระทรวง", "หน่วยงาน", "แผนงาน", "รายการ", "ประจำ/ลงทุน", "งบ (บาท)"], ["1", "M", "A", "P", "item", "รายจ่ายลงทุน", "1,000"], ["", "รวม", "", "", " ", "", "1000"], ["2", "M", "A", "P", "more", "?", "(50)"], ["3"]]
    short = [["ที่", "กระทรวง", "หน่วยงาน", "รายการ", "ประจำ/ลงทุน", "งบ (บาท)"], ["1", "M", "A", "item", "-", "9"]]
    both = sheet(a=rows, b=short)
    got = layouts.subset_lines(both, "part").orderBy("source_row").collect()
    assert [(r["source_path"], r["item_name_raw"], r["amount_thb"], r["is_capital"]) for r in got] == [("a", "item", 1000, True), ("a", "more", -50, None)]
    assert [tuple(r) for r in layouts.subset_titles(both).collect()] == [("a", "Sheet1", 12, 1234)]


def test_typed_sheets(sheet):
    rows = [["Divison", "REF_DOC_Page", "Project ", "amount", "Division", "number"], ["dd", "3/9", "p1", "100", "", ""], ["", "4", "p2", "1,000", "D", "2"], ["", "", "", "7", "", ""]]
    got = layouts.typed_lines(sheet(a=rows, b=[["Project"], ["p"]])).orderBy("source_row").collect()
    assert [(r["agency"], r["item_name_raw"], r["amount_thb"], r["item_qty"], r["source_page"], len(r["quality_flags"])) for r in got] == [("dd", "p1", 100, None, 3, 1), ("D", "p2", 1000, 2.0, 4, 0)]


def test_unknown_tables(sheet):
    # A smaller table above, one blank row inside, a sum, two blank rows, something below.
    rows = [["a", "b", "c", "d"], ["1"], [], [], ["(พันบาท)"], ["agency", "item_name", "amount", "plan"], [None, ""], ["A", "thing", "12.5", "P"], [""], ["B", "other", "3", "Q"], ["", "รวม", "15.5"], ["C", "no sum", "-"], [], [], ["z", "1"]]
    made = sheet(t=rows, u=[["nothing"]], v=[["agency", "item", "amount", "plan"], ["A", "x", "1", "p"]], w=[["k1", "k2", "k3", "k4"], ["บาท"], ["1"]])
    tables = layouts.unknown_tables(made, NAMES)
    assert {r["path"]: (r["header_row"], r["first_row"], r["last_row"], r["unit"], r["reason"]) for r in tables.collect()} == {
        "t": (6, 8, 12, 1000, None), "u": (None, None, None, None, "no table"), "v": (1, 2, 2, None, "unit unknown"), "w": (1, 3, 3, 1, "columns missing"),
    }
    assert sorted((r["item_name_raw"], r["agency"], r["amount_thb"]) for r in layouts.table_lines(made, tables).collect()) == [("other", "B", 3000), ("thing", "A", 12500)]


def test_paths_are_numbered_alike_at_any_width(spark):
    paths = [f"d/{k:03d}" for k in range(40)] + ["d", "", "e/x", "d/000"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    want = {p: n for n, p in enumerate(sorted(set(paths)))}
    for width in (1, 4, 100):
        assert {r["path"]: r["index"] for r in facets.numbered_paths(frame, width).collect()} == want


def test_implied_prices_of_null_and_large_groups(spark):
    few = [(None, 27900 * k) for k in (5, 8, 10)]
    many = [("many", 27900 * k) for k in range(1, 150)] + [("spread", 1000 + k) for k in range(5000)]
    got = implied.implied_prices(spark.createDataFrame(few + many, "k string, amount_thb long"), "k")
    assert {(r["k"], r["value_thb"], r["support_rows"], r["total_rows"]) for r in got.collect()} == {(None, 27900, 3, 3), ("many", 27900, 149, 149)}


def test_catalogue_is_raised_until_it_fits(spark):
    from ledgerlens.operators import catalog

    counts = spark.range(1, 21).select(F.col("id").cast("string").alias("group_key"), F.col("id").alias("n_lines"), F.lit(0).alias("n_years"), F.lit(0).alias("n_unit_prices"))
    kept, now = catalog.adaptive_eligibility(counts, most_entries=10)
    assert kept.count() == 10 and now.lines == 11
    kept, now = catalog.adaptive_eligibility(counts, most_bytes=500)
    assert kept.count() < 10 and sum(len(x) for x in kept.toJSON().collect()) <= 500
    assert catalog.adaptive_eligibility(counts, most_entries=0, rounds=2)[1].lines == 7


def test_shards_are_split_until_they_fit(spark, tmp_path):
    import json

    from ledgerlens.sources import writers

    lines = spark.range(4000).select(F.when(F.col("id") < 3900, "a/b").otherwise("c").alias("path"), F.sha2(F.col("id").cast("string"), 512).alias("item_key"), F.lit("g").alias("agency"), F.col("id").cast("string").alias("source_id"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("dataset"))
    folder = str(tmp_path / "shards")
    assert writers.write_fitting_shards(lines, folder, limit=30_000) > 1
    back = spark.read.parquet(folder)
    assert back.select("_metadata.file_size").agg(F.max("file_size")).first()[0] <= 30_000
    assert sorted(map(tuple, back.select(*lines.columns).collect())) == sorted(map(tuple, lines.collect()))
    with pytest.raises(ValueError):
        writers.write_fitting_shards(lines.limit(5), str(tmp_path / "never"), limit=10)
    assert 0 < writers.publish_sample(lines, str(tmp_path / "sample"), "dataset", {"x": 0.5, "y": 0.5}, 100) < 1_500_000
    assert spark.read.parquet(str(tmp_path / "sample")).groupBy("dataset").count().orderBy("dataset").collect() == [("x", 50), ("y", 50)]
    with pytest.raises(ValueError):
        writers.publish_sample(lines, str(tmp_path / "sample"), "dataset", {"x": 1.0}, 100, limit=10)
    writers.write_json(facets.facets(lines, ("dataset",)), str(tmp_path / "facets"), "facet", "value")
    (file,) = (tmp_path / "facets").glob("*.json")
    assert [json.loads(x) for x in file.read_text().splitlines()] == [{"facet": "dataset", "value": "x", "n": 2000}, {"facet": "dataset", "value": "y", "n": 2000}]
