"""Scalar functions on their own."""

import hashlib

from pyspark.sql import functions as F

from ledgerlens.operators.items import key_of
from ledgerlens.functions import ids, numbers, places, text, years


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_clean_and_fold(spark):
    x = F.col("x")
    assert one(spark, " ๑๒​  ก ข\n", text.clean(x)) == "12 ก ข"
    assert one(spark, "นํา", text.clean(x)) == "นำ"
    assert one(spark, "Café 1,234,567.50 A.B เครื่อง ปรับ", text.fold(x)) == "café 1234567.50 a b เครื่องปรับ"
    assert one(spark, "น้ำ", text.fold(x)) == one(spark, "นํ้า".replace("ํ้า", "้ํา"), text.fold(x))
    assert one(spark, None, text.clean(x)) is None and one(spark, "", text.fold(x)) == ""
    assert one(spark, "“Quoted”  Text 1,000", text.quoted(x)) == "quoted text 1,000"


def test_keys_and_tokens(spark):
    x = F.col("x")
    assert one(spark, "a b\tc", text.group_key(x)) == "abc"
    assert key_of("Pump (A.B) 1.5kW, 7+000!") == "pump a b 1.5kw 7+000"
    assert one(spark, "ab เครื่อง", text.tokens(x)) == ["ab", "เคร", "ครื", "รื่", "ื่อ", "่อง"]
    assert one(spark, "12 units of 3.5, not 35", text.holds_number(x, "35"), text.holds_number(x, r"3\.5"), text.holds_number(x, "2")) == (True, True, False)
    assert one(spark, "อบต. บางนา", text.expand_local_gov(x)) == "องค์การบริหารส่วนตำบลบางนา"
    assert one(spark, "Some Name!", text.slug(x)) == "some-name-" + hashlib.sha1(b"Some Name!").hexdigest()[:6]
    assert one(spark, "abcdef", text.shortened(x, 3), text.shortened(x, 6)) == ("abc…", "abcdef")
    assert one(spark, "12/40", text.page_of(x)) == 12 and one(spark, "x", text.page_of(x)) is None


def test_money(spark):
    x = F.col("x")
    for given, want in [("1,234.5", 1235), ("(1,234.5)", -1235), ("-2.5", -3), ("๑๒", 12), ("-", None), ("none", None), ("", None), (None, None), ("1.2.3", None), ("+ 7", 7), ("(-3)", -3)]:
        assert one(spark, given, numbers.baht(x)) == want, given
    assert one(spark, "1.23456789", numbers.baht(x, 1_000_000)) == 1234568


def test_rounding_and_tolerance(spark):
    row = spark.range(1).select(numbers.round_half_even(F.lit(2.5)), numbers.round_half_away(F.lit(2.5)), numbers.round_half_away(F.lit(-2.5)), numbers.within(F.lit(1_000_900), F.lit(1_000_000)), numbers.within(F.lit(1), F.lit(None).cast("long")), numbers.percentage(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (2.0, 3.0, -3.0, True, True, 0.0)


def test_ids(spark):
    got = spark.range(1).select(ids.source_id(F.lit("d"), F.lit("p/q.xlsx"), F.lit(None).cast("string"), F.lit(7)), ids.doc_id(F.lit("p/q.xlsx")), ids.bucket_of(F.lit("k"))).first()
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert tuple(got) == (sha("d|p/q.xlsx||7")[:16], "d_" + sha("p/q.xlsx")[:12], sha("k")[:2])


def test_years_and_places(spark):
    x = F.col("x")
    assert one(spark, "plan 2566-2570 and ๒๕๖๔, 25999", years.fiscal_years(x)) == [2564, 2566, 2567, 2568, 2569, 2570, 2599]
    assert one(spark, "งบ 70 ปี พ.ศ.69 เล่ม 55", years.fiscal_years(x)) == [2569, 2570]
    assert one(spark, "Data 2570", years.targets_year(x, 2570), years.targets_year(x, 2569)) == (True, False)
    assert one(spark, "ครั้งที่ 3 วันที่ 12 มิถุนายน 2569", years.meeting_number(x), years.meeting_date(x)) == (3, "2569-06-12")
    assert one(spark, "ครั้งที่ 12 (5 ม.ค. 2570)", years.meeting_number(x), years.meeting_date(x)) == (12, "2570-01-05")
    assert one(spark, "กทม.", places.province(x)) == "กรุงเทพมหานคร" and one(spark, "nowhere", places.province(x)) is None


YEAR_TEXTS = {
    "2566-2567-2570": [2566, 2567, 2570], "2566 – 2569": [2566, 2567, 2568, 2569], "2570-2566": [2566, 2570], "12566-25701": [2566, 2567, 2568, 2569, 2570], "พ.ศ.... 70": [2570], "พ.ศ..... 70": [],
    "งบประมาณ: 70": [2570], "ปี     71": [2571], "ปี.:.:.71": [], "ของบฯ70": [2570], "งบ 705": [], "งบ 39 งบ 80": [], "25252566": [2566], "2500-2599": [2599], "2560/2561": [2560, 2561], "": [], "x": [],
}


def test_years_of_odd_texts(spark):
    rows = spark.createDataFrame([*((k,) for k in YEAR_TEXTS), (None,)], "t string").select("t", years.fiscal_years(F.col("t")).alias("y")).collect()
    assert {r["t"]: r["y"] for r in rows} == YEAR_TEXTS | {None: None}


def test_dates_of_odd_texts(spark):
    texts = {"12มิถุนายน2569": "2569-06-12", "(1) 3 ม.ค. 2570)": "2570-01-03", "5 abc 2569, 6 มกราคม 2570": None, "มกราคม 2570": None, "7 มกราคม 25701": None, "1225 ธ . ค . 2568": "2568-12-25", "": None}
    rows = spark.createDataFrame([(k,) for k in texts], "t string").select("t", years.meeting_date(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == texts
