"""The checks of the validation report on small tables: nulls, empty tables, known gaps, and when a report passes."""

from ledgerlens.operators import validation as v

LINE = "dataset string, fiscal_year_be int, ministry string, is_capital boolean, source_path string, plan string, source_doc_id string, source_id string, agency_code string, item_name_raw string, item_key string, amount_thb long, unit_price_thb long, quality_flags array<string>"
MONEY, GROUP = ("amount_thb",), ("plan",)
PRINTED = "level string, year_be int, ministry string, is_capital boolean, column string, expected double"
GAPS = "year_be int, oracle_total double, coverage_pct double"


def line(dataset="pbo_disbursement", year=2560, ministry="a", capital=True, path="f", plan="p", doc="d", id="1", agency="g", item="x", amount=1_000_000, price=None, flags=()):
    return (dataset, year, ministry, capital, path, plan, doc, id, agency, item, item, amount, price, None if flags is None else list(flags))


def sums(spark, *rows):
    lines = spark.createDataFrame(list(rows), LINE)
    return lines, v.totals(lines, MONEY, GROUP)


def statuses(found):
    return {(r["subject"], r["severity"]): (r["n"], r["problems"], r["status"]) for r in found.collect()}


def test_a_null_key_is_not_a_rolled_up_one(spark):
    _, t = sums(spark, line(ministry=None), line(ministry=None, capital=None), line(ministry="b", flags=None))
    got = {(r["level"], r["ministry"], r["is_capital"]): r["n"] for r in t.collect() if r["level"] in ("all", "year", "ministry", "capital")}
    assert got == {("all", None, None): 3, ("year", None, None): 3, ("ministry", None, None): 2, ("ministry", "b", None): 1, ("capital", None, True): 1, ("capital", None, None): 1, ("capital", "b", True): 1}


def test_printed_totals_and_known_gaps(spark):
    _, t = sums(spark, *[line(year=y) for y in (2558, 2559, 2560, 2561, 2562)], line(dataset="committee_table"))
    printed = spark.createDataFrame([("year", y, None, None, "amount_thb", e) for y, e in ((2558, 1_001_000.0), (2559, 1_001_001.0), (2560, 2e6), (2561, 2e6))] + [("ministry", 2558, "none", None, "amount_thb", 5.0), ("year", 2558, None, None, "amount_thb", None)], PRINTED)
    gaps = spark.createDataFrame([(2560, 2e6, 50.4), (2561, 2e6, 50.6)], GAPS)
    got = statuses(v.printed_totals(t, printed, gaps, "pbo_disbursement", MONEY))
    assert {k[0]: s[2] for k, s in got.items()} == {"2558": "ok", "2559": "failed", "2560": "source_incomplete", "2561": "failed", "2562": "no_oracle"}


def test_subset_files_by_format(spark):
    draft, _ = sums(spark, line(dataset="draft", agency="g", item=" x "), line(dataset="draft", agency=None, item=None, amount=None))
    lines, t = sums(spark, *[line(dataset="s", path=p, agency=a, item=i, amount=m) for p in "abc" for a, i, m in (("g", "x", 1_000_000), ("other", "x", 1_000_000), (None, None, None))])
    titles = spark.createDataFrame([("a", "A", 3, 2_000_000), ("b", "B", None, None)], "source_path string, format string, title_n long, title_amount long")
    got = statuses(v.subset_files(t, lines, titles, draft, ("s",)))
    assert got[("a", "hard")] == (3, 0, "ok") and got[("b", "hard")] == (3, 0, "no_oracle") and got[("c", "hard")] == (3, 0, "no_oracle")
    assert got[("a", "soft")] == (3, 0, "ok") and got[("b", "soft")] == (3, 1, "warned") and got[("c", "soft")] == (3, 0, "ok")
    off = titles.replace(2_000_000, 2_000_001)
    assert statuses(v.subset_files(t, lines, off, draft, ("s",)))[("a", "hard")] == (3, 1, "failed")


def test_scanned_files_against_their_summaries(spark):
    ocr = ("upstream_ocr",)
    rows = [line("s", path=p, plan=g, amount=m, flags=ocr + more) for p in "abc" for g, m, more in (("p", 100, ()), (None, 100, ()), ("p", 999, ("amount_outlier",)))]
    _, t = sums(spark, *rows, line("s", path="plain"))
    summaries = spark.createDataFrame([("a", "p", 101), ("a", None, 100), ("b", "p", 100), ("b", None, 103), ("b", "q", 0), ("plain", "p", 1)], "source_path string, plan string, total long")
    got = statuses(v.scanned_files(t, summaries, "s", GROUP))
    assert got == {
        ("a", "hard"): (3, 0, "ok"), ("a", "soft"): (2, 0, "ok"), ("b", "hard"): (3, 1, "failed"), ("b", "soft"): (3, 2, "warned"), ("c", "hard"): (3, 0, "no_summary"),
    }


def test_ids_documents_years_and_organisations(spark):
    undated = ("year_unknown",)
    lines, t = sums(
        spark, line(id="1"), line(id="1", year=2557), line("committee_table", id="1", year=None, flags=undated, doc=None), line("committee_table", id="2", year=None, doc="lost", flags=("org_unmapped",)), line(year=None, id="3", flags=undated),
    )
    assert statuses(v.unique_ids(t, lines)) == {("pbo_disbursement", "hard"): (3, 1, "failed"), ("committee_table", "hard"): (2, 0, "ok")}
    assert statuses(v.years_in_range(t)) == {("pbo_disbursement", "hard"): (3, 2, "failed"), ("committee_table", "hard"): (2, 1, "failed")}
    docs = spark.createDataFrame([("d",), ("d",)], "doc_id string")
    assert statuses(v.documents_known(t, docs)) == {("documents", "hard"): (2, 1, "failed")}
    assert statuses(v.organisations_mapped(t)) == {("pbo_disbursement", "soft"): (3, 0, "ok"), ("committee_table", "soft"): (2, 1, "warned")}


def test_sizes_files_and_prices(spark):
    files = spark.createDataFrame([(10,), (11,)], "length long")
    assert statuses(v.file_sizes(files, 10, 21)) == {("files", "hard"): (2, 1, "failed"), ("all files", "hard"): (2, 0, "ok")}
    raw = spark.createDataFrame([("a", "pdf"), ("b", "pdf"), ("c", "xlsx")], "rel_path string, kind string")
    assert statuses(v.files_listed(raw, raw.replace("pdf", "xlsx", "kind").union(raw.limit(1)))) == {("pdf", "hard"): (2, 1, "failed")}
    lines, _ = sums(spark, *[line(price=10) for _ in range(300)], line(price=500), line(price=0), line(price=None))
    assert statuses(v.outlying_prices(lines)) == {("unit prices", "soft"): (301, 1, "warned")}


def test_empty_tables_have_no_failures(spark):
    lines, t = sums(spark)
    none = spark.createDataFrame([], "rel_path string, kind string")
    empty = v.report(
        v.unique_ids(t, lines), v.years_in_range(t), v.documents_known(t, spark.createDataFrame([], "doc_id string")), v.file_sizes(spark.createDataFrame([], "length long"), 1, 1),
        v.printed_totals(t, spark.createDataFrame([], PRINTED), spark.createDataFrame([], GAPS), "pbo_disbursement", MONEY), v.files_listed(none, none), v.outlying_prices(lines), v.amounts(t),
    )
    assert {r["status"] for r in empty.collect()} == {"ok"}


def test_only_a_hard_failure_does_not_pass(spark):
    found = spark.createDataFrame([("V1", "hard", "a", 1, 0, "no_oracle"), ("V1", "hard", "b", 1, 1, "source_incomplete"), ("V8", "soft", "a", 1, 5, "warned"), ("V4", "hard", "a", 1, 2, "failed")], "check string, severity string, subject string, n long, problems long, status string")
    got = {r["check"]: (r["subjects"], r["problems"], r["failed"], r["notable"], r["passed"]) for r in v.verdict(found).collect()}
    assert got == {"V1": (2, 1, 0, 2, True), "V8": (1, 5, 0, 1, True), "V4": (1, 2, 1, 0, False)}
