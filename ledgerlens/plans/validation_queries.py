"""The validation report over stand-in lines with planted faults, and printed totals, titles and summaries derived from the lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation
from ..sources.writers import MAX_FILE_BYTES, oversized
from .line_queries import published
from .standins import BUDGET, budget_lines, scratch

QUERIES, ORACLES = {}, {}
_MONEY = "amount_thb", "revised_thb", "disbursed_thb"
_GROUP = "plan", "budget_type"
_PBO, _SCANNED, _SUBSET, _DRAFT = "pbo_disbursement", "local_ordinance_2570", "committee_table", "act_2570_draft"
#: Recorded coverage of years known to be incomplete: 2539 is still as recorded, 2541 no longer.
_GAPS = ((2539, 99.2), (2541, 90.0))


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _lines(spark, d):
    """Ids twice, undated lines with and without leave, scanned files, amounts and prices out of line."""
    source = budget_lines(spark, d)
    early, undated = F.substring("source_id", 1, 2), (F.col("dataset") == _SUBSET) & F.col("source_id").startswith("0")
    marks = F.array_compact(F.array(
        F.when((F.col("dataset") == _SCANNED) & (F.col("fiscal_year_be") <= 2541), "upstream_ocr"), F.when(F.col("source_id").endswith("f"), "amount_outlier"),
        F.when(undated & (F.substring("source_id", 2, 1) < "8"), "year_unknown"),
    ))
    made = source.withColumns({
        "fy": F.col("fiscal_year_be"), "fiscal_year_be": F.when(~undated, F.col("fiscal_year_be")), "plan": F.nullif("plan", F.lit("Brand#3")), "agency_code": F.col("agency"),
        "quality_flags": F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), marks),
        "unit_price_thb": F.when(early == "7f", F.col("unit_price_thb") * 1000).otherwise(F.col("unit_price_thb")),
    })
    return made.union(made.filter((F.col("dataset") == _SUBSET) & (early == "7e")))


def _findings(spark, d):
    lines = _lines(spark, d)
    folder = scratch(spark, "totals")
    validation.totals(lines, _MONEY, _GROUP, (2538, 2543)).write.parquet(folder)
    sums = spark.read.parquet(folder)
    own = sums.filter(F.col("dataset") == _PBO)
    long = own.filter(F.col("fiscal_year_be") != 2540).select(
        "level", F.col("fiscal_year_be").alias("year_be"), "ministry", "is_capital", F.explode(F.create_map(*[x for c in _MONEY for x in (F.lit(c), F.col(c))])).alias("column", "value")
    )
    wanted = (
        F.when(F.col("year_be") == 2542, (F.col("level") == "ministry") & (F.col("column") == "amount_thb"))
        .when(F.col("year_be") == 2543, (F.col("level") == "capital") & (F.col("ministry") == "NATION_3")).otherwise(F.col("level") == "year")
    )
    off = F.when(F.col("year_be").isin(2539, 2541, 2544), 1.01).when((F.col("year_be") == 2542) & (F.col("ministry") == "NATION_6"), 2.0).otherwise(1.0)
    printed = long.filter(wanted).select("level", "year_be", "ministry", "is_capital", "column", F.when(~((F.col("year_be") == 2538) & (F.col("column") == "revised_thb")), F.col("value") * off).alias("expected"))
    recorded = spark.createDataFrame(list(_GAPS), "year_be int, coverage_pct double")
    gaps = own.filter("level = 'year'").select(F.col("fiscal_year_be").alias("year_be"), (F.col("amount_thb") * 1.01).alias("oracle_total")).join(recorded, "year_be")
    year = F.substring_index("source_path", "/", -1).cast("int")
    files = sums.filter("level = 'file'").withColumn("year", year)
    titled = F.col("year") % 2 == 0
    titles = files.filter(F.col("dataset") == _SUBSET).select("source_path", F.when(titled, "A").otherwise("B").alias("format"), F.when(titled, F.col("n") + (F.col("year") == 2540).cast("int")).alias("title_n"), F.when(titled, F.col("amount_thb")).alias("title_amount"))
    groups = sums.filter((F.col("level") == "group") & (F.col("dataset") == _SCANNED)).withColumn("year", year).filter("year <> 2541")
    # Of a group that holds outliers only nothing is kept: its sum is 0, and so its summary is a number too.
    kept = F.coalesce("kept", F.lit(0))
    summaries = groups.select("source_path", *_GROUP, F.when(F.col("year") == 2539, kept * 2).when((F.col("year") == 2540) & (F.col("budget_type") == "PROMO"), kept + 5).otherwise(kept).alias("total"))
    draft = lines.filter((F.col("dataset") == _DRAFT) | ((F.col("dataset") == _SUBSET) & (F.substring("source_id", 1, 1) < "c")))
    raw = files.select(F.col("source_path").alias("rel_path"), "year", F.when(F.col("year") >= 2540, "pdf").otherwise("xlsx").alias("kind"))
    sources = raw.filter("year < 2544").withColumn("kind", F.when(F.col("year") == 2542, "xlsx").otherwise(F.col("kind")))
    docs = lines.filter("fy < 2543").select(F.col("source_doc_id").alias("doc_id"))
    facts = published(spark, d)
    shards = oversized(spark, f"{facts.root}/versions/{facts.release.version}", 0)
    return validation.report(
        validation.printed_totals(sums, printed, gaps, _PBO, _MONEY), validation.subset_files(sums, lines, titles, draft, (_SUBSET,)), validation.scanned_files(sums, summaries, _SCANNED, _GROUP),
        validation.unique_ids(sums, lines), validation.documents_known(sums, docs), validation.file_sizes(shards, MAX_FILE_BYTES, 10**15), validation.years_in_range(sums),
        validation.outlying_prices(lines), validation.organisations_mapped(sums), validation.files_listed(raw, sources), validation.amounts(sums),
    )


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS col, * EXCLUDE ({', '.join(x for x in _MONEY if x != c)}) RENAME ({c} AS v) FROM y" for c in _MONEY)
_OFF = "abs(v - e) > greatest(abs(e) * 0.0001, 1000)"
# Each year's printed totals: 2538, 2539, 2541, 2544 by year, 2542 by ministry, 2543 by ministry and capital, 2540 none.
_FINDINGS = f"""{BUDGET}, b0 AS (SELECT * EXCLUDE (fiscal_year_be, plan, unit_price_thb, quality_flags), fiscal_year_be AS fy, dataset = '{_SUBSET}' AND source_id LIKE '0%' AS undated, nullif(plan, 'Brand#3') AS plan,
  CASE WHEN source_id LIKE '7f%' THEN unit_price_thb * 1000 ELSE unit_price_thb END AS unit_price_thb, coalesce(list_contains(quality_flags, 'org_unmapped'), false) AS unmapped FROM budget),
b1 AS (SELECT *, CASE WHEN NOT undated THEN fy END AS yr FROM b0), b AS (SELECT * FROM b1 UNION ALL SELECT * FROM b1 WHERE dataset = '{_SUBSET}' AND source_id LIKE '7e%'),
y AS (SELECT yr, ministry, is_capital, amount_thb, revised_thb, disbursed_thb FROM b WHERE dataset = '{_PBO}'), l AS ({_LONG}),
x AS (SELECT yr, col, NULL AS m, NULL AS c, sum(v) AS v FROM l WHERE yr IN (2538, 2539, 2541, 2544) GROUP BY yr, col UNION ALL SELECT yr, col, ministry, NULL, sum(v) FROM l WHERE yr = 2542 AND col = 'amount_thb' GROUP BY yr, col, ministry
  UNION ALL SELECT yr, col, ministry, is_capital, sum(v) FROM l WHERE yr = 2543 AND ministry = 'NATION_3' GROUP BY yr, col, ministry, is_capital),
p AS (SELECT *, CASE WHEN NOT (yr = 2538 AND col = 'revised_thb') THEN v * CASE WHEN yr IN (2539, 2541, 2544) THEN 1.01 WHEN yr = 2542 AND m = 'NATION_6' THEN 2.0 ELSE 1.0 END END AS e FROM x),
v1 AS (SELECT yr, count(*) FILTER (WHERE {_OFF}) AS wrong FROM p GROUP BY yr), n1 AS (SELECT yr, count(*) AS n FROM y GROUP BY yr),
f2 AS (SELECT source_path, fy, count(*) AS n FROM b WHERE dataset = '{_SUBSET}' GROUP BY ALL), dr AS (SELECT DISTINCT agency, trim(item_name_raw) AS item, amount_thb FROM b WHERE dataset = '{_DRAFT}' OR dataset = '{_SUBSET}' AND substr(source_id, 1, 1) < 'c'),
s2 AS (SELECT source_path, count(*) AS n, count(*) FILTER (WHERE NOT CASE WHEN fy % 2 = 1 THEN (agency, trim(item_name_raw), amount_thb) IN (SELECT (agency, item, amount_thb) FROM dr) ELSE (trim(item_name_raw), amount_thb) IN (SELECT (item, amount_thb) FROM dr) END) AS wrong FROM b WHERE dataset = '{_SUBSET}' GROUP BY source_path),
g3 AS (SELECT source_path, fy, plan, budget_type, coalesce(sum(CASE WHEN source_id NOT LIKE '%f' THEN amount_thb END), 0) AS kept, count(*) AS n FROM b WHERE dataset = '{_SCANNED}' AND fy <= 2541 GROUP BY ALL),
h3 AS (SELECT *, CASE WHEN fy = 2539 THEN kept * 2 WHEN fy = 2540 AND budget_type = 'PROMO' THEN kept + 5 ELSE kept END AS printed FROM g3),
f3 AS (SELECT source_path, fy, sum(n) AS n, sum(kept) AS kept, sum(printed) AS printed FROM h3 GROUP BY source_path, fy),
k3 AS (SELECT source_path, count(*) AS n, count(*) FILTER (WHERE abs(kept - printed) > greatest(abs(printed) * 0.0001, 1)) AS wrong FROM h3 WHERE fy <> 2541 GROUP BY source_path),
d7 AS (SELECT dataset, count(*) AS n, count(*) FILTER (WHERE yr NOT BETWEEN 2538 AND 2543) + count(*) FILTER (WHERE undated AND substr(source_id, 2, 1) >= '8') AS bad, count(*) FILTER (WHERE unmapped) AS um FROM b GROUP BY dataset),
u4 AS (SELECT dataset, count(*) AS twice FROM (SELECT dataset FROM b GROUP BY dataset, source_id HAVING count(*) > 1) GROUP BY dataset),
t8 AS (SELECT item_key, quantile_cont(unit_price_thb, 0.995) * 10 AS t FROM b WHERE unit_price_thb > 0 GROUP BY item_key), pdf AS (SELECT DISTINCT source_path, fy FROM b WHERE fy >= 2540),
f AS (SELECT 'V1' AS "check", 'hard' AS severity, n1.yr::VARCHAR AS subject, n, coalesce(wrong, 0) AS problems, CASE n1.yr WHEN 2540 THEN 'no_oracle' WHEN 2539 THEN 'source_incomplete' WHEN 2541 THEN 'failed' ELSE CASE WHEN wrong = 0 THEN 'ok' ELSE 'failed' END END AS status FROM n1 LEFT JOIN v1 ON n1.yr = v1.yr
UNION ALL SELECT 'V2', 'hard', source_path, n, (fy = 2540)::INT, CASE WHEN fy % 2 = 1 THEN 'no_oracle' WHEN fy = 2540 THEN 'failed' ELSE 'ok' END FROM f2
UNION ALL SELECT 'V2', 'soft', source_path, n, wrong, CASE WHEN wrong = 0 THEN 'ok' ELSE 'warned' END FROM s2
UNION ALL SELECT 'V3', 'hard', source_path, n, (fy <> 2541 AND abs(kept - printed) * 100.0 > abs(printed))::INT, CASE WHEN fy = 2541 THEN 'no_summary' WHEN abs(kept - printed) * 100.0 > abs(printed) THEN 'failed' ELSE 'ok' END FROM f3
UNION ALL SELECT 'V3', 'soft', source_path, n, wrong, CASE WHEN wrong = 0 THEN 'ok' ELSE 'warned' END FROM k3
UNION ALL SELECT 'V4', 'hard', d7.dataset, n, coalesce(twice, 0), CASE WHEN twice IS NULL THEN 'ok' ELSE 'failed' END FROM d7 LEFT JOIN u4 ON d7.dataset = u4.dataset
UNION ALL SELECT 'V5', 'hard', 'documents', n, lost, CASE WHEN lost = 0 THEN 'ok' ELSE 'failed' END FROM (SELECT count(DISTINCT source_doc_id) AS n, count(DISTINCT source_doc_id) FILTER (WHERE source_doc_id NOT IN (SELECT source_doc_id FROM b WHERE fy < 2543)) AS lost FROM b)
UNION ALL SELECT 'V6', 'hard', unnest(['files', 'all files']), NULL, 0, 'ok'
UNION ALL SELECT 'V7', 'hard', dataset, n, bad, CASE WHEN bad = 0 THEN 'ok' ELSE 'failed' END FROM d7
UNION ALL SELECT 'V8', 'soft', 'unit prices', n, wrong, CASE WHEN wrong = 0 THEN 'ok' ELSE 'warned' END FROM (SELECT count(*) AS n, count(*) FILTER (WHERE unit_price_thb > t) AS wrong FROM b JOIN t8 USING (item_key) WHERE unit_price_thb > 0)
UNION ALL SELECT 'V9', 'soft', dataset, n, um, CASE WHEN um * 100.0 / n >= 5 THEN 'warned' ELSE 'ok' END FROM d7
UNION ALL SELECT 'V10', 'hard', 'pdf', n, lost, CASE WHEN lost = 0 THEN 'ok' ELSE 'failed' END FROM (SELECT count(*) AS n, count(*) FILTER (WHERE fy IN (2542, 2544)) AS lost FROM pdf)
UNION ALL SELECT 'amounts', 'soft', 'lines', count(*), count(*) FILTER (WHERE amount_thb < 0), CASE WHEN count(*) FILTER (WHERE amount_thb < 0) = 0 THEN 'ok' ELSE 'warned' END FROM b)"""


@query(f'WITH {_FINDINGS} SELECT "check", severity, subject, n::BIGINT AS n, problems::BIGINT AS problems, status FROM f')
def validation_findings(spark, d):
    """Every subject of the ten checks. How many files were published is not told: SQL over the tables can't know it."""
    return _findings(spark, d).withColumn("n", F.when(F.col("check") != "V6", F.col("n")))


@query(f"""WITH {_FINDINGS} SELECT "check", severity, count(*) AS subjects, sum(problems)::BIGINT AS problems, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status NOT IN ('failed', 'ok')) AS notable, severity = 'soft' OR count(*) FILTER (WHERE status = 'failed') = 0 AS passed FROM f GROUP BY "check", severity""")
def validation_report(spark, d):
    return validation.verdict(_findings(spark, d))
