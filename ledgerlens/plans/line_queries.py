"""Registered line-level, facet and check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, facets, flags, lines
from ..operators.lines import LineFilter
from .standins import BUDGET, FLAGGED, all_lines, budget_lines, published_lines, table
from .standins import flagged_lines as flagged_lines_of

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


_SHOWN = "source_id", "dataset", "fiscal_year_be", "item_key", "amount_thb", "unit_price_thb"
_CLEAN = "NOT list_contains(quality_flags, 'corrupt_row') AND NOT list_contains(quality_flags, 'lump_sum_category')"


_PATH = """CASE dataset WHEN 'pbo_disbursement' THEN dataset || '/' || fiscal_year_be || '/' || ministry_code WHEN 'act_2570_draft' THEN dataset || '/' || ministry_code
  WHEN 'committee_table' THEN dataset || '/' || source_doc_id ELSE dataset || '/' || coalesce(province, '_unmapped') END"""


def flagged(spark, d):
    return flagged_lines_of(spark, d)


def published(spark, d):
    """The flagged lines as published: written at the first question, and again when a table they come from has changed."""
    return published_lines(spark, d, flagged)


@query(f"WITH {FLAGGED} SELECT {', '.join(_SHOWN)} FROM flagged WHERE {_CLEAN} ORDER BY amount_thb DESC NULLS LAST, source_id LIMIT 20")
def query_lines_default(spark, d):
    return lines.top(published(spark, d).facts(), LineFilter()).select(*_SHOWN)


@query(f"WITH {FLAGGED} SELECT {', '.join(_SHOWN)}, CASE WHEN unit_price_thb IS NOT NULL THEN 'unit_price' ELSE 'amount_per_line' END AS price_basis FROM flagged WHERE item_key IN ('red plate', 'redplate', 'hot ring') AND fiscal_year_be BETWEEN 2540 AND 2543 AND {_CLEAN}")
def query_lines_by_key(spark, d):
    wanted = LineFilter(item_keys=("red plate", "redplate", "hot ring"), year_from=2540, year_to=2543)
    return published(spark, d).matching(wanted).select(*_SHOWN, lines.price_basis().alias("price_basis"))


@query(f"WITH {FLAGGED} SELECT {', '.join(_SHOWN)} FROM flagged WHERE (item_name_raw ILIKE '%RED%' OR item_key ILIKE '%RED%') AND agency ILIKE '%PLIER#000000%' AND province IS NULL AND {_CLEAN}")
def query_lines_keyword(spark, d):
    wanted = LineFilter(keyword="RED", agency_contains="PLIER#000000", missing=("province",))
    return published(spark, d).matching(wanted).select(*_SHOWN)


def _orders_sql() -> str:
    order = {"amount_desc": "amount_thb DESC", "amount_asc": "amount_thb ASC", "unit_price_desc": "unit_price_thb DESC", "unit_price_asc": "unit_price_thb ASC", "year_desc": "fiscal_year_be DESC"}
    parts = [f"(SELECT '{k}' AS ordering, source_id FROM budget WHERE dataset IN ('local_ordinance_2570', 'pbo_disbursement') ORDER BY {v} NULLS LAST, source_id LIMIT 10)" for k, v in order.items()]
    return f"WITH {BUDGET} " + " UNION ALL ".join(parts)


@query(_orders_sql())
def query_lines_orders(spark, d):
    wanted, source, out = LineFilter(datasets=("local_ordinance_2570", "pbo_disbursement"), exclude_flags=()), budget_lines(spark, d), None
    for name in lines.ORDERS:
        part = lines.top(source, wanted, name, 10).select(F.lit(name).alias("ordering"), "source_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {FLAGGED} SELECT count(*) AS total FROM flagged WHERE amount_thb >= 50000 AND amount_thb <= 90000 AND ministry_code IN ('3', '75000') AND {_CLEAN}")
def query_lines_total(spark, d):
    return lines.total(published(spark, d).facts(), LineFilter(min_amount=50000, max_amount=90000, ministry_codes=("3", "75000")))


@query(f"""WITH {BUDGET}, a AS (SELECT DISTINCT source_id, source_path, source_sheet, source_row FROM budget)
SELECT a.source_id AS anchor_id, b.source_id, b.source_row, b.source_row - a.source_row AS distance FROM budget b JOIN a ON b.source_path = a.source_path AND b.source_sheet IS NOT DISTINCT FROM a.source_sheet
WHERE b.source_row BETWEEN a.source_row - 40 AND a.source_row + 40""")
def neighbor_lines(spark, d):
    all_lines = budget_lines(spark, d)
    return lines.neighbours(all_lines, all_lines, 40)


@query(f"WITH {FLAGGED} SELECT fiscal_year_be, count(*) AS n, sum(amount_thb)::BIGINT AS amount_thb FROM flagged WHERE dataset = 'pbo_disbursement' AND fiscal_year_be IN (2539, 2540, 2541) AND {_CLEAN} GROUP BY fiscal_year_be")
def published_sums_by_year(spark, d):
    """Counts and sums by year over the shards of three years."""
    wanted = LineFilter(datasets=("pbo_disbursement",), years=(2539, 2540, 2541))
    return published(spark, d).matching(wanted).groupBy("fiscal_year_be").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_thb").alias("amount_thb"))


@query(f"WITH {FLAGGED}, p AS (SELECT *, {_PATH} AS path FROM flagged WHERE item_key IS NOT NULL) SELECT regexp_replace(item_key, '\\s+', '', 'g') AS group_key, path, count(*) AS n FROM p GROUP BY ALL")
def published_item_index(spark, d):
    return published(spark, d).items()


@query(f"""WITH {BUDGET}, a AS (SELECT DISTINCT source_id, source_path, source_sheet, source_row FROM budget)
SELECT a.source_id AS anchor_id, b.source_id, b.source_row, b.source_row - a.source_row AS distance FROM budget b JOIN a ON b.source_path = a.source_path AND b.source_sheet IS NOT DISTINCT FROM a.source_sheet
WHERE b.source_row BETWEEN a.source_row - 40 AND a.source_row + 40""")
def neighbor_lines_all(spark, d):
    """Every line is an anchor."""
    all_lines = budget_lines(spark, d)
    return lines.neighbours(all_lines, all_lines, 40)


_IDS = "SELECT source_id FROM budget UNION SELECT substr(sha1(o_orderkey::VARCHAR), 1, 16) FROM orders"


@query(f"WITH {BUDGET}, ids AS ({_IDS}) SELECT ids.source_id, b.amount_thb, b.source_id IS NOT NULL AS found FROM ids LEFT JOIN budget b ON ids.source_id = b.source_id")
def get_lines_not_found(spark, d):
    all_lines = budget_lines(spark, d)
    made = table(spark, d, "orders").select(F.substring(F.sha1(F.col("o_orderkey").cast("string")), 1, 16).alias("source_id"))
    asked = all_lines.select("source_id").union(made)
    return lines.by_ids(all_lines, asked).select("source_id", "amount_thb", "found")


@query(f"""WITH {FLAGGED}, m AS (SELECT * FROM flagged WHERE province = 'NATION_4' AND {_CLEAN}), y AS (SELECT DISTINCT fiscal_year_be FROM m ORDER BY 1 DESC LIMIT 1)
SELECT source_id, fiscal_year_be, 'latest 1 years' AS scope FROM m WHERE fiscal_year_be IN (SELECT * FROM y)""")
def query_lines_narrowed(spark, d):
    found, scope = lines.narrowed(published(spark, d).facts(), LineFilter(provinces=("NATION_4",)), 1)
    return found.select("source_id", "fiscal_year_be", F.lit(scope).alias("scope"))


@query(f"WITH {BUDGET} " + " UNION ALL ".join(f"SELECT '{c}' AS facet, {c}::VARCHAR AS value, count(*) AS n FROM budget WHERE {c} IS NOT NULL GROUP BY {c}" for c in facets.FACETS))
def facet_counts(spark, d):
    return facets.facets(budget_lines(spark, d))


QUERIES["facets"], ORACLES["facets"] = QUERIES.pop("facet_counts"), ORACLES.pop("facet_counts")  # "facets" is the module here


@query(f"WITH {BUDGET} SELECT dataset, count(*) AS n, count(*) FILTER (WHERE list_contains(quality_flags, 'org_unmapped')) AS hits, round(count(*) FILTER (WHERE list_contains(quality_flags, 'org_unmapped')) * 100.0 / count(*), 2) AS pct FROM budget GROUP BY dataset")
def check_unmapped_pct(spark, d):
    return facets.flag_share(budget_lines(spark, d), "dataset")


@query(f"WITH {FLAGGED} SELECT flag, count(*) AS n FROM (SELECT unnest(quality_flags) AS flag FROM flagged) GROUP BY flag")
def flag_histogram(spark, d):
    return facets.flag_histogram(all_lines(spark, d, "quality_flags"))


_NOTES = [("pbo_disbursement", 2541, "partial year"), ("pbo_disbursement", None, "amounts in millions"), ("committee_table", None, "scanned"), ("act_2570_draft", 2599, "never used")]
_NOTES_SQL = "(VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else b}::INT, '{c}')" for a, b, c in _NOTES) + ") AS t(dataset, year_be, note)"
_UNMAPPED = "SELECT dataset, fiscal_year_be AS year_be, 'org_unmapped ' || count(*) AS note FROM budget WHERE list_contains(quality_flags, 'org_unmapped') GROUP BY dataset, fiscal_year_be"


@query(f"""WITH {BUDGET}, notes AS (SELECT * FROM {_NOTES_SQL} UNION ALL {_UNMAPPED}), files AS (SELECT DISTINCT dataset, CASE WHEN dataset <> 'committee_table' THEN fiscal_year_be END AS year_be FROM budget WHERE fiscal_year_be >= 2541)
SELECT DISTINCT n.dataset, n.year_be, n.note FROM files f JOIN notes n ON f.dataset = n.dataset AND (n.year_be IS NULL OR f.year_be IS NULL OR n.year_be = f.year_be)""")
def coverage_notes_join(spark, d):
    source = budget_lines(spark, d)
    hits = source.filter(F.array_contains("quality_flags", "org_unmapped")).groupBy("dataset", F.col("fiscal_year_be").alias("year_be")).agg(F.concat(F.lit("org_unmapped "), F.count(F.lit(1)).cast("string")).alias("note"))
    files = source.filter("fiscal_year_be >= 2541").select("dataset", F.when(F.col("dataset") != "committee_table", F.col("fiscal_year_be")).alias("year_be"))
    return facets.notes_for(files, facets.coverage_notes(spark, hits, _NOTES))


@query(f"""WITH {BUDGET}, s AS (SELECT *, row_number() OVER (PARTITION BY fiscal_year_be, ministry_code ORDER BY source_id) AS rn FROM budget WHERE dataset = 'pbo_disbursement'),
t AS (SELECT *, row_number() OVER (PARTITION BY ministry_code ORDER BY source_id) AS rn FROM budget WHERE dataset = 'act_2570_draft')
SELECT source_id, dataset, fiscal_year_be, ministry_code FROM s WHERE rn <= 3 UNION ALL SELECT source_id, dataset, NULL, ministry_code FROM t WHERE rn <= 5""")
def sample_rows(spark, d):
    source = budget_lines(spark, d)
    first = facets.sample(source.filter("dataset = 'pbo_disbursement'"), ("fiscal_year_be", "ministry_code"), 3).select("source_id", "dataset", "fiscal_year_be", "ministry_code")
    second = facets.sample(source.filter("dataset = 'act_2570_draft'"), ("ministry_code",), 5).select("source_id", "dataset", "ministry_code")
    return first.unionByName(second, allowMissingColumns=True)


@query(f"WITH {BUDGET} SELECT item_key, count(*) AS n FROM budget GROUP BY item_key ORDER BY n DESC, item_key LIMIT 15")
def top_item_keys(spark, d):
    return facets.top_values(budget_lines(spark, d), "item_key", 15)


@query(f"WITH {BUDGET} SELECT path, count(*) AS rows, min(source_id) AS first_id, max(source_id) AS last_id, array_to_string(list_sort(list_distinct(list(fiscal_year_be))), ',') AS years FROM (SELECT *, {_PATH} AS path FROM budget) GROUP BY path")
def shard_manifest(spark, d):
    return facets.shard_summary(facets.shard_path(budget_lines(spark, d)))


@query(f"WITH {BUDGET} SELECT dataset, count(DISTINCT part) AS n_parts, min(part) AS first_part, max(part) AS last_part FROM (SELECT dataset, string_split(path, '/')[2] AS part FROM (SELECT *, {_PATH} AS path FROM budget)) GROUP BY dataset")
def shard_path_parts(spark, d):
    return facets.path_parts(facets.shard_path(budget_lines(spark, d)).select("path"))


@query(f"""WITH {FLAGGED}, p AS (SELECT *, {_PATH} AS path FROM cl), n AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM (SELECT DISTINCT path FROM p))
SELECT group_key, string_agg(i, ',' ORDER BY i) AS shards FROM (SELECT DISTINCT group_key, path FROM p) JOIN n USING (path) GROUP BY group_key""")
def item_shard_index(spark, d):
    from ..operators import catalog

    index = catalog.file_index(published(spark, d).facts())
    paths = index.select("group_key", F.explode("paths").alias("path"))
    numbered = paths.join(facets.numbered_paths(paths), "path").groupBy("group_key").agg(F.array_sort(F.collect_list("index")).alias("i"))
    return numbered.select("group_key", F.array_join(F.col("i").cast("array<string>"), ",").alias("shards"))


@query(f"""WITH {BUDGET}, x AS (SELECT dataset, source_id FROM budget UNION ALL SELECT dataset, source_id FROM budget WHERE substr(source_id, 1, 2) IN ('00', '7f')),
t AS (SELECT dataset, source_id, row_number() OVER (PARTITION BY dataset ORDER BY source_id) AS rn FROM (SELECT dataset, source_id FROM x GROUP BY ALL HAVING count(*) > 1))
SELECT dataset, count(*) AS n_duplicated, string_agg(source_id, ',' ORDER BY source_id) FILTER (WHERE rn <= 20) AS examples FROM t GROUP BY dataset""")
def check_unique_ids(spark, d):
    source = budget_lines(spark, d).select("dataset", "source_id")
    return checks.duplicate_ids(source.union(source.filter(F.substring("source_id", 1, 2).isin("00", "7f"))))


@query(f"WITH {BUDGET} SELECT source_doc_id, count(*) AS n FROM budget WHERE source_doc_id NOT IN (SELECT DISTINCT source_doc_id FROM budget WHERE fiscal_year_be < 2542) GROUP BY source_doc_id")
def check_missing_docs(spark, d):
    source = budget_lines(spark, d)
    return checks.missing_documents(source, source.filter("fiscal_year_be < 2542").select(F.col("source_doc_id").alias("doc_id")))


@query(f"WITH {BUDGET} SELECT dataset, count(*) FILTER (WHERE fiscal_year_be IS NULL OR fiscal_year_be NOT BETWEEN 2539 AND 2543) AS n_bad, min(fiscal_year_be) AS first_year, max(fiscal_year_be) AS last_year FROM budget GROUP BY dataset")
def check_year_range(spark, d):
    return checks.years_out_of_range(budget_lines(spark, d), 2539, 2543)


@query(f"""WITH {BUDGET}, s AS (SELECT nullif(plan, 'Brand#3') AS plan, budget_type, sum(amount_thb)::BIGINT AS total FROM budget GROUP BY ALL),
p AS (SELECT nullif(plan, 'Brand#3') AS plan, budget_type, (sum(amount_thb) + CASE WHEN budget_type = 'PROMO' THEN 5000000 ELSE 0 END)::BIGINT AS printed FROM budget WHERE plan <> 'Brand#4' GROUP BY nullif(plan, 'Brand#3'), budget_type UNION ALL SELECT 'Brand#X', 'SMALL', 5)
SELECT coalesce(s.plan, p.plan) AS plan, coalesce(s.budget_type, p.budget_type) AS budget_type, coalesce(total, 0) AS total, printed,
  s.total IS NOT NULL AND (printed IS NULL OR abs(total - printed) <= greatest(abs(printed) * 0.0001, 1)) AS ok
FROM s FULL JOIN p ON s.plan IS NOT DISTINCT FROM p.plan AND s.budget_type IS NOT DISTINCT FROM p.budget_type""")
def check_group_sums(spark, d):
    source = budget_lines(spark, d).withColumn("brand", F.col("plan")).withColumn("plan", F.nullif("plan", F.lit("Brand#3")))
    sums = source.groupBy("plan", "budget_type").agg(F.sum("amount_thb").alias("total"))
    printed = source.filter("brand <> 'Brand#4'").groupBy("plan", "budget_type").agg(F.sum("amount_thb").alias("total"))
    printed = printed.withColumn("total", F.col("total") + F.when(F.col("budget_type") == "PROMO", 5000000).otherwise(0))
    return checks.reconciled(sums, printed.union(spark.createDataFrame([("Brand#X", "SMALL", 5)], printed.schema)), ("plan", "budget_type"))


_COVERED = ("province", "unit_price_thb", "quality_flags", "item_key")


@query(f"WITH {BUDGET} SELECT dataset, count(*) AS n, " + ", ".join(f"round(count({c}) * 100.0 / count(*), 2) AS {c}_pct" for c in _COVERED) + " FROM budget GROUP BY dataset")
def check_field_coverage(spark, d):
    return checks.field_coverage(budget_lines(spark, d), _COVERED)


_SUMMED = ("amount_thb", "revised_thb", "disbursed_thb")


@query(f"WITH {BUDGET} SELECT dataset, " + ", ".join(f"sum(CASE WHEN NOT list_contains(quality_flags, 'corrupt_row') THEN {c} END)::BIGINT AS {c}" for c in _SUMMED) + " FROM budget GROUP BY dataset")
def check_column_totals(spark, d):
    return checks.column_totals(budget_lines(spark, d), _SUMMED, ~F.array_contains("quality_flags", "corrupt_row"), ("dataset",))


@query(f"WITH {BUDGET} SELECT ministry, sum(amount_thb)::BIGINT AS amount, sum(CASE WHEN is_capital THEN amount_thb END)::BIGINT AS capital, sum(CASE WHEN NOT is_capital THEN amount_thb END)::BIGINT AS current FROM budget GROUP BY ministry")
def check_ministry_sums(spark, d):
    return checks.sums_by(budget_lines(spark, d), "ministry")


@query(f"WITH {BUDGET}, s AS (SELECT DISTINCT ministry_code, fiscal_year_be FROM budget WHERE NOT (fiscal_year_be = 2541 AND ministry_code IN ('2', '9'))), n AS (SELECT *, lead(fiscal_year_be) OVER (PARTITION BY ministry_code ORDER BY fiscal_year_be) AS nxt FROM s) SELECT ministry_code, fiscal_year_be + 1 AS year_be FROM n WHERE nxt = fiscal_year_be + 2")
def check_continuity(spark, d):
    return checks.absent_years(budget_lines(spark, d).filter("NOT (fiscal_year_be = 2541 AND ministry_code IN ('2', '9'))"))


@query(f"""WITH {BUDGET}, s AS (SELECT ministry_code, fiscal_year_be AS year_be, sum(amount_thb)::BIGINT AS amount FROM budget WHERE ministry_code <> '8' GROUP BY ALL),
e AS (SELECT ministry_code, fiscal_year_be AS year_be, (sum(amount_thb) + CASE WHEN ministry_code = '6' THEN 900000 ELSE 0 END)::BIGINT AS expected FROM budget WHERE fiscal_year_be > 2538 GROUP BY ministry_code, fiscal_year_be)
SELECT coalesce(s.ministry_code, e.ministry_code) AS ministry_code, coalesce(s.year_be, e.year_be) AS year_be, amount, expected, CASE WHEN amount IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra'
  WHEN abs(amount - expected) <= greatest(abs(expected) * 0.0001, 1000) THEN 'ok' ELSE 'differs' END AS status FROM s FULL JOIN e ON s.ministry_code = e.ministry_code AND s.year_be = e.year_be""")
def check_year_coverage(spark, d):
    sums = budget_lines(spark, d).groupBy("ministry_code", F.col("fiscal_year_be").alias("year_be")).agg(F.sum("amount_thb").alias("amount"))
    expected = sums.filter("year_be > 2538").withColumn("amount", F.col("amount") + F.when(F.col("ministry_code") == "6", 900000).otherwise(0))
    return checks.year_coverage(sums.filter("ministry_code <> '8'"), expected)


@query(f"""WITH {BUDGET}, a AS (SELECT nullif(agency, 'Supplier#000000005') AS agency, item_name, amount_thb FROM budget WHERE dataset = 'act_2570_draft' AND substr(source_id, 1, 1) < '8'),
w AS (SELECT DISTINCT nullif(agency, 'Supplier#000000005') AS agency, item_name, amount_thb FROM budget WHERE dataset = 'act_2570_draft' AND substr(source_id, 1, 1) >= '4'),
h AS (SELECT count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM w WHERE w.agency IS NOT DISTINCT FROM a.agency AND w.item_name IS NOT DISTINCT FROM a.item_name AND w.amount_thb IS NOT DISTINCT FROM a.amount_thb))
SELECT (SELECT count(*) FROM a) AS n_part, h.n AS n_contained, round(h.n * 100.0 / (SELECT count(*) FROM a), 2) AS pct FROM h""")
def subset_containment(spark, d):
    draft = budget_lines(spark, d).filter("dataset = 'act_2570_draft'").withColumn("agency", F.nullif("agency", F.lit("Supplier#000000005")))
    first = F.substring("source_id", 1, 1)
    return checks.containment(draft.filter(first < "8"), draft.filter(first >= "4"), ("agency", "item_name", "amount_thb"))


@query("WITH " + FLAGGED + " SELECT source_id, item_key, unit_price_thb FROM budget JOIN (SELECT item_key, quantile_cont(unit_price_thb, 0.995) AS t FROM budget WHERE unit_price_thb > 0 GROUP BY item_key) USING (item_key) WHERE unit_price_thb > t ORDER BY unit_price_thb DESC, source_id LIMIT 15")
def check_price_outliers(spark, d):
    source = budget_lines(spark, d)
    limits = flags.outlier_thresholds(source, skip_corrupt=False).withColumn("threshold", F.col("threshold") / flags.OUTLIER_FACTOR)
    return checks.price_outliers(source, limits)

