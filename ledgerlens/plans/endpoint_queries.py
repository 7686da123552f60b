"""Registered composite endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, endpoints, search, trends
from ..operators.lines import LineFilter
from .catalog_queries import dated_values
from .line_queries import published
from .standins import FLAGGED, all_lines, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_CLEAN = "NOT list_contains(quality_flags, 'corrupt_row') AND NOT list_contains(quality_flags, 'lump_sum_category')"


@query(f"""WITH {FLAGGED}, m AS (SELECT * FROM flagged WHERE (item_name_raw ILIKE '%plate%' OR item_key ILIKE '%plate%') AND fiscal_year_be IN (2541, 2542) AND amount_thb >= 20000 AND {_CLEAN})
SELECT source_id, amount_thb, unit_price_thb, CASE WHEN unit_price_thb IS NOT NULL THEN 'unit_price' ELSE 'amount_per_line' END AS price_basis, (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m) > 50 AS truncated
FROM m ORDER BY unit_price_thb DESC NULLS LAST, source_id LIMIT 50""")
def query_budget_lines(spark, d):
    wanted = LineFilter(keyword="plate", years=(2541, 2542), min_amount=20000)
    found = endpoints.query_budget_lines(published(spark, d).facts(), wanted, "unit_price_desc", 99)
    return found.select("source_id", "amount_thb", "unit_price_thb", "price_basis", F.col("total").cast("long").alias("total"), "truncated")


_UP = """up AS (SELECT group_key, round_even(quantile_cont(unit_price_thb, 0.5), 0)::BIGINT AS up_median, count(*) AS up_n FROM cl WHERE up_ok GROUP BY group_key)"""


@query(f"""WITH {FLAGGED}, {_UP}, names AS (SELECT p_name AS key, min(p_partkey) AS id FROM part GROUP BY p_name), hit AS (SELECT * FROM names WHERE list_contains(string_split(key, ' '), 'hot'))
SELECT key, up_median, coalesce(up_n, 0) AS up_n, CASE WHEN coalesce(up_n, 0) < 3 THEN 'low' ELSE 'normal' END AS reliability FROM hit LEFT JOIN up ON replace(key, ' ', '') = group_key ORDER BY id LIMIT 20""")
def search_catalog(spark, d):
    counted = catalog.grouped_lines(all_lines(spark, d, "item_key", "quality_flags", "unit_price_thb"))
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("id")).withColumn("n_lines", F.lit(1))
    stats = names.select("id", F.regexp_replace("key", " ", "").alias("group_key")).join(catalog.price_statistics(counted), "group_key").select("id", "up_median", "up_n")
    found = endpoints.search_catalog(search.build_index(names), names, stats, "hot", 20)
    return found.select("key", "up_median", F.coalesce("up_n", F.lit(0)).alias("up_n"), "reliability")


@query(f"""WITH {FLAGGED}, t AS (SELECT fiscal_year_be AS year_be, count(*) AS n, round_even(quantile_cont(unit_price_thb, 0.5), 0)::BIGINT AS median FROM cl WHERE up_ok AND group_key = 'redplate' AND fiscal_year_be BETWEEN 2539 AND 2543 GROUP BY 1 HAVING count(*) >= 3)
SELECT year_be, n, median, round((arg_max(median, year_be) OVER () - arg_min(median, year_be) OVER ()) * 100.0 / arg_min(median, year_be) OVER (), 2) AS change_pct FROM t""")
def price_trend_of_item(spark, d):
    chosen = trends.with_basis(trends.points(dated_values(spark, d)))
    return endpoints.price_trend(chosen, "redplate", (2539, 2543)).select("year_be", "n", "median", "change_pct")


@query("""WITH d AS (SELECT doc_id, string_split(lower(lang || ' ' || source || ' doc' || doc_id % 40), ' ') AS t, CASE WHEN doc_id % 9 = 0 THEN 'other' ELSE 'pdf' END AS kind FROM documents)
SELECT doc_id FROM d WHERE list_contains(t, 'src7') AND list_contains(t, 'doc7') AND kind <> 'other' ORDER BY doc_id LIMIT 20""")
def find_documents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.concat(F.lit("doc"), (F.col("doc_id") % 40).cast("string")).alias("topic"), F.when(F.col("doc_id") % 9 == 0, "other").otherwise("pdf").alias("kind"))
    index = endpoints.document_index(docs, ("lang", "source", "topic"))
    both = docs.withColumn("key", F.concat_ws(" ", "lang", "source", "topic"))
    asked = both.filter((F.col("topic") == "doc7") & (F.col("source") == "src7"))
    return endpoints.find_documents(index, asked, "src7 doc7", 20).select(F.col("id").alias("doc_id"))
