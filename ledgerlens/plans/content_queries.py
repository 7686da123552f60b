"""Registered search, document, index-adjustment and proposal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text, years
from ..operators import documents, econ, implied, proposals, search
from ..sources.search_index import KeptIndex
from .standins import BUDGET, budget_lines, scratch, table, written

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- search over part names


def _items(spark, d):
    """One item for each name and brand: id, key, n_lines, has_unit_price."""
    parts = table(spark, d, "part")
    return parts.groupBy(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")).alias("key")).agg(
        F.min("p_partkey").alias("id"), F.count(F.lit(1)).alias("n_lines"), (F.max("p_retailprice") > 950).alias("has_unit_price")
    )


_ITEMS = """items AS (SELECT p_name || ' ' || p_type || ' ' || p_size AS key, min(p_partkey) AS id, count(*) AS n_lines, max(p_retailprice) > 950 AS has_unit_price FROM part GROUP BY 1),
tk AS (SELECT id, string_split(lower(key), ' ') AS t FROM items), ix AS (SELECT term, id, count(*) AS tf, length FROM (SELECT unnest(t) AS term, id, len(t) AS length FROM tk) GROUP BY ALL)"""


@query(f"WITH {_ITEMS} SELECT * FROM ix")
def search_index(spark, d):
    return search.build_index(_items(spark, d))


def _rank_sql(terms: list[str], extra: str, limit: int) -> str:
    asked = ", ".join(f"('{t}')" for t in terms)
    loose = "(length(asked) > 2 AND NOT regexp_matches(asked, '^[0-9]+([.][0-9]+)?$'))"
    numbers_ = " + ".join(["1", *[f"(CASE WHEN list_contains(string_split(key, ' '), '{t}') THEN 1 ELSE 0 END)" for t in terms if t.isdigit()]])
    return f"""WITH {_ITEMS}, asked AS (SELECT * FROM (VALUES {asked}) AS v(asked)), df AS (SELECT term, count(*) AS df FROM ix GROUP BY term),
m AS (SELECT term, asked, df, CASE WHEN term = asked THEN 1.0::DOUBLE WHEN starts_with(term, asked) THEN 0.375::DOUBLE * length(asked) / length(term) ELSE 0.45::DOUBLE * length(asked) / (length(asked) + levenshtein(term, asked)) END AS w
  FROM df, asked WHERE term = asked OR ({loose} AND (starts_with(term, asked) OR levenshtein(term, asked) <= floor(length(asked) * 0.2::DOUBLE)))),
sz AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tk),
h AS (SELECT id, sum(w * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * length / mean))) AS score, count(DISTINCT asked) AS matched FROM ix JOIN m USING (term), sz GROUP BY id)
SELECT id, key, round(score * pow(least(matched / {len(terms)}.0::DOUBLE, 1), 2) * (1 + 0.25::DOUBLE * ln(1 + n_lines)) * ({numbers_}), 6) AS rank_score FROM h JOIN items USING (id) {extra}
ORDER BY score * pow(least(matched / {len(terms)}.0::DOUBLE, 1), 2) * (1 + 0.25::DOUBLE * ln(1 + n_lines)) * ({numbers_}) DESC, id LIMIT {limit}"""


@query(_rank_sql(["smal", "rign", "promo"], "", 20))
def search_catalog_rank(spark, d):
    items = _items(spark, d)
    return search.search(search.build_index(items), items, "smal rign PROMO 7", 20).select("id", "key", "rank_score")


@query(_rank_sql(["blue", "ring"], "WHERE has_unit_price", 10))
def search_catalog_filtered(spark, d):
    items = _items(spark, d)
    return search.search(search.build_index(items), items, "Blue, ring 12", 10, priced_only=True).select("id", "key", "rank_score")


def _kept(spark, d):
    """The items and their index, kept: built of two items in three, then merged with the rest and a changed name, then brought up to date."""
    items = _items(spark, d)
    index = KeptIndex(spark, scratch(spark, "index")).build(items.filter("id % 9 <> 0"))
    odd = items.withColumn("key", F.when(F.col("id") % 50 == 1, F.concat(F.lit("changed "), "key")).otherwise(F.col("key")))
    index, first = index.refresh(odd)
    index, second = index.refresh(items)
    return items, index, [first, second, index.refresh(items)[1]]


@query(f"WITH x AS ({_rank_sql(['smal', 'rign', 'promo'], '', 1_000_000_000)}) SELECT id, key, rank_score, (SELECT count(*) FROM x) AS total FROM x ORDER BY rank_score DESC, id LIMIT 20")
def search_kept_index(spark, d):
    """Over an index that was built, merged twice and is fresh then."""
    items, index, _ = _kept(spark, d)
    return index.search(items, "smal rign PROMO 7", 20).select("id", "key", "rank_score", "total")


@query(f"WITH {_ITEMS} SELECT *, 'merged,merged,fresh' AS states FROM ix")
def search_index_merged(spark, d):
    """The merged index holds what one built anew would."""
    _, index, states = _kept(spark, d)
    return index.postings().withColumn("states", F.lit(",".join(states)))


@query(f"SELECT key FROM ({_rank_sql(['bluw', 'plat', 'ecnomy'], '', 5)})")
def search_suggestions(spark, d):
    items, index, _ = _kept(spark, d)
    return index.suggestions(items, "bluw plat 3 ecnomy")


_YEARS_SQL = "list_contains([2538 + id % 7, 2540], 2541)"


@query(f"WITH x AS ({_rank_sql(['blue', 'ring'], f'WHERE {_YEARS_SQL}', 1_000_000_000)}) SELECT id, key, rank_score, (SELECT count(*) FROM x) AS total FROM x ORDER BY rank_score DESC, id LIMIT 10")
def search_by_year(spark, d):
    """Hits of a year only, and how many there are before the limit."""
    items = _items(spark, d).withColumn("years", F.array((2538 + F.col("id") % 7).cast("int"), F.lit(2540)))
    index = KeptIndex(spark, scratch(spark, "index")).build(items)
    return index.search(items, "blue ring", 10, years=(2541,)).select("id", "key", "rank_score", "total")


# ---- documents


@query("SELECT doc_id, n_chars FROM documents WHERE contains(lower(nfc_normalize(text)), 'disgusting')")
def doc_search(spark, d):
    return documents.find_chunks(table(spark, d, "documents"), "Disgusting", None).select("doc_id", "n_chars")


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), a AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
r AS (SELECT doc_id, i, 0 AS chunk_no, length(line) AS n, line FROM a WHERE i = 1 UNION ALL
  SELECT a.doc_id, a.i, CASE WHEN r.n + 1 + length(a.line) <= 1200 THEN r.chunk_no ELSE r.chunk_no + 1 END, CASE WHEN r.n + 1 + length(a.line) <= 1200 THEN r.n + 1 + length(a.line) ELSE length(a.line) END, a.line FROM r JOIN a ON a.doc_id = r.doc_id AND a.i = r.i + 1)
SELECT doc_id, chunk_no, string_agg(line, chr(10) ORDER BY i) AS text FROM r GROUP BY doc_id, chunk_no""")
def doc_chunks(spark, d):
    return documents.chunks(table(spark, d, "documents"))


@query("""WITH o AS (SELECT DISTINCT o_custkey AS doc_id FROM orders), k AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 1000), l AS (SELECT doc_id, max(quality) = 1 AS layer FROM labels GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN o.doc_id IS NOT NULL THEN 'table' WHEN k.doc_id IS NOT NULL THEN 'text' WHEN coalesce(layer, lang = 'en') THEN 'text_layer' ELSE 'none' END AS extracted,
  coalesce(layer, lang = 'en') AS has_text_layer FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id""")
def document_state(spark, d):
    docs = table(spark, d, "documents")
    report = table(spark, d, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("has_text_layer"))
    named = table(spark, d, "orders").select(F.col("o_custkey").alias("source_doc_id"))
    return documents.enriched(docs.select("doc_id", (F.col("lang") == "en").alias("has_text_layer")), report, docs.filter("n_chars > 1000"), named).select("doc_id", "extracted", "has_text_layer")


@query()
def fold_text(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.fold(F.col("text")).alias("folded"))


@query(r"""WITH x AS (SELECT conv_id, turn, translate(replace(translate(nfc_normalize(text), chr(8203) || chr(65279), ''), chr(3661) || chr(3634), chr(3635)), '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS t FROM conversations)
SELECT conv_id, turn, length(t2) AS n, md5(t2) AS hash FROM (SELECT conv_id, turn, trim(regexp_replace(t, '[\t\n\v\f\r\x{85}\p{Z}]+', ' ', 'g')) AS t2 FROM x)""")
def clean_text(spark, d):
    cleaned = table(spark, d, "conversations").select("conv_id", "turn", text.clean(F.col("text")).alias("t"))
    return cleaned.select("conv_id", "turn", F.length("t").cast("long").alias("n"), F.md5("t").alias("hash"))


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '(' || o_totalprice || ')' WHEN 1 THEN ' ' || o_totalprice || ' ' WHEN 2 THEN '-' WHEN 3 THEN 'n/a' WHEN 4 THEN '-' || o_totalprice ELSE floor(o_totalprice / 1000)::BIGINT || ',' || lpad((floor(o_totalprice)::BIGINT % 1000)::VARCHAR, 3, '0') END AS money FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN -1 WHEN 4 THEN -1 ELSE 1 END * round(try_cast(regexp_replace(money, '[-(), ]', '', 'g') AS DECIMAL(38, 10)), 0)::BIGINT AS baht FROM x""")
def price_normalization(spark, d):
    k, price = F.col("o_orderkey") % 6, F.col("o_totalprice").cast("string")
    grouped = F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(","), F.lpad((F.floor("o_totalprice") % 1000).cast("string"), 3, "0"))
    money = F.when(k == 0, F.concat(F.lit("("), price, F.lit(")"))).when(k == 1, F.concat(F.lit(" "), price, F.lit(" "))).when(k == 2, "-").when(k == 3, "n/a").when(k == 4, F.concat(F.lit("-"), price)).otherwise(grouped)
    return table(spark, d, "orders").select("o_orderkey", numbers.baht(money).alias("baht"))


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 5 AS kind, 2535 + o_orderkey % 75 AS y, o_orderkey % 7 AS n, 35 + o_orderkey % 50 AS short FROM orders),
f AS (SELECT o_orderkey, CASE kind WHEN 0 THEN list_concat(CASE WHEN y + n < 2600 THEN range(y, y + n + 1) ELSE [y] END, [y + 9]) WHEN 1 THEN [y] WHEN 2 THEN CASE WHEN short BETWEEN 40 AND 79 THEN [2500 + short] ELSE [] END WHEN 3 THEN [y, y + 1] ELSE [] END AS years FROM x)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(years, lambda v: v BETWEEN 2540 AND 2599))), ',') AS years FROM f""")
def fiscal_years_of_text(spark, d):
    k = F.col("o_orderkey")
    y, n, short = 2535 + k % 75, k % 7, 35 + k % 50
    text_of = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    label = (
        F.when(k % 5 == 0, text_of("plan ", y.cast("string"), " – ", (y + n).cast("string"), " annex", (y + 9).cast("string"), "x"))
        .when(k % 5 == 1, text_of("report_", y.cast("string"), "07.pdf")).when(k % 5 == 2, text_of("งบประมาณ ", short.cast("string"), " เล่ม 3"))
        .when(k % 5 == 3, text_of((y + 1).cast("string"), "-", y.cast("string"))).otherwise("no year, 24 files, 125 pages")
    )
    return table(spark, d, "orders").select("o_orderkey", F.array_join(years.fiscal_years(label).cast("array<string>"), ",").alias("years"))


# ---- economic indicators, from daily event values


def _records(spark, d):
    e = table(spark, d, "events")
    day = F.dayofmonth("ts")
    sums = e.groupBy(F.col("event_type").alias("indicator"), F.when(F.col("user_id") % 5 == 0, "points").otherwise("index").alias("unit"), (2540 + day).cast("int").alias("year_be")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    return sums.select("indicator", "unit", "year_be", F.when(F.col("v") % 11 != 0, F.col("v") / 100.0).alias("value"))


_ECON = """rec AS (SELECT event_type AS indicator, CASE WHEN user_id % 5 = 0 THEN 'points' ELSE 'index' END AS unit, (2540 + day(ts))::INT AS year_be, sum(round(value * 100)::BIGINT)::BIGINT AS v FROM events GROUP BY ALL),
g AS (SELECT indicator, unit, year_be, v / 100.0::DOUBLE AS value FROM rec WHERE v % 11 <> 0), u AS (SELECT indicator, unit, count(*) AS n FROM g GROUP BY ALL),
b AS (SELECT indicator, unit FROM (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY n DESC, unit DESC) AS rn FROM u) WHERE rn = 1 AND n >= 3), es AS (SELECT g.* FROM g JOIN b USING (indicator, unit))"""


@query(f"WITH {_ECON} SELECT * FROM es")
def econ_series(spark, d):
    return econ.points(_records(spark, d))


@query(f"WITH {_ECON}, q AS (SELECT DISTINCT event_type AS indicator, y.y::INT AS year_be FROM events, range(2535, 2575) AS y(y)) SELECT q.indicator, q.year_be, unit, value, CASE WHEN value IS NULL THEN 'no data for this year' END AS note FROM q LEFT JOIN es ON q.indicator = es.indicator AND q.year_be = es.year_be")
def econ_lookup(spark, d):
    asked = table(spark, d, "events").select(F.col("event_type").alias("indicator")).distinct().withColumn("year_be", F.explode(F.sequence(F.lit(2535), F.lit(2574))))
    return econ.lookup(econ.points(_records(spark, d)), asked)


@query(f"""WITH {_ECON}, r AS (SELECT o_orderkey AS request_id, round(o_totalprice)::BIGINT AS amount_thb, ['click', 'view', 'error', 'signup'][1 + o_orderkey % 4] AS indicator, (2541 + o_orderkey % 31)::INT AS from_year, (2545 + o_orderkey % 29)::INT AS to_year, o_orderkey % 3 = 0 AS allow_latest FROM orders),
l AS (SELECT indicator, max(year_be) AS last_year, arg_max(value, year_be) AS last_value FROM es GROUP BY indicator),
j AS (SELECT r.*, f.value AS fv, t.value AS tv0, last_year, last_value, t.value IS NULL AND allow_latest AND last_year IS NOT NULL AS fb FROM r LEFT JOIN es f ON f.indicator = r.indicator AND f.year_be = from_year LEFT JOIN es t ON t.indicator = r.indicator AND t.year_be = to_year LEFT JOIN l ON l.indicator = r.indicator),
k AS (SELECT *, CASE WHEN fb THEN last_value ELSE tv0 END AS tv FROM j), m AS (SELECT *, CASE WHEN fv IS NULL THEN from_year WHEN tv IS NULL THEN to_year END AS missing, round(tv / fv, 6) AS factor FROM k),
n AS (SELECT request_id, arg_min(year_be, abs(year_be - missing) * 10000 + year_be) AS nearest_year FROM m JOIN es ON es.indicator = m.indicator WHERE missing IS NOT NULL GROUP BY request_id)
SELECT m.request_id, CASE WHEN missing IS NULL THEN CASE WHEN fb THEN last_year ELSE to_year END END AS to_year_used, CASE WHEN missing IS NULL THEN factor END AS factor, CASE WHEN missing IS NULL THEN round(amount_thb * factor)::BIGINT END AS adjusted_thb,
  CASE WHEN fv IS NULL THEN 'from_year_missing' WHEN tv IS NULL THEN 'to_year_missing' WHEN fb THEN 'latest_used' ELSE 'ok' END AS status, nearest_year FROM m LEFT JOIN n USING (request_id)""")
def inflation_adjust(spark, d):
    o = table(spark, d, "orders")
    names = F.array(*map(F.lit, ("click", "view", "error", "signup")))
    requests = o.select(F.col("o_orderkey").alias("request_id"), F.round("o_totalprice").cast("long").alias("amount_thb"), names[(F.col("o_orderkey") % 4).cast("int")].alias("indicator"),
                        (2541 + F.col("o_orderkey") % 31).cast("int").alias("from_year"), (2545 + F.col("o_orderkey") % 29).cast("int").alias("to_year"), (F.col("o_orderkey") % 3 == 0).alias("allow_latest"))
    return econ.adjust(requests, econ.points(_records(spark, d)))


@query("SELECT model, round(sum(tokens * price) / 1e6 * 1.5, 6) AS cost FROM (SELECT role AS model, turn % 2 AS kind, length(text) AS tokens, CASE WHEN turn % 2 = 0 THEN 3 ELSE 15 END AS price FROM conversations) GROUP BY model")
def token_cost(spark, d):
    c = table(spark, d, "conversations")
    usage = c.select(F.col("role").alias("model"), (F.col("turn") % 2).cast("int").alias("kind"), F.length("text").cast("long").alias("tokens"))
    prices = c.select(F.col("role").alias("model")).distinct().withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("price", F.when(F.col("kind") == 0, 3).otherwise(15))
    return econ.token_cost(usage, prices, 1.5).withColumn("cost", F.round("cost", 6))


# ---- proposals: every order is one, its lineitems are its lines


def _boq(source):
    lines = source.withColumn("proposal_id", F.floor(F.col("source_row") / 8).cast("long"))
    h = F.conv(F.substring("source_id", 1, 6), 16, 10).cast("long")
    price = F.coalesce("unit_price_thb", "amount_thb") * F.when(h % 5 == 0, 30).when(h % 5 == 1, 2).otherwise(1)
    basis = F.when(h % 3 == 0, "market").when(h % 3 == 1, "historical").otherwise("estimate")
    own = F.when(h % 7 == 0, F.lit("budget_line:none")).otherwise(F.concat(F.lit("budget_line:"), F.col("source_id")))
    web = F.when(h % 4 == 0, F.lit("web:https://example.com/a")).otherwise(F.lit("web:http://example.com/b"))
    cited = F.transform(F.array(own, web), lambda c: F.struct(F.substring_index(c, ":", 1).alias("kind"), F.regexp_replace(c, "^[a-z_]+:", "").alias("ref")))
    derived = h % 2 == 0
    return lines.withColumn("h", h).select(
        F.col("source_id").alias("line_id"), "proposal_id", F.col("item_qty").alias("qty"), price.alias("unit_price_thb"), (F.col("item_qty") * price + F.when(h % 11 == 0, 500).otherwise(0)).alias("total_thb"),
        basis.alias("basis"), F.when(h % 2 == 0, "high").otherwise("medium").alias("confidence"), cited.alias("citations"),
        F.when(derived, F.coalesce("unit_price_thb", "amount_thb")).cast("double").alias("from_amount"), F.when(derived, F.lit(2541)).alias("from_year"), F.when(derived, F.lit(2543)).alias("to_year"), F.when(derived, F.lit("cpi")).alias("indicator"), F.when(derived, F.when(h % 13 == 0, 2.5).otherwise(2.004)).alias("factor"),
    )


@query(f"WITH {BUDGET}, p AS (SELECT source_row // 8 AS proposal_id, amount_thb FROM budget) SELECT proposal_id, sum(amount_thb)::DOUBLE AS subtotal, round(CASE WHEN proposal_id % 3 = 0 THEN 1000 WHEN proposal_id % 3 = 1 THEN sum(amount_thb) * 7.0 / 100 ELSE 0 END, 4)::DOUBLE AS contingency, round(sum(amount_thb) + CASE WHEN proposal_id % 3 = 0 THEN 1000 WHEN proposal_id % 3 = 1 THEN sum(amount_thb) * 7.0 / 100 ELSE 0 END, 4)::DOUBLE AS grand_total FROM p GROUP BY proposal_id")
def boq_totals(spark, d):
    lines = budget_lines(spark, d).select(F.floor(F.col("source_row") / 8).cast("long").alias("proposal_id"), F.col("amount_thb").cast("double").alias("total_thb"))
    k = F.col("proposal_id") % 3
    rules = lines.select("proposal_id").distinct().select("proposal_id", F.when(k == 0, 1000.0).alias("fixed"), F.when(k == 1, 7.0).alias("pct"))
    found = proposals.totals(lines, rules)
    return found.select("proposal_id", "subtotal", F.round("contingency", 4).alias("contingency"), F.round("grand_total", 4).alias("grand_total"))


@query(f"WITH {BUDGET}, p AS (SELECT source_row // 8 AS proposal_id, ['historical', 'market', 'estimate'][1 + source_row % 3] AS basis, amount_thb::DOUBLE AS t FROM budget) SELECT proposal_id, " + ", ".join(f"round(coalesce(sum(t) FILTER (WHERE basis = '{b}'), 0) / sum(t), 6) AS {b}" for b in ("historical", "market", "estimate")) + " FROM p GROUP BY proposal_id")
def basis_mix(spark, d):
    names = F.array(*map(F.lit, ("historical", "market", "estimate")))
    lines = budget_lines(spark, d).select(F.floor(F.col("source_row") / 8).cast("long").alias("proposal_id"), names[(F.col("source_row") % 3).cast("int")].alias("basis"), F.col("amount_thb").cast("double").alias("total_thb"))
    found = proposals.basis_mix(lines)
    return found.select("proposal_id", *[F.round(b, 6).alias(b) for b in ("historical", "market", "estimate")])


_EVIDENCE = f"""WITH {BUDGET}, l AS (SELECT *, ('0x' || substr(source_id, 1, 6))::BIGINT AS h, coalesce(unit_price_thb, amount_thb) AS ref_price FROM budget),
x AS (SELECT *, ref_price * CASE WHEN h % 5 = 0 THEN 30 WHEN h % 5 = 1 THEN 2 ELSE 1 END AS price, CASE h % 3 WHEN 0 THEN 'market' WHEN 1 THEN 'historical' ELSE 'estimate' END AS basis0, h % 7 <> 0 AS own, h % 4 = 0 AS web, h % 2 = 0 AS declared,
  CASE WHEN h % 13 = 0 THEN 2.5 ELSE 2.004 END AS factor0, 2.0 AS real, round(ref_price * 2.0) AS adjusted, h % 7 <> 0 AND (unit_price_thb IS NOT NULL OR h % 19 <> 0) AS ranged FROM l),
y AS (SELECT *, NOT own AND NOT web AND basis0 <> 'estimate' AS lost, own OR web AS any_kept, declared AND abs(real - factor0) <= real * 0.005 AS derived FROM x),
z AS (SELECT *, NOT lost AND basis0 = 'historical' AND NOT own AS no_own, NOT lost AND basis0 = 'market' AND NOT web AS no_web FROM y),
a AS (SELECT *, CASE WHEN lost OR no_own OR no_web THEN 'estimate' ELSE basis0 END AS basis1, least(CASE WHEN lost OR no_own OR no_web THEN 1 WHEN declared THEN 3 ELSE 2 END, CASE WHEN own AND list_contains(quality_flags, 'org_unmapped') THEN 2 ELSE 3 END) AS rank1 FROM z),
b AS (SELECT *, ranged AND price >= ref_price * (1 - 0.02) AND price <= ref_price * (1 + 0.02) AS by_range, derived AND ranged AND abs(price - adjusted) <= greatest(1.0, adjusted * 0.005) AS by_index FROM a),
c AS (SELECT *, basis1 = 'historical' AND NOT ranged AND NOT declared AND own AS unseen, basis1 = 'historical' AND (ranged OR declared) AND NOT by_range AND NOT by_index AS untraced FROM b),
e AS (SELECT *, untraced AND ranged AND (price > ref_price * 10 OR price < ref_price / 10) AS far,
  ranged AND unit_price_thb IS NULL AND h % 17 = 0 AND amount_thb <> 0 AND price >= amount_thb * (1 - 0.02) AND price <= amount_thb * (1 + 0.02) AS lump FROM c),
f AS (SELECT *, CASE WHEN far THEN 'estimate' ELSE basis1 END <> 'estimate' AND price BETWEEN 2500 * (1 - 0.02) AND 2500 * (1 + 0.02) AS hinted FROM e)
SELECT source_id AS line_id, CASE WHEN far OR hinted THEN 'estimate' ELSE basis1 END AS basis, ['low', 'medium', 'high'][CASE WHEN unseen OR untraced OR lump THEN 1 ELSE rank1 END] AS confidence, (item_qty * price)::DOUBLE + CASE WHEN h % 11 = 0 THEN 0 ELSE 0 END AS total_thb,
  CASE WHEN derived THEN 2.0::DOUBLE END AS factor, (own::INT + web::INT)::BIGINT AS n_kept, array_to_string(list_filter([CASE WHEN lost THEN 'citations_lost' END, CASE WHEN no_own THEN 'historical_without_source' END, CASE WHEN no_web THEN 'market_without_source' END,
  CASE WHEN declared AND NOT derived THEN 'derivation_dropped' END, CASE WHEN unseen THEN 'price_not_verifiable' END, CASE WHEN untraced THEN 'price_not_traceable' END, CASE WHEN far THEN 'price_far_off' END, CASE WHEN lump THEN 'amount_per_line_as_unit_price' END, CASE WHEN hinted THEN 'implied_price' END, CASE WHEN h % 11 = 0 THEN 'total_recomputed' END], lambda w: w IS NOT NULL), '|') AS warnings FROM f"""


@query(_EVIDENCE)
def evidence_check(spark, d):
    # Read four times: as lines, as their citations, as evidence and for what was derived.
    source = written(budget_lines(spark, d).select("source_id", "source_row", "item_qty", "unit_price_thb", "amount_thb", "quality_flags"), "evidence")
    lines = _boq(source)
    h = F.conv(F.substring("source_id", 1, 6), 16, 10).cast("long")
    evidence = source.select(F.col("source_id").alias("ref"), F.lit("budget_line").alias("kind"), "unit_price_thb", F.when(h % 19 != 0, F.col("amount_thb")).alias("amount_thb"), F.when(h % 17 != 0, F.col("item_qty")).alias("item_qty"), F.when(F.array_contains("quality_flags", "org_unmapped"), "medium").alias("ceiling"))
    made = lines.filter(F.col("from_amount").isNotNull()).select("from_amount", "from_year", "to_year", "indicator").distinct()
    adjustments = made.withColumn("real_factor", F.lit(2.0)).withColumn("adjusted_thb", F.round(F.col("from_amount") * 2.0))
    hints = spark.createDataFrame([(2500,)], "value_thb long")
    found = proposals.validate(lines, evidence, adjustments, hints)
    return found.withColumn("warnings", F.array_join("warnings", "|"))


@query("""WITH c AS (SELECT conv_id AS proposal_id, turn AS pos, role || '-' || (length(text) % 5) AS ref FROM conversations), f AS (SELECT proposal_id, ref, min(pos) AS pos FROM c GROUP BY ALL)
SELECT proposal_id, ref, row_number() OVER (PARTITION BY proposal_id ORDER BY pos, ref) AS number FROM f""")
def citation_numbers(spark, d):
    c = table(spark, d, "conversations")
    return proposals.numbered_citations(c.select(F.col("conv_id").alias("proposal_id"), F.col("turn").alias("pos"), F.concat_ws("-", "role", (F.length("text") % 5).cast("string")).alias("ref")))


@query("SELECT conv_id AS proposal_id, round(count(*) FILTER (WHERE length(text) % 3 > 0) / count(*), 6) AS precision FROM conversations GROUP BY conv_id")
def citation_precision(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("proposal_id"), (F.length("text") % 3 > 0).alias("kept"))
    return proposals.citation_precision(c).withColumn("precision", F.round("precision", 6))


@query()
def implied_unit_price(spark, d):
    items = table(spark, d, "lineitem")
    # What a tool of whole-baht prices sees: quantity times a price by part, with some lines off.
    amount = F.when(F.col("l_linenumber") == 7, F.round("l_extendedprice")).otherwise(F.col("l_quantity") * (2500 + F.col("l_partkey") % 97 * 100)).cast("long")
    return implied.implied_prices(items.select("l_partkey", amount.alias("amount_thb")), "l_partkey")

