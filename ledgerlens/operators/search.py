"""Full-text search over short texts: an inverted index as a table, BM25 with prefix and fuzzy terms, re-ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_away
from ..functions.text import fold, holds_number, tokens

K1, B = 1.2, 0.7
#: Edits allowed as a share of a term's length; weights of terms that match in part only.
FUZZY = 0.2
PREFIX_WEIGHT, FUZZY_WEIGHT = 0.375, 0.45
POPULARITY = 0.25


def build_index(items: DataFrame, text: str = "key") -> DataFrame:
    """term, id, tf, length (of the item, in terms). ``items``: id and the text."""
    terms = items.select("id", tokens(fold(F.col(text))).alias("terms"))
    posted = terms.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return posted.groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf")).select("term", "id", "tf", "length")


def query_terms(spark, query: str) -> list[str]:
    """Distinct terms of a query; numbers of one or two digits are left out unless nothing else is there."""
    terms = spark.range(1).select(F.array_distinct(tokens(fold(F.lit(query)))).alias("t")).first()["t"]
    strong = [t for t in terms if not (t.isdigit() and len(t) <= 2)]
    return strong or terms


def forms(term: Column) -> Column:
    """What a term is found by: itself, its prefixes of three letters or more, and its pieces.

    A query term of n letters may be off by a share of n; so the most edits at which any query meets a term of m letters are known from
    m, and a term is cut into one piece more than that: whatever the edits, one piece stays whole, moved by no more than they are.
    """
    n = F.length(term)
    pieces = F.floor(n * (FUZZY / (1 - FUZZY))).cast("int") + 1
    short = F.floor(n / pieces).cast("int")
    plain = pieces - (n % pieces)  # so many pieces are short, the others one letter longer
    start = lambda i: i * short + F.greatest(F.lit(0), i - plain)
    cut = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.concat(F.lit("~"), n.cast("string"), F.lit("."), i.cast("string"), F.lit(":"), F.substring(term, start(i) + 1, short + (i >= plain).cast("int"))))
    none = F.array().cast("array<string>")
    prefixes = F.when(n > 2, F.transform(F.sequence(F.lit(3), F.greatest(n, F.lit(3))), lambda i: F.concat(F.lit("<"), F.substring(term, F.lit(1), i)))).otherwise(none)
    return F.concat(F.array(F.concat(F.lit("="), term)), prefixes, F.when(pieces > 1, cut).otherwise(none))


def spellings(vocabulary: DataFrame) -> DataFrame:
    """form, term: every form that a term of the vocabulary is found by."""
    return vocabulary.select(F.explode(forms(F.col("term"))).alias("form"), "term")


def asked_forms(term: str) -> set[str]:
    """The forms of all terms that a query term may mean: equal ones, longer ones, and those within its edits."""
    out, n = {f"={term}"}, len(term)
    if n <= 2 or term.replace(".", "", 1).isdigit():
        return out
    out.add(f"<{term}")
    edits = math.floor(n * FUZZY)
    for size in range(n - edits, n + edits + 1) if edits else ():
        pieces = math.floor(size * (FUZZY / (1 - FUZZY))) + 1
        short, longer = divmod(size, pieces)
        for i in range(pieces):
            at, width = i * short + max(0, i - (pieces - longer)), short + (i >= pieces - longer)
            out |= {f"~{size}.{i}:{term[p : p + width]}" for p in range(max(0, at - edits), min(n - width, at + edits) + 1)}
    return out


def matched_terms(spelt: DataFrame, terms: list[str]) -> DataFrame:
    """term, asked, weight: the terms that a query's terms mean, looked up by their forms.

    Terms of one or two characters, and numbers, match exactly only.
    """
    rows = [(t, form) for t in terms for form in sorted(asked_forms(t))]
    asked = spelt.sparkSession.createDataFrame(rows, "asked string, form string")
    found = spelt.join(asked, "form").select("term", "asked").distinct()
    loose = (F.length("asked") > 2) & ~F.col("asked").rlike(r"^\d+(\.\d+)?$")
    edits = F.levenshtein("term", "asked")
    near = edits <= F.floor(F.length("asked") * FUZZY)
    fits = (F.col("term") == F.col("asked")) | (loose & (F.col("term").startswith(F.col("asked")) | near))
    weight = (
        F.when(F.col("term") == F.col("asked"), 1.0)
        .when(F.col("term").startswith(F.col("asked")), PREFIX_WEIGHT * F.length("asked") / F.length("term"))
        .otherwise(FUZZY_WEIGHT * F.length("asked") / (F.length("asked") + edits))
    )
    return found.filter(fits).select("term", "asked", weight.alias("weight"))


def scored(postings: DataFrame, matched: DataFrame, sizes: tuple[int, float]) -> DataFrame:
    """id, score, matched: BM25 of postings (term, id, tf, length) over matched terms (term, asked, weight, df). ``sizes``: number of items and their mean length."""
    n, mean = sizes
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    return postings.join(matched, "term").groupBy("id").agg(F.sum(part).alias("score"), F.countDistinct("asked").alias("matched"))


def hits(index: DataFrame, terms: list[str], sizes: tuple[int, float]) -> DataFrame:
    """id, score, matched: BM25 over exact, prefix and near terms of an index that is not kept: its spellings are made on the way."""
    vocabulary = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return scored(index, matched_terms(spellings(vocabulary), terms).join(vocabulary, "term"), sizes)


def reranked(found: DataFrame, items: DataFrame, terms: list[str]) -> DataFrame:
    """score * coverage squared * damped popularity * (1 + whole numbers of the query in the key)."""
    numbers = [t for t in terms if t.replace(".", "", 1).isdigit()]
    exact: Column = F.lit(1)
    for number in numbers:
        exact = exact + holds_number(F.col("key"), number.replace(".", r"\.")).cast("int")
    coverage = F.least(F.col("matched") / F.lit(float(max(1, len(terms)))), F.lit(1.0))
    popular = 1 + POPULARITY * F.log1p(F.greatest("n_lines", F.lit(0)).cast("double"))
    return found.join(items, "id").withColumn("rank_score", F.col("score") * coverage * coverage * popular * exact)


def chosen(found: DataFrame, years: tuple[int, ...] = (), priced_only: bool = False) -> DataFrame:
    """Of ranked hits, those of any of the years and those with a unit price."""
    found = found.filter(F.arrays_overlap("years", F.array(*map(F.lit, years)))) if years else found
    return found.filter("has_unit_price") if priced_only else found


def first_page(found: DataFrame, limit: int) -> DataFrame:
    """The best hits; ties by id."""
    return found.orderBy(F.desc("rank_score"), "id").limit(max(0, min(limit, 20))).withColumn("rank_score", round_half_away(F.col("rank_score"), 6))


def search(index: DataFrame, items: DataFrame, query: str, limit: int = 10, years: tuple[int, ...] = (), priced_only: bool = False) -> DataFrame:
    """The best items (id, key, n_lines, and years / has_unit_price where filtered by); ties by id."""
    sizes = index.select("id", "length").distinct().agg(F.count(F.lit(1)), F.avg("length")).first()
    terms = query_terms(index.sparkSession, query)
    found = reranked(hits(index, terms, (sizes[0], sizes[1] or 1.0)), items, terms)
    return first_page(chosen(found, years, priced_only), limit)


def with_total(found: DataFrame, limit: int) -> DataFrame:
    """The first page of ranked hits and, in each row, how many hits there are: a separate count, not a window over all."""
    return first_page(found, limit).withColumn("total", F.lit(found.count()))


def fresh(index_version: DataFrame, data_version: DataFrame) -> bool:
    """Whether an index belongs to the data: one row (version) each."""
    return index_version.first()["version"] == data_version.first()["version"]
