"""Organisations: building the dimension from facts, and resolving names to it step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean

MIN_SIMILARITY = 0.92
#: Local governments have short names that differ in a letter: never matched by likeness.
LOCAL_PREFIXES = ("เทศบาล", "องค์การบริหารส่วน")
SYNTHETIC_PREFIX = "X-"


def modal_names(rows: DataFrame, code: str, name: str) -> DataFrame:
    """code, name (its commonest; ties by the name), aliases (all others)."""
    counts = rows.filter(F.col(code).isNotNull() & F.col(name).isNotNull()).groupBy(code, name).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy(code).orderBy(F.desc("n"), F.asc(name))))
    best = F.max(F.when(F.col("rn") == 1, F.col(name)))
    others = F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.col(name))))
    return ranked.groupBy(F.col(code).alias("code")).agg(best.alias("name"), others.alias("aliases"))


def organisations(facts: DataFrame) -> DataFrame:
    """Ministries and agencies: code, name, level, ministry_code, aliases. ``facts``: min_code, min_name, agc_code, agc_name, row_no."""
    ministries = modal_names(facts, "min_code", "min_name").select("code", "name", F.lit("ministry").alias("level"), F.lit(None).cast("string").alias("ministry_code"), "aliases")
    parents = facts.groupBy(F.col("agc_code").alias("code")).agg(F.min_by("min_code", "row_no").alias("ministry_code"))
    agencies = modal_names(facts, "agc_code", "agc_name").join(parents, "code").select("code", "name", F.lit("agency").alias("level"), "ministry_code", "aliases")
    return ministries.unionByName(agencies)


def with_synthetic(ministries: DataFrame, keywords: list[str]) -> DataFrame:
    """Adds a made-up record for each keyword that no name contains."""
    asked = ministries.sparkSession.createDataFrame([(f"{SYNTHETIC_PREFIX}{i:02d}", k) for i, k in enumerate(keywords, 1)], "code string, name string")
    absent = asked.alias("k").join(ministries.select(F.col("name").alias("known")), F.contains(F.col("known"), F.col("k.name")), "left_anti")
    row = absent.select("code", "name", F.lit("ministry").alias("level"), F.lit(None).cast("string").alias("ministry_code"), F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("synthetic"))
    return ministries.withColumn("synthetic", F.lit(False)).unionByName(row)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal names, less by the edits between them. A documented stand-in for a library's own score."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def spellings(orgs: DataFrame) -> DataFrame:
    """code, ministry_code, level, spelling (cleaned), own (the name itself, not an alias)."""
    own = orgs.select("code", "ministry_code", "level", clean(F.col("name")).alias("spelling"), F.lit(True).alias("own"))
    other = orgs.select("code", "ministry_code", "level", F.explode("aliases").alias("a")).select("code", "ministry_code", "level", clean(F.col("a")).alias("spelling"), F.lit(False).alias("own"))
    return own.unionByName(other)


def _first(hits: DataFrame, *order) -> DataFrame:
    best = Window.partitionBy("pair").orderBy(*order, "code")
    return hits.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") == 1).drop("__n")


def _most_edits(length: Column) -> Column:
    """Edits between a name of this length and any that is like it enough; not less, whatever floating point makes of the bound."""
    return F.floor(F.ceil(length / MIN_SIMILARITY) * (1 - MIN_SIMILARITY) + 1e-6).cast("int")


def _near(asked: DataFrame, known: DataFrame, parent: list[str]) -> DataFrame:
    """key, parent, near, score: the known spellings (spelling, parent) that are like each asked key. Exact, without comparing all with all.

    A spelling is cut into one piece more than it may have edits, so that one of them stands unchanged in whatever is like it, moved by
    no more places than there are edits. Candidates are looked up by pieces and compared whole.
    """
    piece = lambda length, edits, k: (F.floor(length * k / (edits + 1)) + 1).cast("int")
    cut = known.withColumn("__length", F.length("spelling")).withColumn("__edits", _most_edits(F.col("__length")))
    cut = cut.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__edits"))))
    start, end = piece(F.col("__length"), F.col("__edits"), F.col("__k")), piece(F.col("__length"), F.col("__edits"), F.col("__k") + 1)
    cut = cut.select("spelling", *parent, "__length", "__k", F.substring("spelling", start, end - start).alias("__piece"))
    length = F.length("key")
    # Each edit changes the length by one at most.
    lengths = F.sequence(F.floor(length * MIN_SIMILARITY).cast("int"), F.ceil(length / MIN_SIMILARITY).cast("int"))
    look = asked.withColumn("__length", F.explode(lengths)).withColumn("__edits", _most_edits(F.col("__length")))
    look = look.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__edits")))).withColumn("__by", F.explode(F.sequence(-F.col("__edits"), F.col("__edits"))))
    look = look.withColumn("__from", start + F.col("__by")).filter(F.col("__from") >= 1)
    look = look.select("key", *parent, "__length", "__k", F.substring("key", F.col("__from"), end - start).alias("__piece"))
    pairs = look.join(cut, [*parent, "__length", "__k", "__piece"]).select("key", *parent, F.col("spelling").alias("near")).distinct()
    return pairs.withColumn("score", likeness(F.col("key"), F.col("near"))).filter(F.col("score") >= MIN_SIMILARITY)


def _step(asked: DataFrame, names: DataFrame, within: bool) -> DataFrame:
    """pair, code, method, score of the asked (pair, key, and parent where ``within``): equal spelling first, likeness for the rest."""
    same = [F.col("key") == F.col("spelling")] + ([F.col("parent") == F.col("ministry_code")] if within else [])
    exact = _first(asked.join(names, same), F.desc("own")).select("pair", "code", F.when(F.col("own"), "exact").otherwise("alias").alias("method"), F.lit(1.0).alias("score"))
    rest = asked.join(exact.select("pair"), "pair", "left_anti").filter(~F.coalesce(F.col("key").rlike("^(" + "|".join(LOCAL_PREFIXES) + ")"), F.lit(False)))
    parent = ["parent"] if within else []
    todo, known = rest.select("key", *parent).distinct(), names.select("spelling", *([F.col("ministry_code").alias("parent")] if within else [])).distinct()
    near = _near(todo, known, parent)
    again = [F.col("near") == F.col("spelling")] + ([F.col("parent") == F.col("ministry_code")] if within else [])
    scored = near.join(names, again).select("key", *parent, "code", "score")
    scored = rest.join(scored, ["key", *parent])
    return exact.unionByName(_first(scored, F.desc("score")).select("pair", "code", F.lit("fuzzy").alias("method"), "score"))


def resolve(lines: DataFrame, orgs: DataFrame, ministry: str = "ministry", agency: str = "agency") -> DataFrame:
    """ministry, agency with ministry_code, agency_code, method, score, flags: one row for each distinct pair of names.

    The ministry first; the agency within it; an agency of an unknown ministry by its exact spelling anywhere, if that is unambiguous.
    """
    order = F.array(*map(F.lit, ("none", "fuzzy", "alias", "exact")))
    rank = lambda m: F.array_position(order, F.coalesce(m, F.lit("none")))
    pairs = lines.select(F.col(ministry).alias("ministry"), F.col(agency).alias("agency")).distinct().withColumn("pair", F.sha1(F.to_json(F.struct("ministry", "agency"))))
    names = spellings(orgs)
    m = _step(pairs.select("pair", clean(F.col("ministry")).alias("key")).filter(F.col("key") != ""), names.filter("level = 'ministry'"), False)
    m = m.select("pair", F.col("code").alias("m_code"), F.col("method").alias("m_method"), F.col("score").alias("m_score"))
    known = pairs.join(m, "pair", "left")
    agencies = names.filter("level = 'agency'")
    asked = known.filter(F.col("m_code").isNotNull()).select("pair", clean(F.col("agency")).alias("key"), F.col("m_code").alias("parent")).filter(F.col("key") != "")
    inside = _step(asked, agencies, True)
    single = agencies.groupBy("spelling").agg(F.count_distinct("code").alias("c"), F.min("code").alias("code"), F.max("own").alias("own"), F.min("ministry_code").alias("parent_code")).filter("c = 1")
    lost = known.filter(F.col("m_code").isNull()).select("pair", clean(F.col("agency")).alias("key")).filter(F.col("key") != "")
    anywhere = lost.join(single, F.col("key") == F.col("spelling")).select("pair", "code", F.when(F.col("own"), "exact").otherwise("alias").alias("method"), F.lit(1.0).alias("score"), "parent_code")
    a = inside.withColumn("parent_code", F.lit(None).cast("string")).unionByName(anywhere)
    out = known.join(a.select("pair", F.col("code").alias("agency_code"), F.col("method").alias("a_method"), F.col("score").alias("a_score"), "parent_code"), "pair", "left")
    code = F.coalesce("m_code", "parent_code")
    weaker = F.when(F.col("m_code").isNull(), F.col("a_method")).otherwise(order[(F.least(rank(F.col("m_method")), rank(F.col("a_method"))) - 1).cast("int")])
    found = F.col("agency_code").isNotNull()
    flags = F.filter(F.array(F.when(code.isNull(), "ministry_unmapped"), F.when(~found, "org_unmapped")), lambda x: x.isNotNull())
    return out.select("ministry", "agency", code.alias("ministry_code"), "agency_code", F.when(found, weaker).otherwise("none").alias("method"),
                      F.when(found, F.least(F.coalesce("m_score", F.lit(1.0)), "a_score")).otherwise(0.0).alias("score"), flags.alias("flags"))
