"""Validation of costed proposals against evidence: each line's citations, price and totals.

All rules run over exploded citations joined to the evidence at once; a line's verdict is then a chain of conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import in_range

PRICE_TOLERANCE = 0.02
FACTOR_TOLERANCE = 0.005
FAR_OFF = 10
HINT_STEP = 1.05
LEVELS = ("low", "medium", "high")


def level(confidence: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), confidence).cast("int")


def level_name(rank: Column) -> Column:
    return F.array(*map(F.lit, LEVELS))[rank - 1]


def citations(lines: DataFrame, *carried: Column) -> DataFrame:
    """line_id, pos, kind, ref and what is carried along: one row a citation. ``lines``: line_id and citations, an array of (kind, ref)."""
    return lines.select("line_id", *carried, F.posexplode("citations").alias("pos", "c")).select("*", "c.kind", "c.ref").drop("c")


def kept_citations(lines: DataFrame, evidence: DataFrame, *carried: Column) -> DataFrame:
    """Citations that resolve: web ones with an https address, others by an id in the evidence."""
    cited = citations(lines, *carried)
    known = cited.join(evidence.select(F.col("ref"), F.col("kind").alias("e_kind"), "unit_price_thb", "amount_thb", "item_qty", "ceiling"), "ref", "left")
    good = F.when(F.col("kind") == "web", F.col("ref").startswith("https://")).otherwise(F.col("e_kind") == F.col("kind"))
    return known.filter(F.coalesce(good, F.lit(False)))


def validate(lines: DataFrame, evidence: DataFrame, adjustments: DataFrame, hints: DataFrame) -> DataFrame:
    """basis, confidence, total_thb and warnings of each line.

    ``lines``: line_id, qty, unit_price_thb, total_thb, basis, confidence, citations, and from_amount, from_year, to_year,
    indicator, factor of a declared price derivation (null: none). ``evidence``: ref, kind, unit_price_thb, amount_thb,
    item_qty, ceiling (a confidence or null). ``adjustments``: from_amount, from_year, to_year, indicator, real_factor,
    adjusted_thb. ``hints``: value_thb (positive).
    """
    kept = kept_citations(lines, evidence, F.col("unit_price_thb").alias("asked_price"), F.col("from_amount").alias("asked_from"))
    is_row = F.col("kind") == "budget_line"
    price = F.when(is_row, F.coalesce("unit_price_thb", "amount_thb"))
    lump = is_row & F.col("unit_price_thb").isNull() & F.col("item_qty").isNull() & (F.col("amount_thb") != 0)
    facts = kept.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n_kept"), F.count_if(F.col("kind").isin("budget_line", "document")).alias("n_own"), F.count_if(F.col("kind") == "web").alias("n_web"), F.count_if(is_row).alias("n_rows"),
        F.min(price).alias("low"), F.max(price).alias("high"), F.min(F.when(is_row, level(F.col("ceiling")))).alias("ceiling"),
        F.max(F.coalesce(lump & in_range(F.col("asked_price"), F.col("amount_thb"), F.col("amount_thb"), PRICE_TOLERANCE), F.lit(False))).alias("as_lump"),
        F.max(F.coalesce(F.abs(price - F.col("asked_from")) <= 1, F.lit(False))).alias("from_cited"),
    )
    keys = ["from_amount", "from_year", "to_year", "indicator"]
    # A hint lies in its price's step of a geometric scale or in the next: steps are wider than the tolerance.
    step = lambda c: F.floor(F.ln(c) / F.ln(F.lit(HINT_STEP)))
    near = hints.select("value_thb", F.explode(F.array(*[step(F.col("value_thb")) + k for k in (-1, 0, 1)])).alias("__step"))
    all_hints = near.groupBy("__step").agg(F.collect_set("value_thb").alias("__hints"))
    x = lines.join(facts, "line_id", "left").join(adjustments.select(*keys, "real_factor", "adjusted_thb"), keys, "left")
    x = x.withColumn("__step", step(F.col("unit_price_thb"))).join(all_hints, "__step", "left")
    for name in ("n_kept", "n_own", "n_web", "n_rows"):
        x = x.withColumn(name, F.coalesce(name, F.lit(0)))

    declared = F.col("factor").isNotNull()
    gap = F.abs(F.col("real_factor") - F.col("factor"))
    derived = declared & F.coalesce(gap <= F.col("real_factor") * FACTOR_TOLERANCE, F.lit(False))
    lost = (F.size("citations") > 0) & (F.col("n_kept") == 0) & (F.col("basis") != "estimate")
    no_own = ~lost & (F.col("basis") == "historical") & (F.col("n_own") == 0)
    no_web = ~lost & (F.col("basis") == "market") & (F.col("n_web") == 0)
    basis1 = F.when(lost | no_own | no_web, "estimate").otherwise(F.col("basis"))
    capped = F.least(F.when(lost | no_own | no_web, 1).otherwise(level(F.col("confidence"))), F.coalesce("ceiling", F.lit(len(LEVELS))))
    x = x.withColumns({"derived": derived, "lost": lost, "no_own": no_own, "no_web": no_web, "basis1": basis1, "rank1": capped})

    ranged = F.col("low").isNotNull()
    by_range = ranged & in_range(F.col("unit_price_thb"), F.col("low"), F.col("high"), PRICE_TOLERANCE)
    from_range = F.coalesce("from_cited", F.lit(False)) | (ranged & in_range(F.col("from_amount"), F.col("low"), F.col("high"), PRICE_TOLERANCE))
    rounding = F.greatest(F.lit(1.0), F.col("adjusted_thb") * FACTOR_TOLERANCE)
    by_index = F.col("derived") & from_range & (F.abs(F.col("unit_price_thb") - F.col("adjusted_thb")) <= rounding)
    historical = F.col("basis1") == "historical"
    unseen = historical & ~ranged & ~declared & (F.col("n_rows") > 0)
    untraced = historical & (ranged | declared) & ~F.coalesce(by_range, F.lit(False)) & ~F.coalesce(by_index, F.lit(False))
    far = untraced & ranged & ((F.col("unit_price_thb") > F.col("high") * FAR_OFF) | (F.col("unit_price_thb") < F.col("low") / FAR_OFF))
    as_lump = F.coalesce("as_lump", F.lit(False))
    hinted_price = F.exists(F.coalesce("__hints", F.array().cast("array<long>")), lambda h: in_range(F.col("unit_price_thb"), h, h, PRICE_TOLERANCE))
    x = x.withColumns({"unseen": unseen, "untraced": untraced, "far": F.coalesce(far, F.lit(False)), "lump": as_lump})
    x = x.withColumn("hinted", (F.when(F.col("far"), "estimate").otherwise(F.col("basis1")) != "estimate") & hinted_price)
    computed = F.col("qty") * F.col("unit_price_thb")
    off = F.abs(computed - F.col("total_thb")) > 1
    warnings = F.filter(
        F.array(
            F.when(F.col("lost"), "citations_lost"), F.when(F.col("no_own"), "historical_without_source"), F.when(F.col("no_web"), "market_without_source"), F.when(declared & ~F.col("derived"), "derivation_dropped"),
            F.when(F.col("unseen"), "price_not_verifiable"), F.when(F.col("untraced"), "price_not_traceable"), F.when(F.col("far"), "price_far_off"), F.when(F.col("lump"), "amount_per_line_as_unit_price"),
            F.when(F.col("hinted"), "implied_price"), F.when(off, "total_recomputed"),
        ), lambda w: w.isNotNull(),
    )
    rank = F.when(F.col("unseen") | F.col("untraced") | F.col("lump"), F.least("rank1", F.lit(1))).otherwise(F.col("rank1"))
    return x.select("line_id", F.when(F.col("far") | F.col("hinted"), "estimate").otherwise(F.col("basis1")).alias("basis"), level_name(rank).alias("confidence"),
                    F.when(off, computed).otherwise(F.col("total_thb")).alias("total_thb"), F.when(F.col("derived"), F.col("real_factor")).alias("factor"), "n_kept", warnings.alias("warnings"))


def totals(lines: DataFrame, contingency: DataFrame) -> DataFrame:
    """By proposal: subtotal, contingency (a fixed sum, else a percentage) and grand total. ``contingency``: proposal_id, fixed, pct."""
    sums = lines.groupBy("proposal_id").agg(F.sum("total_thb").alias("subtotal"))
    extra = F.coalesce(F.col("fixed"), F.col("subtotal") * F.col("pct") / 100, F.lit(0.0))
    return sums.join(contingency, "proposal_id", "left").select("proposal_id", "subtotal", extra.alias("contingency"), (F.col("subtotal") + extra).alias("grand_total"))


def basis_mix(lines: DataFrame, bases: tuple[str, ...] = ("historical", "market", "estimate")) -> DataFrame:
    """Share of each basis in a proposal's total; zeros where the total isn't positive."""
    whole = F.sum("total_thb")
    shares = [F.when(whole > 0, F.coalesce(F.sum(F.when(F.col("basis") == b, F.col("total_thb"))), F.lit(0.0)) / whole).otherwise(0.0).alias(b) for b in bases]
    return lines.groupBy("proposal_id").agg(*shares)


def edited(lines: DataFrame, edits: DataFrame, most_qty: float = 1e9, most_price: float = 1e13) -> DataFrame:
    """Lines with edited quantities or prices, where within bounds, and their totals recomputed."""
    x = lines.join(edits.select("line_id", F.col("qty").alias("new_qty"), F.col("unit_price_thb").alias("new_price")), "line_id", "left")
    qty = F.when(F.col("new_qty").between(0, most_qty), F.col("new_qty")).otherwise(F.col("qty"))
    price = F.when(F.col("new_price").between(0, most_price), F.col("new_price")).otherwise(F.col("unit_price_thb"))
    return x.select("line_id", qty.alias("qty"), price.alias("unit_price_thb"), (qty * price).alias("total_thb"))


def numbered_citations(cited: DataFrame) -> DataFrame:
    """proposal_id, ref, number: each source once, numbered by its first appearance. ``cited``: proposal_id, pos, ref."""
    from pyspark.sql import Window

    first = cited.groupBy("proposal_id", "ref").agg(F.min("pos").alias("pos"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("proposal_id").orderBy("pos", "ref"))).drop("pos")


def corrected_comparables(comparables: DataFrame, truth: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Comparables (ref, ...) with their true values in place of what was given, and whether any differed."""
    x = comparables.join(truth.select("ref", *[F.col(v).alias(f"__{v}") for v in values]), "ref", "left")
    differs = F.lit(False)
    for v in values:
        differs = differs | (F.col(f"__{v}").isNotNull() & ~F.col(v).eqNullSafe(F.col(f"__{v}")))
    return x.withColumn("corrected", differs).withColumns({v: F.coalesce(f"__{v}", v) for v in values}).drop(*[f"__{v}" for v in values])


def citation_precision(cited: DataFrame, by: str = "proposal_id") -> DataFrame:
    """Share of citations that were kept; 1 where there is none."""
    return cited.groupBy(by).agg(F.coalesce(F.try_divide(F.count_if("kept"), F.count(F.lit(1))), F.lit(1.0)).alias("precision"))
