"""Raw lines to the fact schema: parsed names, filled columns, computed prices, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.numbers import rate
from ..functions.text import expand_local_gov, nfc
from ..schema import FACT_SCHEMA, QTY_LOW_CONF, UPSTREAM_OCR
from .items import HIGH_QTY, computed_price, explicit_quantity, parse_items

# Codes and words of the sources, fixed values.
LOCAL_MINISTRY, ENTERPRISE_MINISTRY = "75000", "50000"
LOCAL_AGENCY_WORDS = ("เทศบาล", "องค์การบริหารส่วน", "เมืองพัทยา")
CAPITAL_WORDS = {"รายจ่ายลงทุน": True, "รายจ่ายประจำ": False}


def level_of_ministry(code: Column) -> Column:
    return F.when(code == LOCAL_MINISTRY, "local").when(code == ENTERPRISE_MINISTRY, "state_enterprise").when(code.isNotNull(), "central")


def level_of_agency(name: Column) -> Column:
    local = F.lit(False)
    for word in LOCAL_AGENCY_WORDS:
        local = local | name.startswith(word)
    return F.when(local, "local").when(name.isNotNull(), "central")


def is_capital(kind: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for word, capital in CAPITAL_WORDS.items():
        out = F.when(kind == word, capital).otherwise(out)
    return out


def union_of_flags(*lists: Column) -> Column:
    """All flags in order of first appearance; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(x, none) for x in lists]))


def facts(raw: DataFrame, mismatched_groups: DataFrame | None = None, group: tuple[str, ...] = ("plan", "activity", "expense_category")) -> DataFrame:
    """Lines of any source in the fact schema. What a source gives wins over what is parsed or derived; missing columns are null."""
    x = parse_items(raw.withColumn("item_name_raw", nfc(F.col("item_name_raw"))))
    for f in FACT_SCHEMA.fields:
        if f.name not in x.columns:
            x = x.withColumn(f.name, F.lit(None).cast(f.dataType))
    own, found = F.col("quality_flags"), F.col("item.quality_flags")
    qty = F.coalesce("item_qty", "item.item_qty")
    doubtful = (qty >= HIGH_QTY) & ~F.coalesce(explicit_quantity(F.col("item_name_raw")), F.lit(False))
    late = F.when(F.coalesce(doubtful, F.lit(False)), F.array(F.lit(QTY_LOW_CONF)))
    price = computed_price(union_of_flags(own, found), qty, F.col("amount_thb"), F.col("unit_price_thb"), F.col("item_name_raw"))
    mismatch = F.lit(None).cast("array<string>")
    if mismatched_groups is not None:
        keys = mismatched_groups.select(*[F.col(g).alias(f"__{g}") for g in group]).distinct().withColumn("__bad", F.lit(True))
        x = x.join(keys, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], "left").drop(*[f"__{g}" for g in group])
        mismatch = F.when(F.col("__bad"), F.array(F.lit("group_total_mismatch")))
    ocr = F.when(F.array_contains(own, UPSTREAM_OCR), F.array(F.lit(UPSTREAM_OCR)))
    values = {
        "province": F.coalesce("province", "item.province"), "item_key": F.coalesce("item_key", "item.item_key"), "location_text": F.col("item.location_text"), "item_qty": qty, "item_unit": F.coalesce("item_unit", "item.item_unit"),
        "spec_tokens": F.coalesce("item.spec_tokens", F.array().cast("array<string>")), "unit_price_thb": price, "gov_level": F.coalesce("gov_level", level_of_ministry(F.col("ministry_code")), level_of_agency(F.col("agency"))),
        "local_gov_name": expand_local_gov(F.col("local_gov_name")), "is_capital": F.coalesce("is_capital", is_capital(F.col("budget_type"))), "fiscal_year_ce": F.coalesce("fiscal_year_ce", (F.col("fiscal_year_be") - 543)),
        "disbursement_rate": F.coalesce("disbursement_rate", rate(F.col("disbursed_thb"), F.col("revised_thb"))), "quality_flags": union_of_flags(own, found, late, ocr, mismatch),
    }
    # Lists keep their own type: none of them holds a null, but only the schema of a source can promise that.
    typed = lambda f, c: c if isinstance(f.dataType, ArrayType) else c.cast(f.dataType)
    return x.select(*[typed(f, values.get(f.name, F.col(f.name))).alias(f.name) for f in FACT_SCHEMA.fields])
