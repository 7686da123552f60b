"""The fact table's schema, its vocabularies, and the row predicates that every aggregate shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, ShortType, StringType, StructField, StructType

_STRING, _LONG = StringType(), LongType()
#: Column order and types of a normalised budget line.
FACT_SCHEMA = StructType(
    [StructField(n, _STRING) for n in ("source_id", "dataset")]
    + [StructField(n, ShortType()) for n in ("fiscal_year_be", "fiscal_year_ce")]
    + [StructField(n, _STRING) for n in "gov_level ministry ministry_code agency agency_code province local_gov_name strategy budget_group plan output_project activity budget_type expense_category".split()]
    + [StructField("is_capital", BooleanType())]
    + [StructField(n, _STRING) for n in ("item_name_raw", "item_name", "item_key")]
    + [StructField("item_qty", DoubleType()), StructField("item_unit", _STRING), StructField("spec_tokens", ArrayType(_STRING, False)), StructField("location_text", _STRING)]
    + [StructField(n, _LONG) for n in "amount_thb unit_price_thb revised_thb po_thb disbursed_thb disbursed_incl_po_thb reserved_thb carryover_thb".split()]
    + [StructField("disbursement_rate", DoubleType())]
    + [StructField(n, _STRING) for n in "description legal_reference source_path source_sheet".split()]
    + [StructField(n, IntegerType()) for n in ("source_row", "source_page")]
    + [StructField("source_doc_id", _STRING), StructField("quality_flags", ArrayType(_STRING, False))]
)
#: Columns that a published shard leaves out.
NOT_PUBLISHED = ("item_name", "location_text", "fiscal_year_ce")

DATASETS = ("pbo_disbursement", "act_2570_draft", "act_2570_province", "local_subsidy_2570", "local_ordinance_2570", "committee_table")
GOV_LEVELS = ("central", "local", "state_enterprise")

# Flags, fixed values.
SUBSET = "subset_of_act_2570_draft"
CORRUPT = "corrupt_row"
LUMP_SUM = "lump_sum_category"
PRICE_OUTLIER = "unit_price_outlier"
QTY_MEASURE = "qty_is_measure"
QTY_LOW_CONF = "qty_parsed_low_conf"
ORG_UNMAPPED = "org_unmapped"
GROUP_MISMATCH = "group_total_mismatch"
UPSTREAM_OCR = "upstream_ocr"
#: Phrase in a raw name that marks a lump sum ("price for each unit below ...").
LUMP_SUM_PHRASE = "ราคาต่อหน่วยต่ำกว่า"


def has(flag: str, flags: str = "quality_flags") -> Column:
    """Null flags give null, as in SQL: a filter on this, or on its negation, drops such rows."""
    return F.array_contains(flags, flag)


def lacks(*flags: str) -> Column:
    out = F.lit(True)
    for flag in flags:
        out = out & ~has(flag)
    return out


def countable() -> Column:
    """Lines that take part in the catalogue at all."""
    return F.col("item_key").isNotNull() & lacks(SUBSET, CORRUPT, LUMP_SUM)


def usable_price() -> Column:
    return (F.col("unit_price_thb") > 0) & lacks(PRICE_OUTLIER, QTY_MEASURE, QTY_LOW_CONF)


def usable_amount() -> Column:
    return (F.col("amount_thb") > 0) & lacks(PRICE_OUTLIER)
