"""Evidence tests, typed values and stable keys (FLT-1, SC-16..18, 24, 25, 28, NST-*)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import nfkc_compact

# ---- fixed values ---------------------------------------------------------------------------
TRUST_LEVEL = 0.85
REGISTRY_CODES = (
    "building_name", "registry_location", "building_structure", "floor_areas", "house_number", "unit_name",
    "unit_type", "unit_structure", "unit_floor", "registered_area", "built_date", "current_owner_name",
    "current_owner_address", "land_lots", "has_land_right", "land_right_type", "land_right_numerator",
    "land_right_denominator", "active_mortgages",
)
RULES_SOURCE_CODES = (
    "pet_restrictions", "office_use_allowed", "instrument_restrictions", "renovation_restrictions",
    "leasing_restrictions", "parking_rules", "voting_rights_rule", "rules_effective_date",
    "unit_use_restrictions", "balcony_exclusive_use", "private_garden_rules", "door_window_exclusive_use",
    "management_association_name", "related_rules",
)
DISCLOSURE_CODES = ("wall_center_area", "floor_plan", "seller_name", "seller_address", "sale_price",
                    "earnest_money", "handover_date")
# ------------------------------------------------------------------------------------------


def is_absent(value_json: Column) -> Column:
    """SQL NULL and JSON null are both "no value"."""
    return value_json.isNull() | (value_json == "null")


def has_evidence(confidence: Column, page_no: Column, quote: Column) -> Column:
    return F.coalesce((confidence >= TRUST_LEVEL) & (page_no >= 1) & (F.trim(quote) != ""), F.lit(False))


def trusted(value_json: Column, confidence: Column, page_no: Column, quote: Column,
            needs_review: Column, default_review: bool = False) -> Column:
    """FLT-1, the evidence gate. ``default_review`` is what a missing review flag means on this path."""
    reviewed_ok = ~F.coalesce(needs_review, F.lit(default_review))
    return ~is_absent(value_json) & has_evidence(confidence, page_no, quote) & reviewed_ok


def clean_confidence(col: Column) -> Column:
    """SC-16: a finite number between 0 and 1, else null."""
    number = col.cast("double")
    return F.when(~F.isnan(number) & number.between(0.0, 1.0), number)


def quote_numbers(quote: Column, folded: bool = False) -> Column:
    """Decimal numbers printed in a quote; separators dropped, ":" between digits is a point. ``folded``: ``nfkc_compact`` was used already."""
    text = F.regexp_replace(F.replace(quote if folded else nfkc_compact(quote), F.lit(","), F.lit("")), r"(?<=\d):(?=\d)", ".")
    found = F.regexp_extract_all(text, F.lit(r"(?<![\d.])(-?\d+(?:\.\d+)?)(?![\d.])"), 1)
    return F.transform(found, lambda x: x.try_cast("decimal(38,10)"))


def number_in_quote(value: Column, quote: Column, folded: bool = False) -> Column:
    """SC-17: the number must be among the numbers of its quote."""
    return F.coalesce(F.array_contains(quote_numbers(quote, folded), value.cast("decimal(38,10)")), F.lit(False))


def lines_in_quotes(value: Column, quotes: Column) -> Column:
    """SC-18: every line of the value occurs in one quote or in the quotes joined together.

    ``quotes`` is an array of folded quotes.
    """
    pool = F.concat(quotes, F.array(F.array_join(quotes, "")))
    lines = F.filter(F.split(value, r"\R"), lambda line: F.trim(line) != "")
    folded = F.split(nfkc_compact(F.array_join(lines, "\u0002")), "\u0002")
    return F.forall(folded, lambda line: F.exists(pool, lambda q: F.contains(q, line)))


def canonical_number(col: Column) -> Column:
    """Number as text without trailing zeros, so 12000 and 12000.0 are equal."""
    text = col.cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def json_string(col: Column) -> Column:
    return F.when(col.isNotNull(), F.concat(F.lit('"'), F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def canonical_json(entries: Column) -> Column:
    """JSON object text with sorted keys from ``map<string,string>`` of JSON values."""
    pairs = F.array_sort(F.map_entries(entries))
    body = F.transform(pairs, lambda e: F.concat(json_string(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}"))


def content_key(*cols: Column) -> Column:
    """SC-24: SHA-256 over the parts; null and empty differ."""
    parts = F.array(*[F.coalesce(json_string(c.cast("string")), F.lit("null")) for c in cols])
    return F.sha2(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")), 256)


def choice_key(diff_id: Column, old: Column, new: Column) -> Column:
    """SC-25: a stored choice no longer matches once either side of the diff changes."""
    return content_key(diff_id, old, new)


def value_source(code: Column) -> Column:
    """SC-28: which document type a field's value comes from."""
    return (F.when(code.isin(*REGISTRY_CODES), "registry")
            .when(code.isin(*RULES_SOURCE_CODES), "management_rules")
            .when(code.isin(*DISCLOSURE_CODES), "purchase_important_explanation")
            .otherwise("important_report"))


def cast_by_catalog(value: Column, data_type: Column) -> Column:
    """NST-6: one column per type, filled by the catalog's data type."""
    bare = F.regexp_replace(value, '^"|"$', "")
    return F.struct(
        F.when(data_type == "number", bare.try_cast("decimal(38,10)")).alias("value_num"),
        F.when(data_type == "date", F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(bare, "yyyy-MM-dd"))).alias("value_date"),
        F.when(data_type == "boolean", bare.try_cast("boolean")).alias("value_bool"),
        F.when(data_type.isin("text", "json"), bare).alias("value_text"),
    )


def parcel_key(lands: Column) -> Column:
    """NST-3: parcels compare as a set of (location, lot); area and category do not count."""
    from .text import match_text
    pairs = F.transform(lands, lambda l: F.struct(match_text(l["location"]).alias("location"), match_text(l["lot_number"]).alias("lot")))
    pairs = F.coalesce(pairs, F.array().cast("array<struct<location:string,lot:string>>"))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(pairs)),
                                    lambda p: F.concat(p["location"], F.lit("\u0002"), p["lot"])), "\u0003")


def set_pointer(pointers: Column, code: Column, value_id: Column) -> Column:
    """NST-4: add or replace one entry of a field-to-evidence map."""
    kept = F.map_filter(F.coalesce(pointers, F.create_map().cast("map<string,string>")), lambda k, v: k != code)
    return F.map_concat(kept, F.create_map(code, value_id))


def first_evidence(sources: Column) -> Column:
    """PRJ-9: page of the first source and the distinct quotes in order, one per line."""
    quotes = F.array_distinct(F.transform(sources, lambda s: s["text"]))
    return F.struct(F.try_element_at(sources, F.lit(1))["page"].alias("page_no"), F.array_join(quotes, "\n").alias("source_text"))


def ordered_distinct(values: Column) -> Column:
    """SET-1: first occurrences, in order."""
    return F.array_distinct(values)


def sorted_reasons(values: Column) -> Column:
    """SRT-5."""
    return F.array_sort(F.array_distinct(values))


def spreadsheet_safe(col: Column) -> Column:
    """SNK-3: text a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(col.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), col)).otherwise(col)
