"""JOB-12, PRJ-5, PRJ-6: one document's field rows cleaned against its own page text.

Field rows come from an outside reader. The page tables give the same paths independently; where they
do, the table wins and the change is logged as a correction row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.shares import parse_share, share_text
from ..functions.text import nfkc, nfkc_compact
from ..operators.segment import carry_labels, labelled_values, lines_of, records, segment_records
from ..session import cut_lineage
from . import registry

# ---- fixed values: headings and correction categories -------------------------------------------------
UNIT_HEAD, HOUSE_HEAD, LAND_HEAD, RIGHT_HEAD = "専有部分の建物の表示", "主である建物の表示", "表題部(土地の表示)", "敷地権の表示"
C_NOTATION, C_AREA, C_TABLE, C_LAND, C_TYPE, C_RIGHT, C_LOT, C_HOUSE = (
    "表記正規化", "面積表記", "表罫線折返し", "過去履歴誤採用", "物件種別判定", "敷地権", "地番", "複数土地")
# ------------------------------------------------------------------------------------------------------


def document_facts(pages: DataFrame) -> DataFrame:
    """Headings, text quality and kind of each file, from map-side combined flags."""
    text = nfkc_compact(F.coalesce("text", F.lit("")))
    has = lambda s: F.bool_or(F.contains(F.col("_t"), F.lit(s)))
    titles = F.sum(F.size(F.split("_t", r"表題部\(土地の表示\)")) - 1)
    g = pages.withColumn("_t", text).groupBy("file_hash").agg(
        F.bool_and(F.col("mode") == "text").alias("full_text"), has(UNIT_HEAD).alias("_unit"), has(HOUSE_HEAD).alias("_house"), has(LAND_HEAD).alias("_land"),
        has(RIGHT_HEAD).alias("has_right_section"), has("閉鎖").alias("closed"), titles.alias("land_titles"))
    kind = F.when(F.col("_unit"), "unit").when(F.col("_house"), "house").when(F.col("_land"), "land")
    return g.select("file_hash", "full_text", kind.alias("kind"), "has_right_section", "closed", "land_titles")


def clean_notation(fields: DataFrame) -> DataFrame:
    """NFKC text, areas with a decimal point, shares as "d分のn"."""
    wide = nfkc(F.col("value"))
    staged = fields.withColumn("_nfkc", wide)
    dense = F.regexp_replace(F.regexp_replace("_nfkc", r"(?U)\s", ""), r"(?<=\d):(?=\d)", ".")
    is_area, is_share = F.contains("path", F.lit("area")), F.contains("path", F.lit("share"))
    staged = staged.withColumn("_share", F.when(is_share, parse_share(F.col("_nfkc"))))
    value = (F.when(is_area & dense.rlike(r"^\d+(?:\.\d+)?$"), dense)
             .when(F.col("_share").isNotNull(), share_text(F.col("_share.n"), F.col("_share.d"))).otherwise(F.col("_nfkc")))
    return staged.withColumn("value", value).drop("_nfkc", "_share")


def table_values(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Field rows read from the tables of full-text documents, with the correction category each would be."""
    usable = pages.join(facts.filter("full_text and kind is not null").select("file_hash"), "file_hash", "left_semi")
    recs = cut_lineage(records(segment_records(lines_of(usable))))
    typed = recs.join(facts.select("file_hash", "kind", "closed", "land_titles"), "file_hash")
    units = typed.filter("kind = 'unit'")
    lands = typed.filter("kind = 'land' and not closed and land_titles = 1")
    labels = registry.label_fields(labelled_values(carry_labels(typed.filter("kind in ('unit', 'land')"))))
    labels = cut_lineage(labels)
    land_rows = cut_lineage(labels.filter(F.col("path").startswith("lands.")).unionByName(registry.land_title_fields(lands)))
    # A land title replaces the reading only when all four columns are settled.
    settled = land_rows.groupBy("file_hash").agg(F.count_distinct("path").alias("_n")).filter("_n = 4")
    unit_rows = labels.filter(~F.col("path").startswith("lands.")).unionByName(registry.title_fields(units))
    absent = facts.filter("full_text and kind = 'unit' and not has_right_section").select(
        "file_hash", F.lit("land_right.exists").alias("path"), F.lit("false").alias("value"),
        F.array(F.struct(F.lit(1).alias("page"), F.lit(UNIT_HEAD).alias("text"))).alias("sources"))
    tag = lambda df, category: df.withColumn("category", F.lit(category))
    return (tag(unit_rows, C_TABLE).withColumn("category", F.when(F.contains("path", F.lit("area")), C_AREA).otherwise(F.col("category")))
            .unionByName(tag(land_rows.join(settled.select("file_hash"), "file_hash", "left_semi"), C_LAND)).unionByName(tag(absent, C_RIGHT)))


def split_lot_from_place(fields: DataFrame) -> DataFrame:
    """A place that ends with its own lot number loses it (building, and each parcel)."""
    pair = r"^(building|lands\.\d+)\.(location|lot_number)$"
    owner = fields.filter(F.col("path").rlike(pair)).withColumn("_of", F.regexp_extract("path", pair, 1))
    lots = owner.filter(F.col("path").endswith("lot_number")).select("file_hash", "_of", nfkc_compact(F.col("value")).alias("_lot"))
    joined = fields.withColumn("_of", F.regexp_extract("path", pair, 1)).join(lots, ["file_hash", "_of"], "left").withColumn("_place", nfkc_compact(F.col("value")))
    ends = F.col("path").endswith(".location") & (F.coalesce("_lot", F.lit("")) != "") & F.coalesce(F.endswith("_place", "_lot"), F.lit(False))
    return joined.withColumn("value", F.when(ends, F.expr("left(_place, length(_place) - length(_lot))")).otherwise(F.col("value"))).drop("_of", "_lot", "_place")


def property_types(fields: DataFrame, facts: DataFrame) -> DataFrame:
    """Property type from what is settled: unit number with its right, house, or land alone."""
    pick = lambda p: F.max(F.when(F.col("path") == p, F.col("value")))
    g = fields.groupBy("file_hash").agg(pick("unit.house_number").alias("_no"), pick("land_right.exists").alias("_r"), pick("land_right.type").alias("_t"))
    kind = (F.when(F.col("kind") == "house", "detached_house").when(F.coalesce("_no", F.lit("")) != "", F.when(F.col("_t").isin("地上権", "賃借権"), "leasehold_condominium")
            .when(F.col("_r") == "true", "condominium_land_right").when(F.col("_r") == "false", "condominium_no_land_right").otherwise("unknown"))
            .when(F.col("kind") == "land", "land_only"))
    return facts.join(g, "file_hash", "left").select("file_hash", kind.alias("value")).filter("value is not null")


def normalize_document(fields: DataFrame, pages: DataFrame, reviewed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """JOB-12: (fields, corrections).

    Values of documents that are not full text are under review unless ``reviewed`` (file_hash) lists them.
    A detached house keeps neither unit nor parcel values. Corrections: file_hash, path, category, before, after.
    """
    facts = cut_lineage(document_facts(pages))
    before = fields.select("file_hash", "path", F.col("value").alias("before"))
    clean = clean_notation(fields)
    table = table_values(pages, facts).select("file_hash", "path", F.col("value").alias("_v"), F.col("sources").alias("_s"), "category")
    kind = facts.select("file_hash", F.when(F.col("kind").isin("unit", "house"), "building").otherwise(F.col("kind")).alias("_v"),
                        F.lit("document_type").alias("path"), F.lit(C_TYPE).alias("category"),
                        F.array(F.struct(F.lit(1).alias("page"), F.col("kind").alias("text"))).alias("_s")).filter("_v is not null")
    table = table.unionByName(kind.select(*table.columns))
    merged = clean.join(table, ["file_hash", "path"], "full_outer")
    merged = (merged.withColumn("value", F.coalesce("_v", "value"))
              .withColumn("sources", F.when(F.col("_v").isNotNull(), F.transform("_s", lambda s: F.struct(
                  s["page"].alias("page"), s["text"].alias("text"), F.lit(None).cast("string").alias("source_pdf"), F.col("file_hash").alias("file_hash")))).otherwise(F.col("sources")))
              .withColumn("needs_review", F.when(F.col("_v").isNotNull(), False).otherwise(F.coalesce("needs_review", F.lit(False)))))
    merged = split_lot_from_place(merged.select("file_hash", "path", "value", "sources", "needs_review", "category"))
    joined = merged.join(facts.select("file_hash", "full_text", "kind"), "file_hash", "left")
    dropped = (F.col("kind") == "house") & F.col("path").rlike(r"^(?:unit|building|lands)\.")
    joined = joined.withColumn("value", F.when(dropped, F.lit(None).cast("string")).otherwise(F.col("value"))).withColumn(
        "category", F.when(dropped & F.col("path").startswith("lands."), C_HOUSE).otherwise(F.col("category")))
    if reviewed is not None:
        joined = joined.join(reviewed.select("file_hash", F.lit(True).alias("_ok")), "file_hash", "left")
    else:
        joined = joined.withColumn("_ok", F.lit(False))
    weak = ~F.coalesce("full_text", F.lit(False)) & ~F.coalesce("_ok", F.lit(False))
    joined = joined.withColumn("needs_review", F.when(weak, F.col("value").isNotNull()).otherwise(F.col("needs_review")))
    types = property_types(joined, facts).select("file_hash", F.lit("property_type").alias("path"), F.col("value").alias("_type"))
    final = (joined.join(types, ["file_hash", "path"], "full_outer").withColumn("value", F.coalesce("_type", "value"))
             .withColumn("needs_review", F.when(F.col("_type").isNotNull(), F.col("_type") == "unknown").otherwise(F.coalesce("needs_review", F.lit(False))))
             .withColumn("category", F.when(F.col("_type").isNotNull(), C_TYPE).otherwise(F.col("category"))))
    corrections = (final.join(before, ["file_hash", "path"], "left").filter(~F.col("value").eqNullSafe(F.col("before")))
                   .withColumn("category", F.coalesce("category", F.when(F.contains("path", F.lit("area")), C_AREA)
                               .when(F.col("path").endswith(".location"), C_LOT).otherwise(C_NOTATION)))
                   .select("file_hash", "path", "category", "before", F.col("value").alias("after")))
    return final.select("file_hash", "path", "value", "sources", "needs_review"), corrections


def redact_reviewed(fields: DataFrame) -> DataFrame:
    """PRJ-5: what is under review has no value and no sources on the way out."""
    empty = F.array().cast(fields.schema["sources"].dataType)
    return (fields.withColumn("value", F.when(F.col("needs_review"), F.lit(None).cast("string")).otherwise(F.col("value")))
            .withColumn("sources", F.when(F.col("needs_review"), empty).otherwise(F.col("sources"))))


def route_by_type(fields: DataFrame, types: DataFrame) -> DataFrame:
    """PRJ-6: a house or bare land keeps only owner and parcels; an unknown type keeps nothing.

    ``types``: group_id, property_type, several_buildings.
    """
    joined = fields.join(types, "group_id")
    part = F.col("path").rlike(r"^(?:building|unit|land_right)\.") & F.col("property_type").isin("detached_house", "land_only")
    everything = (F.col("property_type") == "unknown") | F.col("several_buildings")
    return joined.withColumn("value", F.when(part | everything, F.lit(None).cast("string")).otherwise(F.col("value"))).drop("property_type", "several_buildings")
