"""Current-state views, counters and gates (FLT-7, 9..12, JN-11, 15, 24..30, PRJ-8, 9, 11, SRT-1, JOB-17)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import CONDOMINIUM_KINDS, CONFLICT_PAIRS, DISCLOSURE_NUMBERS, IMPORTANT_WHEN_MISSING, NEVER_MASTER
from ..functions.evidence import TRUST_LEVEL, is_absent
from ..functions.text import nfkc_compact, search_fold, search_word
from .ordered import newest


def cases_or_units(cases: DataFrame, units: DataFrame) -> DataFrame:
    """JN-24: a unit without a case appears as a case of its own."""
    bare = (units.join(cases.select("unit_id"), "unit_id", "left_anti")
            .select(F.concat(F.lit("unit-"), F.col("unit_id").cast("string")).alias("case_id"), "unit_id", F.lit("案件未登録").alias("case_status")))
    return cases.select("case_id", "unit_id", "case_status").unionByName(bare)


def case_documents(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """JN-11: documents of the case's unit, and building rules that belong to no unit. Two equi-joins.

    ``cases``: case_id, unit_id, building_id; ``documents``: document_id, document_type, unit_id, building_id.
    """
    docs = documents.select("document_id", "document_type", F.col("unit_id").alias("_u"), F.col("building_id").alias("_b"))
    own = cases.join(docs, F.col("unit_id") == F.col("_u"))
    shared = docs.filter("document_type = 'management_rules' and _u is null")
    rules = cases.join(shared, F.col("building_id") == F.col("_b"))
    cols = ["case_id", "document_id", "document_type"]
    return own.select(*cols).unionByName(rules.select(*cols))


def unlinked_documents(documents: DataFrame) -> DataFrame:
    """JN-25: documents of no unit that are not building rules either."""
    building_rules = (F.col("document_type") == "management_rules") & F.col("building_id").isNotNull()
    return documents.filter(F.col("unit_id").isNull() & ~F.coalesce(building_rules, F.lit(False)))


def field_view(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """PRJ-8: label, review flag and whether an output cell exists. The catalog is a small fixed table."""
    c = catalog.select("field_code", "label", "named_range", "primary_source")
    weak = (F.coalesce("needs_review", F.lit(False)) | is_absent(F.col("value_json")) | (F.coalesce("source_text", F.lit("")) == "")
            | (F.coalesce("page_no", F.lit(0)) == 0) | F.col("confidence").isNull() | (F.col("confidence") < TRUST_LEVEL))
    joined = values.join(c, "field_code", "left")
    return (joined.withColumn("needs_review", weak).withColumn("label", F.coalesce("label", "field_code"))
            .withColumn("excel_supported", F.col("primary_source").isNull() | F.col("named_range").isNotNull() | (F.col("primary_source") == "registry"))
            .drop("named_range", "primary_source"))


def needs_attention(value_json: Column, needs_review: Column, is_error: Column, code: Column, has_cell: Column) -> Column:
    """FLT-12: fields to look at; a merely missing one only when it is important or has an output cell."""
    gone = is_absent(value_json) | (value_json == '""') | (value_json == "")
    matters = code.isin(*IMPORTANT_WHEN_MISSING) | has_cell | is_error
    return (gone | needs_review | is_error) & (~gone | matters)


def never_master(values: DataFrame) -> DataFrame:
    """FLT-10: a historical disclosure never feeds current owner and lien columns."""
    return values.filter(~F.col("field_code").isin(*NEVER_MASTER))


def needs_verification(docs: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-11: scanned, unverified documents and one form row per field that was read."""
    waiting = docs.filter((F.col("page_count") > F.col("text_pages")) & ~F.coalesce("verified", F.lit(False)))
    code = F.col("field_code")
    kind = (F.when(code.isin(*DISCLOSURE_NUMBERS), "number").when(code == "has_land_right", "boolean")
            .when(code.isin("land_lots", "active_mortgages"), "json").otherwise("text"))
    rows = values.filter(~is_absent(F.col("value_json"))).join(waiting.select("file_hash"), "file_hash", "left_semi").withColumn("input_kind", kind)
    return waiting, rows


def source_conflicts(values: DataFrame, case_id: str = "case_id", pairs=CONFLICT_PAIRS, fold=nfkc_compact,
                     left_type: str = "management_rules", right_type: str = "important_report") -> DataFrame:
    """JN-15: fields that rules and report describe differently; wording is compared folded, none is preferred.

    ``values``: case, document_type, field_code, value_json, doc_date, version_no.
    """
    latest = newest(values.filter(F.col("document_type").isin(left_type, right_type)), [case_id, "document_type", "field_code"],
                    [F.desc_nulls_last("doc_date"), F.desc("version_no")])
    code = F.col("field_code")
    right_of = F.lit(None).cast("string")
    for rule_code, report_code in pairs:
        right_of = F.when(code == rule_code, report_code).otherwise(right_of)
    left = (latest.filter(F.col("document_type") == left_type).withColumn("_other", right_of).filter("_other is not null")
            .select(case_id, "field_code", "_other", F.col("value_json").alias("rules_value")))
    right = latest.filter(F.col("document_type") == right_type).select(case_id, F.col("field_code").alias("_other"), F.col("value_json").alias("report_value"))
    both = left.join(right, [case_id, "_other"])
    return both.filter(~is_absent(F.col("rules_value")) & ~is_absent(F.col("report_value")) & (fold(F.col("rules_value")) != fold(F.col("report_value")))).drop("_other")


def case_cards(cases: DataFrame, units: DataFrame, buildings: DataFrame, diffs: DataFrame) -> DataFrame:
    """PRJ-11: one card per unit, with its newest case, defaults for missing names and open diff count."""
    top = newest(cases, ["unit_id"], [F.desc_nulls_last("updated_at"), F.asc("case_id")]).select("unit_id", "case_id", F.col("updated_at").alias("_case_at"))
    open_ = diffs.filter("review_status = 'unreviewed'").groupBy("unit_id").agg(F.count(F.lit(1)).alias("_open"))
    joined = units.join(top, "unit_id", "left").join(buildings, "building_id", "left").join(open_, "unit_id", "left")
    fields = [("建物名", "building_name"), ("号室", "unit_name"), ("登記所在", "registry_location"), ("家屋番号", "house_number"),
              ("所有者", "current_owner_name"), ("登記面積", "registered_area"), ("管理費", "management_fee"), ("修繕積立金", "repair_reserve_fee")]
    named = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    address = F.coalesce(F.nullif(F.col("display_address"), F.lit("")), F.nullif(F.col("registry_location"), F.lit("")), F.lit("所在地未取得"))
    return joined.select(
        F.coalesce(F.col("case_id").cast("string"), F.concat(F.lit("unit-"), F.col("unit_id").cast("string"))).alias("id"), "unit_id",
        named("building_name", "物件名未取得").alias("building_name"), named("unit_name", "号室未取得").alias("unit_name"), address.alias("address"),
        named("current_owner_name", "所有者未取得").alias("owner"), F.col("registered_area").alias("area"),
        F.coalesce("_case_at", "updated_at").alias("updated_at"), F.coalesce("_open", F.lit(0)).alias("unresolved"),
        F.array(*[F.struct(F.lit(l).alias("label"), F.col(c).cast("string").alias("value")) for l, c in fields]).alias("fields"))


def order_cards(cards: DataFrame) -> DataFrame:
    """SRT-1: newest first, a range-partitioned sort."""
    return cards.orderBy(F.desc_nulls_last("updated_at"), F.asc("id"))


def search_cases(cards: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """FLT-7: every word of the query occurs in the folded text of the columns."""
    words = [w for w in query.replace("　", " ").split() if w]
    text = search_fold(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    test = F.lit(True)
    for word in words:
        test = test & F.contains(text, F.lit(search_word(word)))
    return cards.filter(test)


def readiness(cases: DataFrame, open_diffs: DataFrame, unsaved: DataFrame) -> DataFrame:
    """FLT-9: may the contract be produced, and if not, why.

    ``cases``: case_id, property_type, registered, group_review; ``open_diffs`` and ``unsaved``: case_id rows.
    """
    d = open_diffs.groupBy("case_id").agg(F.count(F.lit(1)).alias("_d"))
    p = unsaved.groupBy("case_id").agg(F.count(F.lit(1)).alias("_p"))
    joined = cases.join(d, "case_id", "left").join(p, "case_id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("_d") > 0, F.concat(F.lit("open diffs: "), F.col("_d").cast("string"))),
        F.when(F.col("_p") > 0, "unsaved documents"),
        F.when(~F.coalesce("registered", F.lit(False)), "not registered"),
        F.when(~F.coalesce(F.col("property_type").isin(*CONDOMINIUM_KINDS), F.lit(False)), "property type not supported"),
        F.when(F.coalesce("group_review", F.lit(0)) > 0, "group review open")))
    return joined.withColumn("reasons", reasons).withColumn("ready", F.size("reasons") == 0).drop("_d", "_p")


def seed_zoning(values: DataFrame, zoning_documents: DataFrame, zone_fields: tuple[str, ...]) -> DataFrame:
    """JN-26: a disclosure's zoning values start a building's zoning only when it has none; all need review."""
    usable = values.filter(F.col("field_code").isin(*zone_fields) & ~is_absent(F.col("value_json")) & (F.col("value_json") != ""))
    return usable.join(zoning_documents.select("building_id"), "building_id", "left_anti").withColumn("needs_review", F.lit(True))


def entity_guard(docs: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-27: a rules document naming another building, or a report naming another house number, is refused.

    ``docs``: case_id, kind, building_name, house_number; ``cases``: case_id, case_building_name, case_house_number.
    """
    joined = docs.join(cases, "case_id")
    other_building = (F.col("kind") == "rules") & (F.coalesce("building_name", F.lit("")) != "") & (
        nfkc_compact(F.col("building_name")) != nfkc_compact(F.coalesce("case_building_name", F.lit(""))))
    other_house = (F.col("kind") == "report") & (F.coalesce("house_number", F.lit("")) != "") & (
        F.coalesce("case_house_number", F.lit("")) != "") & (F.col("house_number") != F.col("case_house_number"))
    wrong = F.coalesce(other_building | other_house, F.lit(False))
    reason = F.when(other_building, "building name differs").otherwise("house number differs")
    return joined.filter(~wrong).select(*docs.columns), joined.filter(wrong).withColumn("reason", reason).select(*docs.columns, "reason")


def provenance_guard(values: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """JN-28: groups whose evidence cites a file outside their document set."""
    cited = values.select(group, F.explode("sources").alias("_s")).select(group, F.col("_s.file_hash").alias("file_hash"))
    return cited.join(files.select(group, "file_hash"), [group, "file_hash"], "left_anti").select(group).distinct()


def overlay_master(fields: DataFrame, units: DataFrame, columns: dict[str, str]) -> DataFrame:
    """JN-30: adopted master values replace the first import's before output.

    ``fields``: unit_id, path, value, ...; ``columns``: path to unit column. A date that is only
    written differently stays as printed; the unit's share goes to every parcel.
    """
    from ..functions.dates import era_to_date, era_text
    from ..functions.shares import share_text
    wide = [F.col(c).cast("string").alias(c) for c in columns.values()]
    long = units.select("unit_id", *wide).unpivot(["unit_id"], list(columns.values()), "_column", "_master")
    path_of = F.lit(None).cast("string")
    for path, col in columns.items():
        path_of = F.when(F.col("_column") == col, path).otherwise(path_of)
    long = long.select("unit_id", path_of.alias("path"), "_master", F.lit(True).alias("_has"))
    joined = fields.join(long, ["unit_id", "path"], "full_outer")
    dated = F.col("path") == "unit.built_date"
    same_day = dated & F.coalesce(era_to_date(F.col("value")).cast("string") == F.col("_master"), F.lit(False))
    master = F.when(dated, era_text(F.try_to_date(F.col("_master"), "yyyy-MM-dd"))).otherwise(F.col("_master"))
    changed = F.coalesce(F.col("_has"), F.lit(False)) & ~same_day & ~master.eqNullSafe(F.col("value"))
    share = units.select("unit_id", share_text(F.col("land_right_numerator"), F.col("land_right_denominator")).alias("_share"))
    out = (joined.withColumn("needs_review", F.when(changed, master.isNull()).otherwise(F.col("needs_review")))
           .withColumn("value", F.when(changed, master).otherwise(F.col("value"))).drop("_master", "_has"))
    out = out.join(share, "unit_id", "left")
    is_share = F.col("path").rlike(r"^lands\.\d+\.right_share$|^land_right\.share$") & F.col("_share").isNotNull()
    return out.withColumn("value", F.when(is_share, F.col("_share")).otherwise(F.col("value"))).drop("_share")


def reusable(parsed: DataFrame, kind_flags: dict[str, str]) -> DataFrame:
    """FLT-8: a stored parse may be used again only if it is this content's own, typed and final.

    ``parsed``: kind, file_hash, source_hash, flags MAP<STRING,BOOLEAN>, status, model, is_service_layout.
    """
    typed = F.lit(True)
    for kind, flag in kind_flags.items():
        typed = F.when(F.col("kind") == kind, F.coalesce(F.try_element_at("flags", F.lit(flag)), F.lit(False))).otherwise(typed)
    final = F.coalesce(F.col("status") != "needs_ai", F.lit(True))
    outdated = F.coalesce((F.col("kind") == "registry") & F.col("is_service_layout") & ~F.col("model").eqNullSafe(F.lit("rule")), F.lit(False))
    return parsed.filter((F.col("file_hash") == F.col("source_hash")) & typed & final & ~outdated)
