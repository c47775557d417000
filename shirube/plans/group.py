"""JOB-13, JOB-14, JOB-14b: documents of one deal to one integrated record and its registration rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import BUILDING_CODES, CONDOMINIUM_KINDS, NEVER_MASTER, PATH_CODES
from ..functions.dates import era_to_date
from ..functions.evidence import first_evidence, json_string
from ..functions.shares import parse_share
from ..functions.text import canonical_address, nfkc_compact
from ..operators.aggregates import values_per_document
from ..operators.lands import common_share, outside_site, seller_shares
from ..operators.ordered import newest
from ..operators.views import provenance_guard
from ..session import cut_lineage

# ---- fixed values: reasons that stop a registration ---------------------------------------------------
BLOCK_LAND = "土地の謄本だけでは登録できません。建物（専有部分）の謄本も一緒に入れてください。"
BLOCK_HOUSE = "戸建ては区分マンション用のひな形の対象外です。"
BLOCK_KIND = "物件の種類（区分マンションかどうか）を謄本から判定できませんでした。建物の謄本を確認してください。"
BLOCK_HEAD = "登録できません。"
G_BUILDINGS, G_KIND, G_CONFLICT = "複数建物の対象選択", "物件種別の確定", "資料間不一致:"
LEASE_NOTE = "借地の期間満了日・更新・契約詳細（契約書等の確認が必要）"
# -------------------------------------------------------------------------------------------------------

PARCEL_FIELDS = ("location", "lot_number", "category", "area")


def base_documents(documents: DataFrame) -> DataFrame:
    """The one building document, else the first land document, else the first. ``documents``: group_id, file_hash, ord, document_type."""
    n = documents.groupBy("group_id").agg(F.count_if(F.col("document_type") == "building").alias("buildings"), F.count_if(F.col("document_type") == "land").alias("lands"))
    wanted = F.when(F.col("buildings") == 1, F.col("document_type") == "building").when((F.col("buildings") == 0) & (F.col("lands") > 0), F.col("document_type") == "land").otherwise(F.lit(True))
    pool = documents.join(n, "group_id").filter(wanted)
    return newest(pool, ["group_id"], [F.asc("ord"), F.asc("file_hash")]).select("group_id", F.col("file_hash").alias("base_hash"), "buildings", "lands")


def _parcels(fields: DataFrame) -> DataFrame:
    """Parcel rows from ``lands.<i>.<part>`` paths; the parts are a fixed list, so this is one grouped pass."""
    pattern = r"^lands\.(\d+)\.(location|lot_number|category|area|right_type|right_share)$"
    rows = fields.filter(F.col("path").rlike(pattern)).withColumn("parcel_no", F.regexp_extract("path", pattern, 1).cast("int")).withColumn("_part", F.regexp_extract("path", pattern, 2))
    part = lambda p: F.max(F.when(F.col("_part") == p, F.col("value"))).alias(p)
    return rows.groupBy("group_id", "file_hash", "parcel_no").agg(*[part(p) for p in (*PARCEL_FIELDS, "right_type", "right_share")],
                                                                 F.bool_or(F.coalesce("needs_review", F.lit(False))).alias("needs_review"))


def integrate_group(documents: DataFrame, fields: DataFrame) -> dict[str, DataFrame]:
    """JOB-13: base record, parcels with shares, property type, blocking reviews and warnings of each group.

    ``fields``: group_id, file_hash, path, value, sources, needs_review.
    """
    base = base_documents(documents)
    docs = documents.join(base, "group_id")
    main = fields.join(base.select("group_id", F.col("base_hash").alias("file_hash")), ["group_id", "file_hash"])
    value = lambda p: F.max(F.when(F.col("path") == p, F.col("value")))
    facts = main.groupBy("group_id").agg(
        value("building.location").alias("_loc"), value("building.lot_number").alias("_lot"), value("main_building.location").alias("_house_loc"),
        value("unit.house_number").alias("_unit"), value("main_building.house_number").alias("_house"), value("land_right.exists").alias("_right"),
        value("land_right.type").alias("_right_type"), value("owner.name").alias("_owner"))
    facts = cut_lineage(base.join(facts, "group_id", "left"))
    parcels = _parcels(fields).join(docs.select("group_id", "file_hash", "document_type", "ord", "buildings"), ["group_id", "file_hash"])
    # Checkpoints keep the folded parcels and the settled land rows from being worked out once per output.
    keyed = cut_lineage(parcels.withColumn("_k1", canonical_address(F.col("location"))).withColumn("_k2", canonical_address(F.col("lot_number"))))
    from_building = keyed.filter("document_type = 'building'")
    from_land = keyed.filter("document_type = 'land'")
    # One row per parcel and side; the first land document of a parcel fills, later ones only confirm.
    rank = F.struct("ord", "parcel_no")
    side = lambda df, tag: df.groupBy("group_id", "_k1", "_k2").agg(
        *[F.min_by(F.col(p), F.when(F.col(p).isNotNull(), rank)).alias(f"{tag}_{p}") for p in (*PARCEL_FIELDS, "right_type", "right_share")],
        *[F.count_distinct(F.when(F.col(p).isNotNull(), F.regexp_replace(F.col(p), r"(?U)\s", ""))).alias(f"{tag}n_{p}") for p in PARCEL_FIELDS],
        F.min(rank).alias(f"{tag}_at"), F.lit(True).alias(f"_{tag}"))
    both = side(from_building, "b").join(side(from_land, "l"), ["group_id", "_k1", "_k2"], "full_outer").join(facts.select("group_id", "buildings", "_right"), "group_id")
    same = lambda p: canonical_address(F.col(f"b_{p}")) == canonical_address(F.col(f"l_{p}"))
    clash = F.array_compact(F.array(*[F.when((F.col(f"b_{p}").isNotNull() & F.col(f"l_{p}").isNotNull() & ~same(p)) | (F.coalesce(f"ln_{p}", F.lit(0)) > 1), F.lit(p)) for p in PARCEL_FIELDS]))
    merged = both.select(
        "group_id", F.concat_ws("\u0002", "_k1", "_k2").alias("parcel_id"), "_k2", F.coalesce("b_at", "l_at").alias("_at"), (F.col("_b").isNull() & (F.col("buildings") > 0)).alias("_only_land"),
        *[F.coalesce(f"b_{p}", f"l_{p}").alias(p) for p in (*PARCEL_FIELDS, "right_type", "right_share")], clash.alias("mismatches"), (F.col("_right") == "true").alias("land_right_exists"))
    sites = facts.select("group_id", F.concat(F.coalesce("_loc", F.lit("")), F.coalesce("_lot", F.lit(""))).alias("location_text"))
    marked = outside_site(merged, sites, ["group_id"])
    house = facts.select("group_id", canonical_address(F.col("_house_loc")).alias("_house_key"))
    marked = cut_lineage(marked.join(house, "group_id").withColumn("outside", F.col("outside") & F.col("_only_land") & (F.replace("parcel_id", F.lit("\u0002"), F.lit("")) != F.col("_house_key"))))

    pattern = r"^owners\.(\d+)\.(name|share)$"
    owner_rows = fields.filter(F.col("path").rlike(pattern)).withColumn("_no", F.regexp_extract("path", pattern, 1)).withColumn("_part", F.regexp_extract("path", pattern, 2))
    owners = owner_rows.groupBy("group_id", "file_hash", "_no").agg(
        F.max(F.when(F.col("_part") == "name", F.col("value"))).alias("_name"), F.max(F.when(F.col("_part") == "share", F.col("value"))).alias("share_text"),
        F.bool_or(F.col("_part").eqNullSafe(F.lit("share")) & F.coalesce("needs_review", F.lit(False))).alias("needs_review"))
    land_ids = from_land.select("group_id", "file_hash", F.concat_ws("\u0002", "_k1", "_k2").alias("parcel_id")).distinct()
    owners = owners.join(land_ids, ["group_id", "file_hash"]).withColumn("_s", parse_share(F.col("share_text"))).select(
        "group_id", "parcel_id", nfkc_compact(F.coalesce("_name", F.lit(""))).alias("name"), F.col("_s.n").alias("n"), F.col("_s.d").alias("d"),
        F.col("_s.d").alias("printed_d"), "share_text", "needs_review")
    sellers = facts.select("group_id", F.explode(F.split(F.coalesce("_owner", F.lit("")), r"\R")).alias("_n")).select("group_id", nfkc_compact(F.col("_n")).alias("name")).filter("name <> ''")
    shares = seller_shares(marked.select("group_id", "parcel_id", "outside", "land_right_exists"), owners, sellers, ["group_id"])
    shares = shares.select("group_id", "parcel_id", F.col("right_type").alias("_rt"), F.col("right_share").alias("_rs"), "warnings")
    land = (marked.join(shares, ["group_id", "parcel_id"], "left").withColumn("right_share", F.when(F.col("_rt").isNotNull(), F.col("_rs")).otherwise(F.col("right_share")))
            .withColumn("right_type", F.coalesce("_rt", "right_type")))
    land = cut_lineage(land.withColumn("_pair", parse_share(F.col("right_share"))))
    parcels_out = land.select("group_id", "parcel_id", "_at", *PARCEL_FIELDS, "right_type", "right_share", F.col("_pair.n").alias("share_numerator"), F.col("_pair.d").alias("share_denominator"),
                              "outside", (F.size("mismatches") > 0).alias("needs_review"), "mismatches", "warnings")

    lease = fields.filter("(path = 'tenure_type' and value = 'leasehold') or (path = 'leasehold.exists' and value = 'true')").select("group_id").distinct().withColumn("_lease", F.lit(True))
    typed = facts.join(lease, "group_id", "left")
    is_lease = F.coalesce("_lease", F.lit(False)) | F.coalesce(F.col("_right_type").isin("地上権", "賃借権"), F.lit(False))
    kind = (F.when(F.coalesce("_unit", F.lit("")) != "", F.when(is_lease, "leasehold_condominium").when(F.col("_right") == "true", "condominium_land_right")
            .when(F.col("_right") == "false", "condominium_no_land_right").otherwise("unknown"))
            .when(F.coalesce("_house", F.lit("")) != "", "detached_house").when((F.col("lands") > 0) & (F.col("buildings") == 0), "land_only").otherwise("unknown"))
    types = typed.select("group_id", kind.alias("property_type"), (F.col("buildings") > 1).alias("several_buildings"), F.coalesce("_lease", F.lit(False)).alias("has_lease_document"))
    review = (types.filter("several_buildings").select("group_id", F.lit(G_BUILDINGS).alias("item"))
              .unionByName(types.filter("property_type = 'unknown'").select("group_id", F.lit(G_KIND).alias("item")))
              .unionByName(land.select("group_id", "_k2", F.explode("mismatches").alias("_m")).select("group_id", F.concat(F.lit(G_CONFLICT + "土地"), F.col("_k2"), F.lit("."), F.col("_m")).alias("item"))))
    warnings = (land.select("group_id", F.explode(F.coalesce("warnings", F.array().cast("array<string>"))).alias("_w"), F.concat(F.coalesce("location", F.lit("")), F.coalesce("lot_number", F.lit(""))).alias("_l"))
                .select("group_id", F.concat("_w", F.lit(": "), "_l").alias("warning"))
                .unionByName(types.filter("has_lease_document").select("group_id", F.lit(LEASE_NOTE).alias("warning"))))
    liens = fields.filter(F.col("path").startswith("mortgages.")).join(docs.filter("document_type = 'land'").select("group_id", "file_hash"), ["group_id", "file_hash"], "left_semi")
    return {"base": base, "fields": main, "parcels": parcels_out, "types": types, "group_review": review.distinct(), "warnings": warnings, "land_liens": liens}


def blocked_reason(types: DataFrame, group_review: DataFrame) -> DataFrame:
    """FLT-4: why a group cannot be registered, or null. Review items of a group are listed once, sorted."""
    item = F.col("item")
    text = (F.when(item.startswith(G_CONFLICT), F.concat(F.lit("同じ土地の謄本どうしで内容が違います（"), F.regexp_extract(item, ":(.*)$", 1), F.lit("）。")))
            .when(item == G_BUILDINGS, "建物の謄本が複数入っています。1物件分だけにしてください。").otherwise(item))
    listed = group_review.select("group_id", text.alias("t")).distinct().groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("t")), " ").alias("_items"))
    kind = F.col("property_type")
    reason = (F.when(kind == "land_only", BLOCK_LAND).when(kind == "detached_house", BLOCK_HOUSE).when(~F.coalesce(kind.isin(*CONDOMINIUM_KINDS), F.lit(False)), BLOCK_KIND)
              .when(F.col("_items").isNotNull(), F.concat(F.lit(BLOCK_HEAD), F.col("_items"))))
    return types.join(listed, "group_id", "left").select("group_id", "property_type", reason.alias("reason"))


def _code_of(path: Column) -> Column:
    code = F.lit(None).cast("string")
    for p, c in PATH_CODES.items():
        code = F.when(path == p, c).otherwise(code)
    return code


def to_field_codes(fields: DataFrame) -> DataFrame:
    """PRJ-2..4: plain paths to field codes with their column side, dates as ISO and default confidence."""
    coded = fields.withColumn("field_code", _code_of(F.col("path"))).filter("field_code is not null")
    is_date = F.col("field_code") == "built_date"
    coded = coded.withColumn("_iso", F.when(is_date, era_to_date(F.col("value")).cast("string")))
    review = F.coalesce("needs_review", F.lit(False)) | (is_date & F.col("value").isNotNull() & F.col("_iso").isNull())
    if "confidence" in fields.columns:
        review = review | F.coalesce(F.col("confidence") < 0.85, F.lit(False))
        given = F.col("confidence")
    else:
        given = F.lit(None).cast("double")
    out = (coded.withColumn("needs_review", review).withColumn("_value", F.when(is_date, F.col("_iso")).otherwise(F.col("value")))
           .withColumn("confidence", F.coalesce(given, F.when((F.coalesce(F.size("sources"), F.lit(0)) > 0) & ~F.col("needs_review"), 1.0))))
    side = F.when(F.col("field_code").isin(*BUILDING_CODES), "building").otherwise("unit")
    return out.select("group_id", "field_code", json_string(F.col("_value")).alias("value_json"), "sources", "needs_review", "confidence", side.alias("side"))


def special_values(fields: DataFrame, parcels: DataFrame) -> DataFrame:
    """PRJ-3: parcel list, liens still in force, floor areas and the common share, as JSON values."""
    src_type = fields.schema["sources"].dataType
    lots = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_at", "location", "lot_number", F.col("category").alias("land_category"), "area"))),
                                 lambda p: F.struct(p["location"].alias("location"), p["lot_number"].alias("lot_number"), p["land_category"].alias("land_category"), p["area"].alias("area"))))
    land = parcels.groupBy("group_id").agg(lots.alias("value_json"), F.bool_or("needs_review").alias("needs_review"))
    listed = lambda pattern, prefix: fields.filter(F.col("path").rlike(pattern)).withColumn("_no", F.regexp_extract("path", pattern, 1).cast("int")).withColumn("_part", F.regexp_extract("path", pattern, 2))
    lien_parts = ("active", "amount", "creditor", "debtor", "kind", "rank")
    rows = listed(r"^mortgages\.(\d+)\.(rank|kind|amount|debtor|creditor|active)$", "mortgages").groupBy("group_id", "_no").agg(
        *[F.max(F.when(F.col("_part") == p, F.col("value"))).alias(p) for p in lien_parts], F.bool_or(F.coalesce("needs_review", F.lit(False))).alias("_r"))
    live = F.filter(F.array_sort(F.collect_list(F.struct("_no", *lien_parts))), lambda m: m["active"] == "true")
    liens = rows.groupBy("group_id").agg(F.to_json(F.transform(live, lambda m: F.struct(*[m[p].alias(p) for p in lien_parts]))).alias("value_json"),
                                         (F.bool_or(F.col("active").isNull()) | F.bool_or("_r")).alias("needs_review"))
    floor_rows = listed(r"^building\.floor_areas\.(\d+)\.(floor|area)$", "floors").groupBy("group_id", "_no").agg(
        F.max(F.when(F.col("_part") == "floor", F.col("value"))).alias("floor"), F.max(F.when(F.col("_part") == "area", F.col("value"))).alias("area"), F.bool_or(F.coalesce("needs_review", F.lit(False))).alias("_r"))
    floors = floor_rows.groupBy("group_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_no", "floor", "area"))), lambda x: F.struct(x["area"].alias("area"), x["floor"].alias("floor")))).alias("value_json"),
                                                F.bool_or("_r").alias("needs_review"))
    share = common_share(parcels.select("group_id", F.col("share_numerator").alias("n"), F.col("share_denominator").alias("d"), "needs_review"), ["group_id"]).filter("n is not null")
    pairs = share.select("group_id", F.explode(F.array(F.struct(F.lit("land_right_numerator").alias("field_code"), F.col("n").cast("string").alias("value_json")),
                                                       F.struct(F.lit("land_right_denominator").alias("field_code"), F.col("d").cast("string").alias("value_json")))).alias("_p")).select("group_id", "_p.*", F.lit(False).alias("needs_review"))
    tag = lambda df, code: df.select("group_id", F.lit(code).alias("field_code"), "value_json", "needs_review")
    special = tag(land, "land_lots").unionByName(tag(liens, "active_mortgages")).unionByName(tag(floors, "floor_areas")).unionByName(pairs)
    prefix = F.when(F.col("path").startswith("lands."), "land_lots").when(F.col("path").startswith("mortgages."), "active_mortgages").when(F.col("path").startswith("building.floor_areas."), "floor_areas")
    shares_src = F.when(F.col("path").isin("land_right.share"), F.array(F.lit("land_right_numerator"), F.lit("land_right_denominator"))).otherwise(F.array_compact(F.array(prefix)))
    cited = fields.select("group_id", "path", "file_hash", "sources", F.explode(shares_src).alias("field_code"))
    sources = cited.groupBy("group_id", "field_code").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", "file_hash", "sources"))), lambda x: x["sources"])).alias("sources"))
    joined = special.join(sources, ["group_id", "field_code"], "left").withColumn("sources", F.coalesce("sources", F.array().cast(src_type)))
    side = F.when(F.col("field_code").isin(*BUILDING_CODES), "building").otherwise("unit")
    return joined.select("group_id", "field_code", "value_json", "sources", "needs_review", F.when((F.size("sources") > 0) & ~F.col("needs_review"), 1.0).alias("confidence"), side.alias("side"))


def registration_rows(integrated: dict[str, DataFrame], all_fields: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """JOB-14: values with provenance, sure master values, per-document evidence and blocked groups.

    ``all_fields`` are the fields of every document of the group (evidence is cited across them);
    ``files``: group_id, file_hash, ord. A group that cites a file outside its set is refused.
    """
    blocked = blocked_reason(integrated["types"], integrated["group_review"])
    values = cut_lineage(to_field_codes(integrated["fields"]).unionByName(special_values(all_fields, integrated["parcels"])))
    foreign = provenance_guard(values, files, "group_id").withColumn("reason", F.lit("根拠資料とPDFの対応を確認してください。"))
    stop = blocked.filter("reason is not null").select("group_id", "reason").unionByName(foreign.select("group_id", "reason"))
    open_values = values.join(stop.select("group_id").distinct(), "group_id", "left_anti")
    shown = open_values.withColumn("_e", first_evidence(F.col("sources"))).select("*", F.col("_e.page_no").alias("page_no"), F.col("_e.source_text").alias("source_text")).drop("_e")
    master = open_values.filter(~F.col("needs_review") & F.col("value_json").isNotNull()).select("group_id", "side", "field_code", "value_json")
    return {"values": shown, "master": master, "document_values": values_per_document(open_values, files, "group_id"), "blocked": stop}


def disclosure_rows(documents: DataFrame, values: DataFrame) -> dict[str, DataFrame]:
    """JOB-14b: a disclosure's fields kept as historical evidence; owner and liens never reach masters.

    ``documents``: file_hash, property_type, page_count, text_pages, verified; ``values``: file_hash, field_code, value_json, needs_review, ...
    """
    reason = (F.when(~F.coalesce(F.col("property_type").isin(*CONDOMINIUM_KINDS), F.lit(False)), "戸建て・物件種別不明の資料は登録できません。")
              .when((F.col("page_count") > F.col("text_pages")) & ~F.coalesce("verified", F.lit(False)), "スキャン原本で物件種別・登録項目を確認してください。"))
    tagged = documents.withColumn("reason", reason)
    kept = values.join(tagged.filter("reason is null").select("file_hash"), "file_hash", "left_semi").withColumn("historical", F.lit(True))
    sure = kept.filter(~F.coalesce("needs_review", F.lit(True)) & F.col("value_json").isNotNull() & (F.col("value_json") != "null") & ~F.col("field_code").isin(*NEVER_MASTER))
    side = F.when(F.col("field_code").isin(*BUILDING_CODES), "building").otherwise("unit")
    return {"values": kept, "master": sure.select("file_hash", side.alias("side"), "field_code", "value_json"), "rejects": tagged.filter("reason is not null").select("file_hash", "reason")}
