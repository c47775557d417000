"""Field catalog and other small fixed dimensions (SRC-6)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CATALOG_SCHEMA = ("field_code string, label string, entity_level string, data_type string, primary_source string, "
                  "diff_enabled boolean, is_active boolean, named_range string")

# ---- fixed values: codes, labels and types that stored values refer to -------------------------
# (code, label, entity level, data type, primary source)
REPORT_FIELDS = [
    ("building_name", "建物名", "building", "text", "important_report"),
    ("display_address", "住居表示", "building", "text", "important_report"),
    ("total_units", "総戸数", "building", "number", "important_report"),
    ("completion_month", "竣工年月", "building", "text", "important_report"),
    ("management_company", "管理会社", "building", "text", "important_report"),
    ("management_type", "管理形態", "building", "text", "important_report"),
    ("management_plan_status", "管理計画認定", "building", "json", "important_report"),
    ("management_association", "管理組合", "building", "json", "important_report"),
    ("governance_info", "管理組合の運営", "building", "json", "important_report"),
    ("management_rules_effective_date", "管理規約の施行・改定日", "building", "date", "important_report"),
    ("insurance_info", "保険", "building", "json", "important_report"),
    ("common_exclusive_use_rules", "共用部分の専用使用", "building", "json", "important_report"),
    ("parking_facility_info", "駐車場", "building", "json", "management_rules"),
    ("bike_parking_info", "駐輪場", "building", "json", "important_report"),
    ("trunk_room_info", "トランクルーム", "building", "json", "important_report"),
    ("communications_info", "通信設備", "building", "json", "important_report"),
    ("management_account_financials", "管理費会計", "building", "json", "important_report"),
    ("repair_account_financials", "修繕積立金会計", "building", "json", "important_report"),
    ("association_arrears", "管理組合全体の滞納", "building", "json", "important_report"),
    ("association_loan_info", "管理組合の借入", "building", "json", "important_report"),
    ("fee_change_plans", "管理費等の変更予定", "building", "json", "important_report"),
    ("business_minpaku_restrictions", "事務所・営業・民泊制限", "building", "json", "management_rules"),
    ("pet_restrictions", "ペット制限", "building", "json", "management_rules"),
    ("instrument_restrictions", "楽器制限", "building", "json", "management_rules"),
    ("renovation_restrictions", "リフォーム制限", "building", "json", "management_rules"),
    ("long_term_repair_plan", "長期修繕計画", "building", "json", "important_report"),
    ("repair_history", "修繕履歴", "building", "json", "important_report"),
    ("major_repair_plan", "大規模修繕予定", "building", "json", "important_report"),
    ("building_document_status", "建築関係書類", "building", "json", "important_report"),
    ("unit_name", "対象住戸の部屋番号", "unit", "text", "important_report"),
    ("management_fee", "対象住戸の月額管理費（円）", "unit", "number", "important_report"),
    ("repair_reserve_fee", "対象住戸の月額修繕積立金（円）", "unit", "number", "important_report"),
    ("unit_arrears", "対象住戸の滞納", "unit", "json", "important_report"),
    ("other_monthly_fees", "対象住戸のその他月額費用", "unit", "json", "important_report"),
    ("fee_payment_info", "管理費等の支払方法", "unit", "json", "important_report"),
]
RULES_FIELDS = [
    ("unit_use_restrictions", "専有部分の用途制限"), ("office_use_allowed", "事務所利用"),
    ("pet_restrictions", "ペット制限"), ("instrument_restrictions", "楽器制限"),
    ("balcony_exclusive_use", "バルコニー専用使用"), ("private_garden_rules", "専用庭"),
    ("door_window_exclusive_use", "玄関扉・窓の専用使用"), ("parking_rules", "駐車場規則"),
    ("renovation_restrictions", "リフォーム制限"), ("leasing_restrictions", "賃貸制限"),
    ("management_association_name", "管理組合名"), ("voting_rights_rule", "議決権"),
    ("rules_effective_date", "規約施行日"), ("related_rules", "関連する使用細則"),
    ("common_exclusive_use_rules", "共用部分の専用使用"), ("bike_parking_info", "自転車・バイク置場情報"),
    ("management_type", "管理形態"), ("management_staff_hours", "管理員勤務"),
    ("prohibited_matters", "禁止事項"), ("approval_required_matters", "届出・承認が必要な事項"),
]
# The report fields also used by rules keep their report row; these three were added later.
LATE_RULES_FIELDS = ("management_staff_hours", "prohibited_matters", "approval_required_matters")
DISCLOSURE_FIELDS = [
    ("wall_center_area", "壁芯面積", "number", None), ("floor_plan", "間取り", "text", None),
    ("seller_name", "購入時の売主名", "text", None), ("seller_address", "購入時の売主住所", "text", None),
    ("sale_price", "購入時の売買代金", "number", "購入時_sale_price"),
    ("earnest_money", "購入時の手付金", "number", "購入時_earnest_money"),
    ("handover_date", "購入時の引渡日", "date", "購入時_handover_date_era"),
]
LEASEHOLD_FIELDS = [
    ("leasehold_area", "借地対象面積", "number"), ("leasehold_ground_rent_monthly", "地代（月額）", "number"),
    ("leasehold_ground_rent_unit", "地代（3.3㎡当たり月額）", "number"), ("leasehold_law_type", "借地権の法区分", "text"),
    ("leasehold_period_start", "借地期間開始", "date"), ("leasehold_period_end", "借地期間終了", "date"),
    ("leasehold_period_years", "借地期間", "number"), ("leasehold_assignment_consent", "譲渡承諾の要否", "boolean"),
]
NAMED_RANGES = {"building_name": "重調_building_name", "unit_name": "重調_unit_name"}
REGISTRY_LABELS = {
    "building_name": "建物名", "registry_location": "登記所在", "building_structure": "一棟の構造",
    "unit_name": "部屋番号", "house_number": "家屋番号", "unit_type": "専有部分の種類",
    "unit_structure": "専有部分の構造", "unit_floor": "所在階", "registered_area": "登記面積",
    "built_date": "新築年月日", "land_lots": "土地", "has_land_right": "敷地権の有無",
    "land_right_type": "敷地権種類", "land_right_numerator": "持分分子", "land_right_denominator": "持分分母",
    "current_owner_name": "資料当時の登記名義人", "current_owner_address": "資料当時の登記名義人住所",
    "active_mortgages": "資料当時の抵当権",
}
# Field code of each path in an integrated ledger document.
PATH_CODES = {
    "building.name": "building_name", "building.location": "registry_location",
    "building.structure": "building_structure", "building.floor_areas": "floor_areas",
    "unit.house_number": "house_number", "unit.name": "unit_name", "unit.type": "unit_type",
    "unit.structure": "unit_structure", "unit.floor": "unit_floor", "unit.registered_area": "registered_area",
    "unit.built_date": "built_date", "owner.name": "current_owner_name", "owner.address": "current_owner_address",
    "land_right.exists": "has_land_right", "land_right.type": "land_right_type", "lands": "land_lots",
    "mortgages": "active_mortgages", "leasehold.area": "leasehold_area",
    "leasehold.ground_rent_monthly": "leasehold_ground_rent_monthly",
    "leasehold.ground_rent_unit_per_3_3sqm": "leasehold_ground_rent_unit", "leasehold.law_type": "leasehold_law_type",
    "leasehold.period_start": "leasehold_period_start", "leasehold.period_end": "leasehold_period_end",
    "leasehold.period_years": "leasehold_period_years",
    "leasehold.assignment_consent_required": "leasehold_assignment_consent",
}
BUILDING_CODES = ("building_name", "registry_location", "building_structure", "floor_areas", "land_lots")
NEVER_MASTER = ("current_owner_name", "current_owner_address", "active_mortgages")
CONDOMINIUM_KINDS = ("condominium_land_right", "condominium_no_land_right", "leasehold_condominium")
PROPERTY_KINDS = CONDOMINIUM_KINDS + ("detached_house", "unknown")
DOCUMENT_KINDS = ("purchase", "registry", "report", "rules", "zoning")
WORKSPACE_TYPES = ("registry", "important_report", "management_rules", "purchase_important_explanation")
DISCLOSURE_NUMBERS = ("registered_area", "land_right_numerator", "land_right_denominator", "total_units", "management_fee",
                      "repair_reserve_fee", "wall_center_area", "sale_price", "earnest_money")
IMPORTANT_WHEN_MISSING = ("building_name", "unit_name", "house_number", "registry_location", "display_address",
                          "current_owner_name", "registered_area", "built_date", "sale_price", "handover_date",
                          "management_fee", "repair_reserve_fee")
CONFLICT_PAIRS = [
    ("pet_restrictions", "pet_restrictions"), ("instrument_restrictions", "instrument_restrictions"),
    ("renovation_restrictions", "renovation_restrictions"), ("parking_rules", "parking_facility_info"),
    ("office_use_allowed", "business_minpaku_restrictions"), ("leasing_restrictions", "leasing_restrictions"),
]
ZONING_LABELS = {
    "zoning_type": "用途地域", "building_coverage_ratio": "建ぺい率", "floor_area_ratio": "容積率",
    "fire_zone": "防火地域", "semi_fire_zone": "準防火地域", "height_district": "高度地区",
    "height_use_district": "高度利用地区", "shadow_restriction": "日影規制", "district_plan": "地区計画",
    "planned_road": "都市計画道路", "other_restrictions": "その他の都市計画制限", "reference_date": "資料の基準日",
    "municipality": "自治体名", "target_address": "対象所在地", "special_use_district": "特別用途地区",
    "minimum_lot_area": "敷地面積の最低限度", "minimum_height_district": "最低限高度地区",
}
ZONE_FIELDS = tuple(c for c in ZONING_LABELS if c not in ("reference_date", "municipality", "target_address"))
# ------------------------------------------------------------------------------------------------


def load_catalog(spark: SparkSession) -> DataFrame:
    """Five field sets merged; the first definition of a code wins."""
    rows, seen = [], set()

    def add(code, label, level, kind, source, diff=True, named=None):
        if code not in seen:
            seen.add(code)
            rows.append((code, label, level, kind, source, diff, True, named))

    for code, label, level, kind, source in REPORT_FIELDS:
        add(code, label, level, kind, source, named=NAMED_RANGES.get(code))
    for code, label in RULES_FIELDS:
        add(code, label, "building", "text", "管理規約" if code in LATE_RULES_FIELDS else "management_rules")
    for code, label, kind, named in DISCLOSURE_FIELDS:
        add(code, label, "unit", kind, "purchase_important_explanation", named=named)
    for code, label, kind in LEASEHOLD_FIELDS:
        add(code, label, "unit", kind, "謄本/借地資料")
    add("zoning_info", "用途地域・都市計画情報", "building", "json", "用途地域資料", diff=False)
    for code, label in REGISTRY_LABELS.items():
        add(code, label, "building" if code in BUILDING_CODES else "unit",
            "json" if code in ("land_lots", "active_mortgages") else "boolean" if code == "has_land_right"
            else "date" if code == "built_date" else "number" if code in DISCLOSURE_NUMBERS else "text", "registry")
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def merge_catalog(existing: DataFrame, added: DataFrame) -> DataFrame:
    """New codes join the catalog; a code that is already there keeps its row."""
    return existing.unionByName(added.join(existing, "field_code", "left_anti"))


def union_by_priority(keys: list[str], *frames: DataFrame) -> DataFrame:
    """SET-4: union where the first frame holding a key wins."""
    from .operators.ordered import newest
    stacked = None
    for i, frame in enumerate(frames):
        tagged = frame.withColumn("_priority", F.lit(i))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return newest(stacked, keys, [F.asc("_priority")]).drop("_priority")
