"""Zoning, lease, rules and label extraction: golden values and refusals."""
from pyspark.sql import functions as F

from shirube.plans import extract, normalize

PAGES = "file_hash string, page_no int, mode string, text string"

LINE_FORM = """都市計画情報
用途地域　第１種住居地域
建ぺい率  60％
容積率  200％
地区計画  なし
発行元：見本区都市整備課
令和7年12月8日現在のものです"""
TABLE_FORM = """用途地域   近隣商業地域      日影規制   時間  なし
建ぺい率   80%      都市計画道路
容積率   300%
防火地域・準防火地域   準防火地域
高度地区 種別：第3種高度地区 最高限度：28ｍ
見本区都市計画部都市計画課
令和8年6月30日現在のものです"""


def zoning(spark, **texts):
    pages = spark.createDataFrame([(k, 1, "text", t) for k, t in texts.items()], PAGES)
    fields, status = extract.zoning_extract(pages)
    return {(r.file_hash, r.field_code): r.value for r in fields.collect()}, {r.file_hash: r.status for r in status.collect()}


def test_zoning_layouts(spark):
    got, status = zoning(
        spark, line=LINE_FORM, table=TABLE_FORM, two=LINE_FORM + "\n用途地域　商業地域", blank=" ",
        tail="用途地域　商業地域\n建ぺい率  80%\n容積率  500%\n海辺地区地区計画\n次の行の値",
        map="この図は証明ではありません\n用途地域 商業地域\n凡例 高度地区 28m第3種\n容積／建ぺい 6 0／ 3 00\n防火・準防火 準防火地域\n高度利用地区 －",
        result="都市計画情報　検索結果\n用途地域  第1種低層住居専用地域\n建ぺい率(％)  50\n容積率(％)  100\n防火指定  準防火地域\n高度地区  第２種高度地区\n令和6年4月1日時点のものです")
    assert got[("line", "zoning_type")] == "第１種住居地域" and got[("line", "building_coverage_ratio")] in ("60％", "60%")
    assert got[("line", "reference_date")] == "2025-12-08" and got[("line", "municipality")] == "見本区都市整備課"
    assert [got[("table", c)] for c in ("zoning_type", "building_coverage_ratio", "floor_area_ratio", "semi_fire_zone", "height_district", "reference_date")] == [
        "近隣商業地域", "80%", "300%", "準防火地域", "28m第3種", "2026-06-30"]
    assert ("table", "minimum_height_district") not in got
    assert ("two", "zoning_type") not in got  # ambiguous, so absent
    assert ("tail", "district_plan") not in got
    assert got[("map", "zoning_type")] == "商業地域" and got[("map", "building_coverage_ratio")] == "60%" and got[("map", "floor_area_ratio")] == "300%"
    assert got[("map", "height_use_district")] == "該当なし" and got[("map", "semi_fire_zone")] == "準防火地域"
    assert got[("result", "floor_area_ratio")] == "100%" and got[("result", "height_district")] == "第2種" and got[("result", "reference_date")] == "2024-04-01"
    assert status == {"line": "parsed", "table": "parsed", "two": "needs_review", "blank": "needs_ai", "tail": "parsed", "map": "parsed", "result": "parsed"}


def test_lease_terms(spark):
    lease = ["表題部 土地の表示 宅地 ８７３：９７ 権利部（甲区） 所有者", "権利部（乙区） 地上権設定 原因昭和47年1月31日設定 存続期間60年 地代３．３㎡当り１月４００円 鉄筋コンクリート"]
    pages = spark.createDataFrame([("a", 1, "text", lease[0]), ("a", 2, "text", lease[1]), ("b", 1, "text", "所有権移転")], PAGES)
    got = {r.file_hash: r.asDict() for r in extract.leasehold_terms(pages).collect()}
    a = got["a"]
    assert (a["right_type"], a["law_type"], str(a["area"]), str(a["period_end"]), a["ground_rent_unit_per_3_3sqm"]) == ("地上権", "旧法", "873.97", "2032-01-30", 400)
    assert a["ground_rent_monthly"] is None and a["assignment_consent_required"] is False and a["building_class"] == "堅固建物"
    assert got["b"]["status"] == "not_leasehold" and got["b"]["right_type"] is None


def test_rules_topics(spark):
    text = "管理規約\n第1条 ペットは小型犬に限る。\n第２条 ピアノは夜間禁止とする。\n第3条 猫の飼育は届出を要する。"
    pages = spark.createDataFrame([("a", 1, "text", text), ("b", 1, "text", "会社案内")], PAGES)
    fields, candidates, rejects = extract.rules_candidates(pages)
    got = {r.field_code: r for r in fields.filter("file_hash = 'a'").collect()}
    assert got["pet_restrictions"].value is None and got["pet_restrictions"].candidates == 2 and got["pet_restrictions"].confidence is None
    assert got["instrument_restrictions"].value.startswith("第２条") and got["instrument_restrictions"].source_article == "第２条"
    assert all(r.needs_review for r in got.values())
    assert candidates.filter("field_code = 'pet_restrictions'").count() == 2
    assert [r.file_hash for r in rejects.collect()] == ["b"]


def test_labels_fill_the_line_once(spark):
    text = "月額管理費：12,000円／月\n修繕積立金：約5,000円\n建物名：見本ハイツ\n建物名称：別名"
    got = {r.field_code: r.value for r in extract.label_candidates(spark.createDataFrame([("a", 1, "text", text)], PAGES)).collect()}
    assert got == {"management_fee": "12,000"}


ITEM = "file_hash string, field_code string, value string, source_text string, page_no int, confidence double, value_as_of_date string"


def test_report_values(spark):
    pages = spark.createDataFrame([("a", 1, "text", "管理費 １２，０００円"), ("a", 2, "scan", ""), ("a", 3, "text", "修繕積立金 8,000円"), ("a", 4, "text", "総戸数 40戸")], PAGES)
    items = spark.createDataFrame([
        ("a", "management_fee", "１２，０００円", "管理費 12,000円", 1, 0.95, "2026-01"), ("a", "repair_reserve_fee", "9000", "修繕積立金 8,000円", 1, 0.95, "2026-01-31"),
        ("a", "total_units", "40戸", "総戸数 40戸", 2, 0.9, "いつか"), ("a", "management_rules_effective_date", "2020年", "x", 99, 1.5, None)], ITEM)
    catalog = spark.createDataFrame([("management_fee", "number"), ("repair_reserve_fee", "number"), ("total_units", "number"), ("management_rules_effective_date", "date")], "field_code string, data_type string")
    got = {r.field_code: r for r in normalize.normalize_report(items, pages, catalog).collect()}
    fee = got["management_fee"]
    assert (fee.value, fee.value_as_of_date, fee.review_reasons) == ("12000", None, [])
    moved = got["repair_reserve_fee"]
    assert moved.page_no == 3 and moved.review_reasons == [normalize.R_NUMBER_MATCH] and str(moved.value_as_of_date) == "2026-01-31"
    assert set(got["total_units"].review_reasons) == {normalize.R_ASOF, normalize.R_SCAN}
    assert got["management_rules_effective_date"].value is None and got["management_rules_effective_date"].review_reasons == [normalize.R_DATE]


def test_disclosure_values(spark):
    pages = spark.createDataFrame([("a", 1, "text", "登記面積 40.49㎡ 家屋番号 7番1の203")], PAGES)
    items = spark.createDataFrame([
        ("a", "registered_area", "40.49㎡", "登記面積 40.49㎡", 1, 0.9, None), ("a", "house_number", "7番1の203", "家屋番号 7番1の203", 1, 0.9, None),
        ("a", "house_number", "7番1の204", "家屋番号 7番1の203", 1, 0.9, None), ("a", "floor_plan", "1K", "1K", 99, 0.9, None),
        ("a", "land_lots", '[{"location":"海区","numerator":"9","denominator":"5"}]', "登記面積 40.49㎡", 1, 0.9, None)], ITEM)
    docs = spark.createDataFrame([("a",)], "file_hash string")
    codes = ["registered_area", "house_number", "floor_plan", "land_lots", "seller_name"]
    got = {r.field_code: r for r in normalize.normalize_disclosure(items, pages, docs, codes).collect()}
    assert got["registered_area"].value == "40.49" and not got["registered_area"].needs_review
    assert got["house_number"].value is None and got["house_number"].review_reasons == [normalize.R_TWICE]
    assert got["floor_plan"].page_no is None and normalize.R_PAGE in got["floor_plan"].review_reasons
    assert got["land_lots"].review_reasons == [normalize.R_SHARE]
    assert got["seller_name"].review_reasons == [normalize.R_MISSING] and got["seller_name"].needs_review


def test_unsupported_values_become_null(spark):
    pages = spark.createDataFrame([("a", 1, "text", "┃所在│海区見本\n┃　　│二丁目┃床面積│４１：８０"), ("a", 2, "scan", "")], PAGES)
    src = lambda p, *t: [(p, x) for x in t]
    fields = spark.createDataFrame([
        ("a", "building.location", "海区見本二丁目", src(1, "海区見本二丁目"), "text"), ("a", "unit.area", "41.80", src(1, "41:80"), "number"),
        ("a", "unit.bad", "42", src(1, "41:80"), "number"), ("a", "owner.name", "木見", src(2, "木見"), "text"), ("a", "unit.name", "203", src(1, "204"), "text"),
        ("a", "document_type", "building", src(1, "所在"), "text")], "file_hash string, path string, value string, sources array<struct<page:int,text:string>>, kind string")
    out, warnings = normalize.validate_evidence(fields, pages)
    got = {r.path: r.value for r in out.collect()}
    assert got == {"building.location": "海区見本二丁目", "unit.area": "41.80", "unit.bad": None, "owner.name": "木見", "unit.name": None, "document_type": "building"}
    assert {r.path for r in warnings.collect()} == {"unit.bad", "unit.name"}


def test_equal_items_stay_one_row_each(spark):
    pages = spark.createDataFrame([("f", 1, "text", "管理費は12000円です"), ("f", 2, "text", "積立金"), ("g", 1, "scan", None)], "file_hash string, page_no int, mode string, text string")
    one = ("f", "management_fee", "12000", "管理費は12000円", 2, 0.95, None)
    rows = [one, one, ("f", "management_fee", "12000", "管理費は12000円", 1, 0.95, None), ("f", "management_fee", "12000", None, None, 0.95, None), ("f", "management_fee", None, "管理費は12000円", None, None, None)]
    items = spark.createDataFrame(rows, "file_hash string, field_code string, value string, source_text string, page_no int, confidence double, value_as_of_date string")
    catalog = spark.createDataFrame([("management_fee", "number")], "field_code string, data_type string")
    report = normalize.normalize_report(items, pages, catalog).collect()
    assert len(report) == len(rows) and [r.page_no for r in report if not r.needs_review and r.value] == [1, 1, 1]
    rules = normalize.normalize_rules(items, pages, ("management_fee", "pet_restrictions"))
    got = sorted(((r.file_hash, r.field_code, tuple(r.review_reasons)) for r in rules.collect()), key=str)
    assert len([r for r in got if r[:2] == ("f", "management_fee")]) == len(rows)
    assert [r for r in got if r[1] == "pet_restrictions" or r[0] == "g"] == [("f", "pet_restrictions", (normalize.R_MISSING,)), ("g", "management_fee", (normalize.R_MISSING,)), ("g", "pet_restrictions", (normalize.R_MISSING,))]
    assert sum(r[2] == (normalize.R_MATCH,) for r in got) == 2 and sum(r[2] == () for r in got) == 1


def test_report_folds_each_text_once(spark):
    """Items of one code do not meet the catalog in a product, and no text goes to Python in what is left once items and pages are written."""
    from shirube.workload import all_queries
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = all_queries()["report_checks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "ArrowEvalPython" not in plan and "CartesianProduct" not in plan
