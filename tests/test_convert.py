"""Documents of the older form, and the checks of what is easily overlooked."""
import json

from shirube.plans import convert, sanity

FULL = {"一棟の建物": {"所在_市区町村町名": "港区芝", "所在_番": 12, "所在_枝番": "3", "構造": "鉄骨", "各階床面積": [{"階": 1, "面積": "100:50"}, {"階": "地下1", "面積": 20}, {"階": 2}]},
        "土地": [{"地目": "宅地", "地積": "１２３.４", "権利の種類": "所有権", "持分_分子": 5, "持分_分母": 100}, {"所在": "港区三田", "地番": "9番", "権利の種類": "所有権", "持分_分子": 6, "持分_分母": 100}],
        "専有部分": {"家屋番号_枝番": 101, "建物の名称": "101", "階部分": 1, "床面積": "55.10", "建築時期": {"元号": "平成", "年": "元", "月": 2, "日": 3}}, "所有者": {"氏名": "甲", "住所": ""}, "敷地権": True}


def converted(spark, docs):
    rows = [(k, house, doc if doc is None or isinstance(doc, str) else json.dumps(doc, ensure_ascii=False)) for k, house, doc in docs]
    return convert.convert_legacy(spark.createDataFrame(rows, "file_hash string, house_number string, document string"))


def test_columns_and_rows(spark):
    one = {**FULL, "土地": FULL["土地"][:1]}
    buildings, units, values, rejects = converted(spark, [("a", "芝12の３の101", FULL), ("b", "芝12の101", one), ("c", "芝12の102", FULL), ("d", "x", "{"), ("e", None, FULL), ("f", "の101", {"専有部分": {"家屋番号_枝番": "101"}})])
    b = {r.file_hash: r for r in buildings.collect()}
    assert set(b) == {"a", "b", "f"} and {tuple(r) for r in rejects.collect()} == {("c", "house number"), ("d", "not json"), ("e", "house number")}
    assert b["a"].registry_location == "港区芝12番地3" and json.loads(b["a"].floor_areas) == [{"floor": "1", "area": 100.5}, {"floor": "地下1", "area": 20}]
    assert json.loads(b["a"].land_lots) == [{"location": "港区芝", "lot_number": "12番3", "land_category": "宅地", "area": 123.4}, {"location": "港区三田", "lot_number": "9番", "land_category": None, "area": None}]
    u = {r.file_hash: r for r in units.collect()}
    assert (u["a"].unit_floor, u["a"].registered_area, u["a"].built_date, u["a"].has_land_right, u["a"].current_owner_address) == ("1階部分", "55.1", "1989-02-03", "true", None)
    assert (u["a"].land_right_type, u["a"].land_right_numerator, u["a"].land_right_denominator) == ("所有権", None, "100") and u["b"].land_right_numerator == "5"
    assert u["f"].unit_name is None and u["a"].house_number == "芝12の3の101"
    paths = {(r.field_code, r.path) for r in values.filter("file_hash = 'b'").collect()}
    assert ("land_right_numerator", "土地.持分_分子") in paths and ("registered_area", "専有部分.床面積") in paths and ("current_owner_address", "所有者.住所") not in paths


def test_forms_that_stop_a_document(spark):
    wrong = [("n", {"専有部分": {"家屋番号_枝番": 1, "床面積": "約50"}}, "registered_area: form"), ("d", {"専有部分": {"家屋番号_枝番": 1, "建築時期": {"元号": "皇紀", "年": 1, "月": 1, "日": 1}}}, "built_date: form"),
             ("f", {"専有部分": {"家屋番号_枝番": 1}, "一棟の建物": {"各階床面積": [{"階": 1, "面積": "x"}]}}, "floor_areas: form"), ("l", {"専有部分": {"家屋番号_枝番": 1}, "土地": [{"地積": "?"}]}, "land_lots: form")]
    *tables, rejects = converted(spark, [(k, "の1", d) for k, d, _ in wrong])
    assert {tuple(r) for r in rejects.collect()} == {(k, reason) for k, _, reason in wrong} and not any(t.count() for t in tables)
    assert all(t.count() == 0 for t in converted(spark, []))


def test_violations(spark):
    documents = spark.createDataFrame([("a", "1番", "港区芝", "港区", "芝", "30.10"), ("b", " ", "港区芝", None, "三田", "30.1"), ("c", None, None, "x", "y", None), ("d", "1", "港区　芝", "港区", "芝", "x")],
                                      "file_hash string, lot string, town string, form_ward string, form_town string, printed_total string")
    fields = spark.createDataFrame([("a", "current_owner_name", "甲及び乙"), ("b", "current_owner_name", "甲野"), ("a", "registered_area", "約50"), ("b", "registered_area", "５０.5"), ("c", "registered_area", None)], "file_hash string, field_code string, value string")
    parcels = spark.createDataFrame([("a", 1, "5", "4"), ("a", 2, "1,000", "1000"), ("b", 1, None, "4"), ("b", 2, "x", "1")], "file_hash string, parcel_no int, numerator string, denominator string")
    floors = spark.createDataFrame([("a", "1", "10.1"), ("a", "2", "20"), ("b", "1", "10.2"), ("b", "2", "20"), ("b", "3", "?"), ("c", "1", None)], "file_hash string, floor string, area string")
    got = {tuple(r) for r in sanity.sanity_checks(documents, fields, parcels, floors).collect()}
    assert got == {("a", "several_owners", "甲及び乙"), ("a", "area_not_a_number", "約50"), ("a", "share_above_one", "parcel 1: 5/4"), ("b", "floor_not_a_number", "3: ?"), ("b", "lot_missing", ""), ("c", "lot_missing", ""),
                   ("b", "place_differs", "三田 / 港区芝"), ("b", "floor_total_differs", "30.2 / 30.1")}
    totals = {r.file_hash: (str(r.floor_total), r.floors, r.floors_left_out) for r in sanity.floor_totals(floors).collect()}
    assert totals["a"] == ("30.100000", 2, 0) and totals["b"][1:] == (2, 1) and totals["c"] == ("None", 0, 0)
