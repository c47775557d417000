"""Output cells: zones, slots, inputs and named ranges."""
import datetime as dt
from decimal import Decimal

from shirube import schemas
from shirube.catalog import load_catalog
from shirube.plans import contract

ZONES = "building_id string, position int, field_code string, value string, needs_review boolean"


def zone_cells(spark, *zones):
    data = [(b, p, c, v, False) for b, p, values in zones for c, v in values.items()]
    return {(r.building_id, r.cell): r.value for r in contract.zoning_cells(spark.createDataFrame(data, ZONES)).collect()}


def test_zone_markers_and_overflow(spark):
    two = [("t", i, {"zoning_type": "商業地域", "building_coverage_ratio": "80%", "floor_area_ratio": r}) for i, r in enumerate(("500%", "400%"))]
    four = [("f", i, {"floor_area_ratio": f"{r}%"}) for i, r in enumerate((100, 200, 300, 400))]
    got = zone_cells(spark, *two, ("o", 0, {"zoning_type": "第１種住居地域", "height_district": "17m第二種", "minimum_lot_area": "60㎡", "fire_zone": "なし"}), *four)
    assert (got[("t", "BY104")], got[("t", "CK104")], got[("t", "BW126")], got[("t", "CB126")]) == ("■", "(A)(B)", "80", "(A)(B)")
    assert (got[("t", "BW130")], got[("t", "CB130")], got[("t", "CF130")], got[("t", "CK130")]) == ("500", "(A)", "400", "(B)")
    assert got[("t", "BI166")] == contract.BOUNDARY_NOTE
    assert got[("o", "BI104")] == "■" and ("o", "BV104") not in got and got[("o", "BP114")] == "17m第二種" and ("o", "BI166") not in got
    assert (got[("o", "BX138")], got[("o", "BR138")], got[("o", "BU138")]) == ("60", "■", "□") and ("o", "BI106") not in got
    assert got[("f", "CO130")] == "300" and "容積率は3件までしか自動反映できないため、(D)400%は手入力してください。" in got[("f", "BI166")]


def test_input_cells(spark):
    lots = [("海区見本二丁目", "7番1", "宅地", Decimal("210.00")), ("海区見本二丁目", "7番2", "宅地", Decimal("40.25"))]
    schema = (f"case_id string, building_name string, unit_name string, building_structure string, unit_type string, unit_structure string, registered_area decimal(18,4), "
              f"current_owner_name string, current_owner_address string, unit_floor string, built_date date, handover_date date, land_lots {schemas.LOTS}, floor_areas {schemas.FLOORS}, "
              "registry_location string, house_number string, display_address string, has_land_right boolean, land_right_type string, land_right_numerator decimal(38,0), "
              "land_right_denominator decimal(38,0), sale_price decimal(18,2), earnest_money decimal(18,2)")
    full = ("a", "見本ハイツ", "203号室", "鉄骨造", "居宅", "鉄骨造1階建", Decimal("41.80"), "佐見本子", "海区", "2階部分", dt.date(1990, 3, 4), dt.date(2024, 5, 1), lots, [("1階", Decimal("120.40"))],
            "海区見本二丁目7番地1、海区見本二丁目7番地2", "見本二丁目7番1の203", None, True, "所有権", Decimal(2500), Decimal(100000), Decimal(5000), None)
    empty = ("b",) + (None,) * 22
    cells = {(r.case_id, r.cell): r.value for r in contract.input_cells(spark.createDataFrame([full, empty], schema)).collect()}
    a = lambda c: cells[("a", c)]
    assert (a("AB13"), a("AS13"), a("J34"), a("AH32")) == ("見本ハイツ", "203", "41.8", "2")
    assert [a(c) for c in contract.ERA_CELLS] == ["平成", "2", "3", "4"] and [a(c) for c in contract.HANDOVER_CELLS] == ["令和", "6", "5", "1"]
    assert (a("J15"), a("N15"), a("AB24"), a("AG24"), a("X30"), a("AJ24")) == ("海区", "見本二丁目", "7", "1", "203", "海区見本二丁目7番2")
    assert (a("Y42"), a("AB44"), a("AL44"), a("AT44"), a("F42"), a("U44")) == ("宅地", "40.25", "100000", "2500", "", "7番2")
    assert (a("R54"), a("V54"), a("X15"), a("AA70"), a("AY23"), a("BA23")) == ("■", "□", "要確認（住居表示）", "5000", "1階", "120.4")
    assert cells[("b", "AB13")] == "要確認" and cells[("b", "J15")] == "要確認" and cells[("b", "F37")] == "" and cells[("b", "R54")] == "□" and ("b", "AA70") not in cells


def test_named_ranges(spark):
    values = spark.createDataFrame([
        ("a", "unit_name", '"0203 号室"', 0.9, 1, "q", False, True), ("a", "building_name", '"x"', 0.8, 1, "q", False, True), ("a", "management_fee", "1", 0.9, 1, "q", False, True),
        ("b", "building_name", '"y"', 0.9, 1, "q", False, False)], "case_id string, field_code string, value_json string, confidence double, page_no int, source_text string, needs_review boolean, approved boolean")
    names = spark.createDataFrame([("重調_unit_name", "基本入力", "AF30"), ("重調_building_name", "基本入力", "AB13")], "name string, sheet string, cell string")
    writes, skipped = contract.named_range_writes(values, load_catalog(spark), names)
    assert [(r.case_id, r.cell, r.value) for r in writes.collect()] == [("a", "AF30", "0203")]
    assert skipped.count() == 3
    inputs = spark.createDataFrame([("a", "sale_price", "100", 0.9, 1, "q", False), ("a", "handover_date", '"1989-01-07"', 0.9, 1, "q", False), ("a", "earnest_money", "5", 0.5, 1, "q", False)],
                                   "case_id string, field_code string, value_json string, confidence double, page_no int, source_text string, needs_review boolean")
    got = {r.name: r.value for r in contract.disclosure_inputs(spark.createDataFrame([("a",)], "case_id string"), inputs).collect()}
    assert got == {"購入時_sale_price": "100", "購入時_earnest_money": "", "購入時_handover_date_era": "昭和", "購入時_handover_date_year": "64", "購入時_handover_date_month": "1", "購入時_handover_date_day": "7"}
