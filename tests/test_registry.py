"""Ruled ledgers: title parts, rights, owners and liens."""
import pytest
from ruled import CONDO, LAND, lines_df

from shirube.plans import registry


@pytest.fixture(scope="module")
def read(spark):
    gaiji = tuple([line.replace("佐　見　本　子", "佐　見　\uee0b　子") for line in page] for page in CONDO)
    lines = lines_df(spark, {"condo": CONDO, "land": LAND, "odd": gaiji}).cache()
    fields, reviews, warnings = registry.registry_extract(lines.repartition(3))
    rows = {(r.file_hash, r.path): r for r in fields.collect()}
    return rows, {(r.file_hash, r.path) for r in reviews.collect()}, [tuple(r) for r in warnings.collect()]


def test_unit_title(read):
    rows = read[0]
    value = lambda path: rows[("condo", path)].value
    assert value("document_type") == "building"
    assert value("building.location") == "海区見本二丁目"
    assert value("building.lot_number") == "7番地1、7番地2"
    assert value("building.name") == "見本ハイツ"
    assert value("building.structure") == "鉄骨造陸屋根2階建"
    assert [(value(f"building.floor_areas.{i}.floor"), value(f"building.floor_areas.{i}.area")) for i in (0, 1)] == [("1階", "120.40"), ("2階", "99.05")]
    assert value("unit.house_number") == "見本二丁目7番1の203"
    assert value("unit.name") == "203"
    assert (value("unit.type"), value("unit.floor"), value("unit.registered_area")) == ("居宅", "2階", "41.80")
    assert value("unit.built_date") == "平成2年3月4日"
    assert rows[("condo", "unit.built_date")].sources[0].page == 1


def test_rights_reach_each_parcel(read):
    rows = read[0]
    assert rows[("condo", "land_right.exists")].value == "true"
    assert [tuple(rows[("condo", f"lands.{i}.{k}")].value for k in ("lot_number", "area", "right_type", "right_share")) for i in (0, 1)] == [
        ("7番1", "210.00", "所有権", "10万分の2500"), ("7番2", "40.25", "所有権", "10万分の2500")]


def test_struck_text_is_never_current(read):
    rows = read[0]
    assert rows[("condo", "owner.name")].value == "佐見本子"
    assert rows[("condo", "owner.address")].value == "海区見本三丁目3番3号"
    assert [(rows[("condo", f"mortgages.{i}.rank")].value, rows[("condo", f"mortgages.{i}.active")].value) for i in (0, 1)] == [("1", "false"), ("3", "true")]
    assert rows[("condo", "mortgages.1.amount")].value == "金1,500万円"
    assert [rows[("land", f"lands.0.{k}")].value for k in ("location", "lot_number", "category", "area")] == ["海区見本二丁目", "7番9", "宅地", "290.50"]


def test_ledger_keeps_exact_shares(read):
    rows, reviews, _ = read
    names = {rows[k].value: k[1].split(".")[1] for k in rows if k[0] == "land" and k[1].startswith("owners.") and k[1].endswith(".name")}
    shares = {n: rows[("land", f"owners.{i}.share")].value for n, i in names.items()}
    assert shares == {"見本建設株式会社": "10000分の9443", "林見花子": "10000分の200", "株式会社見本不動産": "1万分の257", "森見次郎": "1万分の100"}
    assert ("land", f"owners.{names['見本建設株式会社']}.share") in reviews
    assert ("land", f"owners.{names['株式会社見本不動産']}.share") not in reviews
    assert ("land", "owners") not in reviews


def test_untranscribable_name_needs_review(read):
    rows, reviews, _ = read
    assert ("odd", "owner.name") in reviews and rows[("odd", "owner.name")].needs_review
