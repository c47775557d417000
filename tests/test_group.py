"""Group integration, registration rows and document normalisation."""
import pytest

from shirube.plans import document, group

FIELDS = "group_id string, file_hash string, path string, value string, sources array<struct<page:int,text:string,source_pdf:string,file_hash:string>>, needs_review boolean"
DOCS = "group_id string, file_hash string, ord int, document_type string"


def rows(g, file_hash, review=(), **paths):
    return [(g, file_hash, p.replace("__", "."), v, [(1, v, file_hash + ".pdf", file_hash)] if v else [], p.replace("__", ".") in review) for p, v in paths.items()]


def building(g, right="true", owner="株式会社見本不動産", location="海区見本二丁目", lot="7番地1", **extra):
    return rows(g, g + "b", building__location=location, building__lot_number=lot, building__name="見本ハイツ", unit__house_number="見本二丁目7番1の203", unit__name="203",
                unit__built_date="平成12年1月1日", land_right__exists=right, owner__name=owner, owner__address="海区", lands__0__location="海区見本二丁目", lands__0__lot_number="7番1",
                lands__0__right_type="所有権", lands__0__right_share="10万分の2500", **extra)


def land(g, name, lot, *owners, area=None, review=()):
    paths = {"lands__0__location": "海区見本二丁目", "lands__0__lot_number": lot, "lands__0__category": "宅地"}
    if area:
        paths["lands__0__area"] = area
    for i, (n, s) in enumerate(owners):
        paths[f"owners__{i}__name"] = n
        if s:
            paths[f"owners__{i}__share"] = s
    return rows(g, name, review, **paths)


@pytest.fixture(scope="module")
def made(spark):
    data, docs = [], []
    def add(g, b, *lands_):
        data.extend(b)
        docs.append((g, g + "b", 0, "building"))
        for i, l in enumerate(lands_):
            data.extend(l)
            docs.append((g, l[0][1], i + 1, "land"))
    add("own", building("own"), land("own", "own1", "7番9", ("株式会社見本不動産", "10分の1")))
    add("stranger", building("stranger"), land("stranger", "str1", "7番9", ("近隣の別会社", "10分の1")))
    add("pair", building("pair", owner="甲野一郎\n甲野花子"), land("pair", "pair1", "7番9", ("甲野一郎", "10000分の120"), ("甲野花子", "10000分の80"), ("別の人", "10分の9")))
    add("site", building("site", right="false", location="海区見本二丁目7番1、7番4", lot=None), land("site", "site1", "7番1", ("株式会社見本不動産", "10分の3"), area="300.00"), land("site", "site2", "7番4", ("株式会社見本不動産", None)))
    add("lease", building("lease", tenure_type="leasehold"))
    add("clash", building("clash", lands__0__area="100.00"), land("clash", "cl1", "7番1", ("x", None), area="120.00"))
    data.extend(land("bare", "bare1", "9番1", ("甲", None)))
    docs.append(("bare", "bare1", 0, "land"))
    fields = spark.createDataFrame(data, FIELDS).cache()
    documents = spark.createDataFrame(docs, DOCS).cache()
    return group.integrate_group(documents, fields), fields, documents


def test_parcels_and_seller_shares(made):
    parcels = {(r.group_id, r.lot_number): r for r in made[0]["parcels"].collect()}
    road = parcels[("own", "7番9")]
    assert (road.right_type, road.right_share, road.outside) == ("所有権", "10分の1", True) and road.warnings
    assert parcels[("own", "7番1")].right_share == "10万分の2500" and not parcels[("own", "7番1")].outside
    stranger = parcels[("stranger", "7番9")]
    assert stranger.right_share is None and stranger.warnings == ["parcel outside the site, seller is no owner"]
    pair = parcels[("pair", "7番9")]
    assert pair.right_share == "10000分の200" and "co-owned: seller shares added" in pair.warnings
    assert (int(pair.share_numerator), int(pair.share_denominator)) == (200, 10000)
    assert not parcels[("site", "7番1")].outside and not parcels[("site", "7番4")].outside
    assert parcels[("site", "7番1")].right_share == "10分の3" and parcels[("site", "7番1")].area == "300.00"
    assert parcels[("site", "7番4")].right_type == "所有権" and parcels[("site", "7番4")].right_share is None  # sole owner


def test_types_reviews_and_blocks(made):
    out = made[0]
    kinds = {r.group_id: r.property_type for r in out["types"].collect()}
    assert kinds == {"own": "condominium_land_right", "stranger": "condominium_land_right", "pair": "condominium_land_right", "site": "condominium_no_land_right",
                     "lease": "leasehold_condominium", "clash": "condominium_land_right", "bare": "land_only"}
    assert {(r.group_id, r.item) for r in out["group_review"].collect()} == {("clash", "資料間不一致:土地7番1.area")}
    blocked = {r.group_id: r.reason for r in group.blocked_reason(out["types"], out["group_review"]).collect()}
    assert blocked["own"] is None and blocked["lease"] is None and blocked["stranger"] is None
    assert blocked["bare"] == group.BLOCK_LAND and blocked["clash"].startswith(group.BLOCK_HEAD)
    assert ("lease", group.LEASE_NOTE) in {(r.group_id, r.warning) for r in out["warnings"].collect()}


def test_registration_rows(spark, made):
    out, fields, documents = made
    files = documents.select("group_id", "file_hash", "ord")
    reg = group.registration_rows(out, fields, files)
    values = {(r.group_id, r.field_code): r for r in reg["values"].collect()}
    assert values[("own", "built_date")].value_json == '"2000-01-01"' and values[("own", "built_date")].confidence == 1.0
    assert values[("own", "land_lots")].value_json.count("lot_number") == 2
    assert values[("own", "building_name")].page_no == 1
    assert ("bare", "building_name") not in values and ("clash", "building_name") not in values
    master = {(r.group_id, r.field_code): (r.side, r.value_json) for r in reg["master"].collect()}
    assert master[("own", "building_name")] == ("building", '"見本ハイツ"') and master[("own", "current_owner_name")][0] == "unit"
    per = {(r.group_id, r.file_hash, r.field_code) for r in reg["document_values"].collect()}
    assert ("own", "own1", "land_lots") in per and ("own", "ownb", "land_lots") in per and ("own", "own1", "building_name") not in per
    short = files.filter("file_hash <> 'own1'")
    refused = {r.group_id for r in group.registration_rows(out, fields, short)["blocked"].collect()}
    assert "own" in refused


def test_doubtful_values_stay_out_of_masters(spark):
    docs = spark.createDataFrame([("g", "gb", 0, "building")], DOCS)
    fields = spark.createDataFrame(building("g")[:-1] + rows("g", "gb", review=("unit.type",), unit__type="居宅"), FIELDS)
    fields = fields.withColumn("confidence", __import__("pyspark").sql.functions.when(__import__("pyspark").sql.functions.col("path") == "unit.name", 0.5))
    reg = group.registration_rows(group.integrate_group(docs, fields), fields, docs.select("group_id", "file_hash", "ord"))
    codes = {r.field_code for r in reg["master"].collect()}
    assert "house_number" in codes and "unit_type" not in codes and "unit_name" not in codes


def test_document_normalisation(spark):
    text = "\n".join(["専有部分の建物の表示", "┃家屋番号│見本二丁目７番１の２０３│┃"])
    pages = spark.createDataFrame([("u", 1, "text", text), ("s", 1, "scan", ""), ("h", 1, "text", "主である建物の表示")], "file_hash string, page_no int, mode string, text string")
    raw = [("u", "unit.house_number", "見本二丁目7番1の203"), ("u", "unit.registered_area", "４１：８０"), ("u", "lands.0.location", "海区見本二丁目7番1"), ("u", "lands.0.lot_number", "7番1"),
           ("u", "lands.0.right_share", "2500/100000"), ("s", "unit.house_number", "1番1の1"), ("h", "unit.name", "203"), ("h", "lands.0.lot_number", "1番")]
    fields = spark.createDataFrame([(f, p, v, [(1, v, None, f)], False) for f, p, v in raw], "file_hash string, path string, value string, sources array<struct<page:int,text:string,source_pdf:string,file_hash:string>>, needs_review boolean")
    out, corrections = document.normalize_document(fields, pages)
    got = {(r.file_hash, r.path): r for r in out.collect()}
    assert got[("u", "unit.registered_area")].value == "41.80"
    assert got[("u", "lands.0.location")].value == "海区見本二丁目" and got[("u", "lands.0.right_share")].value == "100000分の2500"
    assert got[("u", "land_right.exists")].value == "false" and got[("u", "property_type")].value == "condominium_no_land_right"
    assert got[("s", "unit.house_number")].needs_review and not got[("u", "unit.house_number")].needs_review
    assert got[("h", "unit.name")].value is None and got[("h", "property_type")].value == "detached_house"
    changed = {(r.file_hash, r.path): r.category for r in corrections.collect()}
    assert changed[("u", "unit.registered_area")] == document.C_AREA and changed[("u", "lands.0.location")] == document.C_LOT
    assert changed[("h", "lands.0.lot_number")] == document.C_HOUSE and changed[("u", "document_type")] == document.C_TYPE
