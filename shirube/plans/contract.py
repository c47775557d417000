"""JOB-18, JOB-19: the contract form as a long table of cells."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import date_to_era
from ..functions.evidence import trusted
from ..functions.text import nfkc_compact, room_key, split_floor, split_house_number, split_lot, zone_key
from ..operators.aggregates import group_zones

# ---- fixed values: cells of the form ------------------------------------------------------------------
REVIEW = "要確認"
INPUT_SHEET, DISCLOSURE_SHEET = "基本入力", "重説"
INPUT_CELLS = ["AB13", "AS13", "F15", "J15", "N15", "X15", "AJ15", "AS15", "AB24", "AG24", "AJ24", "AB26", "J28", "AF28",
               "X30", "AF30", "J32", "Q32", "AH32", "J34", "U34", "X34", "AB34", "AF34", "F37", "AB37", "R54", "V54", "AR54"]
FLOOR_ROWS, FLOOR_COLUMNS = range(23, 40), ("AY", "BA")
PARCEL_ROWS, PARCEL_COLUMNS = range(42, 54, 2), ("F", "U", "Y", "AB", "AG", "AL", "AT")
ERA_CELLS = ("U34", "X34", "AB34", "AF34")
HANDOVER_CELLS = ("O119", "R119", "V119", "Z119")
ZONING_TYPE_CELLS = {
    "第1種低層住居専用地域": ("BI96", "BV96"), "第2種住居地域": ("BY96", "CK96"), "準工業地域": ("CN96", "DA96"),
    "第2種低層住居専用地域": ("BI98", "BV98"), "準住居地域": ("BY98", "CK98"), "工業地域": ("CN98", "DA98"),
    "第1種中高層住居専用地域": ("BI100", "BV100"), "田園住居地域": ("BY100", "CK100"), "工業専用地域": ("CN100", "DA100"),
    "第2種中高層住居専用地域": ("BI102", "BV102"), "近隣商業地域": ("BY102", "CK102"), "用途地域の指定なし": ("CN102", "DA102"),
    "第1種住居地域": ("BI104", "BV104"), "商業地域": ("BY104", "CK104"),
}
DISTRICT_CELLS = {
    "fire_zone": ("防火地域", "BI106", "BV106"), "semi_fire_zone": ("準防火地域", "BI108", "BV108"),
    "special_use_district": ("特別用途地区", "CN114", "DA114"), "height_use_district": ("高度利用地区", "BI120", "BV120"),
    "district_plan": ("地区計画区域", "BY110", "CK110"),
}
VALUE_SLOTS = {  # code: (label, [(box, value cell, marker cell)])
    "building_coverage_ratio": ("建ぺい率", [(None, "BW126", "CB126"), (None, "CF126", "CK126"), (None, "CO126", "CT126")]),
    "floor_area_ratio": ("容積率", [(None, "BW130", "CB130"), (None, "CF130", "CK130"), (None, "CO130", "CT130")]),
    "height_district": ("高度地区", [("BI114", "BP114", "BV114"), ("BI116", "BP116", "BV116")]),
    "minimum_height_district": ("最低限高度地区", [("BI118", "BR118", "BV118")]),
    "minimum_lot_area": ("敷地面積の最低限度", [("BR138", "BX138", None)]),
}
LOT_AREA_NO_CELL, NOTE_CELL = "BU138", "BI166"
BOUNDARY_NOTE = "【要確認】用途地域が複数のため、本物件の道路との位置関係を確認し、この文言を修正してください。"
NUMBER_CODES = ("building_coverage_ratio", "floor_area_ratio", "minimum_lot_area")
DISCLOSURE_INPUTS = [("sale_price", "購入時_sale_price"), ("earnest_money", "購入時_earnest_money"), ("handover_date", "購入時_handover_date_era")]
# --------------------------------------------------------------------------------------------------------


def _explode(df: DataFrame, key: str, sheet: str, cells: dict[str, Column]) -> DataFrame:
    """One pass over the wide rows; each row gives one output row per cell."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for c, v in cells.items()]))
    return df.select(key, F.lit(sheet).alias("sheet"), each.alias("_c")).select(key, "sheet", "_c.*")


def cells_from_columns(df: DataFrame, key: str, sheet: str, columns: dict[str, tuple[str, str]], era_dates: dict[tuple, str]) -> DataFrame:
    """Plain unpivot: ``columns`` maps cell to (column, default); a date fills era, year, month and day."""
    cells = {cell: F.coalesce(F.col(c).cast("string"), F.lit(default)) for cell, (c, default) in columns.items()}
    for targets, column in era_dates.items():
        parts = date_to_era(F.col(column))
        for cell, part in zip(targets, ("era", "year", "month", "day")):
            cells[cell] = parts[part]
    return _explode(df, key, sheet, cells)


def _plain(number: Column) -> Column:
    """Number as the form shows it: no trailing zeros."""
    text = number.cast("decimal(18,4)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def input_cells(cases: DataFrame) -> DataFrame:
    """JOB-18, input sheet. Every input cell is written, so old template text never survives.

    ``cases``: case_id, building and unit columns (land_lots, floor_areas arrays), sale_price, earnest_money, handover_date.
    The form has rows for 6 parcels and 17 floors; ``overflow`` lists the further ones.
    """
    folded = (cases.withColumn("_house", split_house_number(F.col("house_number")))
              .withColumn("_loc_text", nfkc_compact(F.coalesce("registry_location", F.lit(""))))
              .withColumn("_first_lot", split_lot(F.try_element_at("land_lots", F.lit(1))["lot_number"]))
              .withColumn("_first_loc", nfkc_compact(F.coalesce(F.try_element_at("land_lots", F.lit(1))["location"], F.lit("")))))
    folded = folded.withColumn("_places", F.filter(F.transform(F.split("_loc_text", "[・、,]"), lambda p: F.regexp_replace(p, r"\d+番(?:地)?\d*$", "")), lambda p: p != ""))
    place = F.try_element_at("_places", F.lit(1))
    town = F.regexp_extract(place, "^.*?[市区町村](.+)$", 1)
    prefix = F.when(F.coalesce(F.endswith(place, F.col("_house.place")), F.lit(False)), F.col("_house.place")).otherwise(town)
    folded = folded.withColumn("_place", place).withColumn("_prefix", F.coalesce(prefix, F.lit("")))
    fits = (F.size("_places") > 0) & F.col("_first_lot").isNotNull() & (F.col("_first_loc") == F.col("_place"))
    folded = folded.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn(
        "_more_lots", F.array_join(F.transform(F.slice("land_lots", F.lit(2), F.greatest(F.size("land_lots") - 1, F.lit(0))), lambda l: F.concat(l["location"], l["lot_number"])), "　"))
    ok, lots = F.col("_fits"), F.coalesce(F.size("land_lots"), F.lit(0))
    house_fits = (F.col("_house.place") == F.col("_prefix")) & (F.col("_house.main") == F.col("_first_lot.main")) & (F.col("_house.branch") == F.col("_first_lot.branch"))
    c = F.col
    cells = {cell: F.lit("") for cell in INPUT_CELLS}
    cells.update({
        "AB13": F.coalesce(F.nullif(c("building_name"), F.lit("")), F.lit(REVIEW)),
        "AS13": F.coalesce(F.nullif(F.regexp_replace(nfkc_compact(c("unit_name")), "号(?:室)?$", ""), F.lit("")), F.lit(REVIEW)),
        "J28": c("building_structure"), "AF30": c("unit_name"), "J32": c("unit_type"), "Q32": c("unit_structure"), "J34": _plain(c("registered_area")),
        "F37": c("current_owner_name"), "AB37": c("current_owner_address"), "AH32": split_floor(c("unit_floor")),
        "J15": F.when(ok, F.expr("left(_place, length(_place) - length(_prefix))")).otherwise(REVIEW), "N15": F.when(ok, c("_prefix")),
        "AB24": F.when(ok, c("_first_lot.main")).otherwise(REVIEW), "AG24": F.when(ok, c("_first_lot.branch")),
        "AJ24": F.when(ok & (lots > 1), F.when(lots == F.size("_places"), nfkc_compact(c("_more_lots"))).otherwise(REVIEW)).when(~ok, c("registry_location")),
        "X30": F.when(ok & F.coalesce(house_fits, F.lit(False)), c("_house.room")).otherwise(REVIEW),
        "X15": F.coalesce(F.nullif(c("display_address"), F.lit("")), F.lit(REVIEW + "（住居表示）")),
        "R54": F.when(c("has_land_right"), "■").otherwise("□"), "V54": F.when(c("has_land_right") == F.lit(False), "■").otherwise("□"),
        "AA70": _plain(c("sale_price")), "AA72": _plain(c("earnest_money"))})
    for targets, column in ((ERA_CELLS, "built_date"), (HANDOVER_CELLS, "handover_date")):
        parts = date_to_era(c(column))
        for cell, part in zip(targets, ("era", "year", "month", "day")):
            cells[cell] = parts[part]
    n, d = c("land_right_numerator"), c("land_right_denominator")
    shared = F.coalesce((d > 0) & (n > 0) & (n <= d), F.lit(False))
    for i, row in enumerate(PARCEL_ROWS):
        lot = F.try_element_at("land_lots", F.lit(i + 1))
        here = lots > i
        values = (F.lit("") if i == 0 else lot["location"], F.lit("") if i == 0 else lot["lot_number"], lot["land_category"], _plain(lot["area"]),
                  F.when(here, c("land_right_type")), F.when(here & shared, d), F.when(here & shared, n))
        cells.update({f"{col}{row}": v for col, v in zip(PARCEL_COLUMNS, values)})
    for i, row in enumerate(FLOOR_ROWS):
        floor = F.try_element_at("floor_areas", F.lit(i + 1))
        full = floor["floor"].isNotNull() & floor["area"].isNotNull()
        cells.update({f"{FLOOR_COLUMNS[0]}{row}": F.when(full, floor["floor"]), f"{FLOOR_COLUMNS[1]}{row}": F.when(full, _plain(floor["area"]))})
    out = _explode(folded, "case_id", INPUT_SHEET, cells)
    kept_when_empty = F.col("cell").isin(*[x for x in ("AA70", "AA72", *HANDOVER_CELLS)])
    return out.filter((F.col("value") != "") | ~kept_when_empty)


def overflow(cases: DataFrame) -> DataFrame:
    """WIN-16: parcels and floors that the form has no row for: case_id, list, position (from 1), values. Nothing is dropped silently."""
    lists = {"land_lots": (len(PARCEL_ROWS), ("location", "lot_number", "land_category")), "floor_areas": (len(FLOOR_ROWS), ("floor",))}
    out = None
    for name, (rows, texts) in lists.items():
        item = F.col("_item")
        values = F.array(*[item[t].cast("string") for t in texts], _plain(item["area"]))
        one = (cases.select("case_id", F.posexplode(name).alias("_pos", "_item")).filter(F.col("_pos") >= rows)
               .select("case_id", F.lit(name).alias("list"), (F.col("_pos") + 1).alias("position"), values.alias("values")))
        out = one if out is None else out.unionByName(one)
    return out


def zoning_cells(zones: DataFrame) -> DataFrame:
    """JOB-18, disclosure sheet. Equal values share a box and a combined marker; values beyond the slots go to the note.

    ``zones``: building_id, position, field_code, value, needs_review.
    """
    counts = zones.groupBy("building_id").agg(F.count_distinct("position").alias("_zones"))
    groups = group_zones(zones).join(counts, "building_id").withColumn("_key", zone_key(F.col("value")))
    many = F.col("_zones") > 1
    marker = F.when(many, F.col("marker"))
    from pyspark.sql import Window
    # Groups of one building and code are at most its few zones.
    groups = groups.withColumn("_slot", F.row_number().over(Window.partitionBy("building_id", "field_code").orderBy("first_position")))
    code, slot = F.col("field_code"), F.col("_slot")
    number = F.regexp_replace("value", r"[^\d.]", "").try_cast("double")
    plain = _plain(number)
    entries = F.array().cast("array<struct<cell:string,value:string>>")
    entry = lambda cell, value: F.struct(F.lit(cell).alias("cell"), value.cast("string").alias("value"))
    for name, (box, mark) in ZONING_TYPE_CELLS.items():
        entries = F.when((code == "zoning_type") & (F.col("_key") == name), F.array(entry(box, F.lit("■")), entry(mark, marker))).otherwise(entries)
    for district, (name, box, mark) in DISTRICT_CELLS.items():
        entries = F.when((code == district) & (F.col("_key") == name), F.array(entry(box, F.lit("■")), entry(mark, marker))).otherwise(entries)
    for slotted, (_, slots) in VALUE_SLOTS.items():
        for i, (box, cell, mark) in enumerate(slots, 1):
            shown = plain if slotted in NUMBER_CODES else F.col("value")
            written = [entry(cell, shown)] + ([entry(box, F.lit("■"))] if box else []) + ([entry(mark, marker)] if mark else [])
            if slotted == "minimum_lot_area":
                written = [F.when(number.isNotNull(), x) for x in written + [entry(LOT_AREA_NO_CELL, F.lit("□"))]]
            entries = F.when((code == slotted) & (slot == i), F.array(*written)).otherwise(entries)
    cells = groups.select("building_id", F.explode(entries).alias("_e")).select("building_id", "_e.*").filter("value is not null")
    capacity = F.lit(None).cast("int")
    label = F.lit(None).cast("string")
    order = F.lit(None).cast("int")
    for i, (slotted, (text, slots)) in enumerate(VALUE_SLOTS.items()):
        capacity = F.when(code == slotted, len(slots)).otherwise(capacity)
        label = F.when(code == slotted, text).otherwise(label)
        order = F.when(code == slotted, i).otherwise(order)
    spill = groups.withColumn("_cap", capacity).withColumn("_label", label).withColumn("_order", order).filter(F.col("_slot") > F.col("_cap"))
    texts = spill.groupBy("building_id", "_order", "_label", "_cap").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_slot", F.concat("marker", "value").alias("t")))), lambda x: x["t"]), "、").alias("_t"))
    sentence = F.concat(F.col("_label"), F.lit("は"), F.col("_cap").cast("string"), F.lit("件までしか自動反映できないため、"), F.col("_t"), F.lit("は手入力してください。"))
    notes = texts.groupBy("building_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_order", sentence.alias("s")))), lambda x: x["s"]), " ").alias("_note"))
    note = counts.filter("_zones > 1").join(notes, "building_id", "left").select(
        "building_id", F.lit(NOTE_CELL).alias("cell"), F.concat_ws(" ", F.lit(BOUNDARY_NOTE), F.col("_note")).alias("value"))
    return cells.unionByName(note).select("building_id", F.lit(DISCLOSURE_SHEET).alias("sheet"), "cell", "value")


def named_range_writes(values: DataFrame, catalog: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOB-19: (writes, skipped). Only approved, trusted values whose named cell is defined exactly once.

    ``values``: case_id, field_code, value_json, confidence, page_no, source_text, needs_review, approved;
    ``catalog``: field_code, named_range; ``names``: name, sheet, cell.
    """
    once = names.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("sheet").alias("sheet"), F.min("cell").alias("cell"))
    target = catalog.select("field_code", "named_range")
    joined = values.join(target, "field_code", "left").join(once, F.col("named_range") == F.col("name"), "left")
    sure = trusted(F.col("value_json"), F.col("confidence"), F.col("page_no"), F.col("source_text"), F.col("needs_review"), True)
    ok = F.coalesce(F.col("approved") & sure & (F.col("confidence") <= 1) & (F.col("_n") == 1) & (F.col("sheet") == INPUT_SHEET), F.lit(False))
    text = F.regexp_replace("value_json", '^"|"$', "")
    value = F.when(F.col("field_code") == "unit_name", room_key(text)).otherwise(text)
    staged = joined.withColumn("value", value).withColumn("_ok", ok & (value != "") & ~value.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return (staged.filter("_ok").select("case_id", "field_code", "named_range", "sheet", "cell", "value"),
            staged.filter(~F.col("_ok")).select("case_id", "field_code"))


def disclosure_inputs(cases: DataFrame, values: DataFrame) -> DataFrame:
    """JOB-19: the named disclosure inputs of each case; what is not sure is cleared, never left as it was."""
    inputs = F.array(*[F.struct(F.lit(c).alias("field_code"), F.lit(n).alias("named_range")) for c, n in DISCLOSURE_INPUTS])
    expected = cases.select("case_id", F.explode(inputs).alias("_x")).select("case_id", "_x.*")
    sure = trusted(F.col("value_json"), F.col("confidence"), F.col("page_no"), F.col("source_text"), F.col("needs_review"))
    good = values.filter(sure & (F.col("confidence") <= 1)).select("case_id", "field_code", F.regexp_replace("value_json", '^"|"$', "").alias("_v"))
    joined = expected.join(good, ["case_id", "field_code"], "left")
    parts = date_to_era(F.try_to_date(F.col("_v"), "yyyy-MM-dd"))
    suffixes = ("era", "year", "month", "day")
    dated = F.array(*[F.struct(F.concat(F.regexp_replace("named_range", "_era$", ""), F.lit(f"_{s}")).alias("name"), parts[s].cast("string").alias("value")) for s in suffixes])
    plain = F.array(F.struct(F.col("named_range").alias("name"), F.col("_v").alias("value")))
    return joined.select("case_id", F.explode(F.when(F.col("field_code") == "handover_date", dated).otherwise(plain)).alias("_c")).select(
        "case_id", "_c.name", F.coalesce("_c.value", F.lit("")).alias("value"))
