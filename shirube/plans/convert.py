"""PRJ-12: documents of another form to master columns and field rows, by a mapping table."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import nfkc
from ..session import cut_lineage, spread

# ---- fixed values: paths of the older form, the columns they fill and the words in their values ------------
TOWN, LOT, BRANCH, MORE = "一棟の建物.所在_市区町村町名", "一棟の建物.所在_番", "一棟の建物.所在_枝番", "一棟の建物.所在_追加"
LEGACY = [
    (TOWN, "buildings", "registry_location", "location"), ("一棟の建物.構造", "buildings", "building_structure", None),
    ("一棟の建物.各階床面積", "buildings", "floor_areas", "floors"), ("土地", "buildings", "land_lots", "lands"),
    ("専有部分.建物の名称", "units", "unit_name", None), ("専有部分.種類", "units", "unit_type", None), ("専有部分.構造", "units", "unit_structure", None),
    ("専有部分.階部分", "units", "unit_floor", "floor"), ("専有部分.床面積", "units", "registered_area", "number"), ("専有部分.建築時期", "units", "built_date", "date"),
    ("所有者.氏名", "units", "current_owner_name", None), ("所有者.住所", "units", "current_owner_address", None), ("敷地権", "units", "has_land_right", None)]
ERA_YEARS = {"明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018, "西暦": 0}
FLOOR_KEYS = {"floor": "階", "area": "面積"}
LAND_KEYS = {"location": "所在", "lot_number": "地番", "land_category": "地目", "area": "地積"}
RIGHT_KEYS = {"land_right_type": "権利の種類", "land_right_numerator": "持分_分子", "land_right_denominator": "持分_分母"}
# --------------------------------------------------------------------------------------------------------------
MAPPING = "path string, table string, column string, transform string"


@dataclass(frozen=True)
class _Form:
    """One document of the older form, as a VARIANT column."""
    doc: Column

    def get(self, path: str, kind: str) -> Column:
        steps = "".join(f'["{part}"]' for part in path.split("."))
        return F.try_variant_get(self.doc, F.lit(f"${steps}"), kind)  # a constant path is parsed once

    def text(self, path: str) -> Column:
        return F.nullif(self.get(path, "string"), F.lit(""))

    def items(self, path: str) -> Column:
        return self.get(path, "array<variant>")


def _number(text: Column) -> Column:
    """Digits with at most one point; ":" stands for a point. Anything else is no number."""
    plain = F.translate(text, "０１２３４５６７８９．：:", "0123456789...")  # works inside lambdas, where no Python may run
    return F.when(plain.rlike(r"^\d+(?:\.\d+)?$"), plain.try_cast("decimal(18,4)"))


def _tidy(number: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _member(item: Column, key: str) -> Column:
    return F.nullif(F.try_variant_get(item, F.lit(f'$["{key}"]'), "string"), F.lit(""))


def _location(form: _Form, path: str) -> tuple[Column, Column]:
    main = form.text(LOT)
    joined = F.concat(form.text(path), main, F.lit("番地"), F.coalesce(form.text(BRANCH), F.lit("")), F.coalesce(form.text(MORE), F.lit("")))
    return joined, F.lit(False)


def _date(form: _Form, path: str) -> tuple[Column, Column]:
    part = lambda key: form.text(f"{path}.{key}")
    start = F.create_map(*[F.lit(x) for pair in ERA_YEARS.items() for x in pair])[part("元号")]
    year = F.when(part("年") == "元", 1).otherwise(part("年").try_cast("int"))
    made = F.try_to_date(F.concat_ws("-", F.lpad((start + year).cast("string"), 4, "0"), F.lpad(part("月"), 2, "0"), F.lpad(part("日"), 2, "0")), "yyyy-MM-dd")
    full = part("元号").isNotNull() & part("年").isNotNull() & part("月").isNotNull() & part("日").isNotNull()
    return F.when(full, made.cast("string")), full & made.isNull()


def _floors(form: _Form, path: str) -> tuple[Column, Column]:
    rows = F.transform(form.items(path), lambda x: F.struct(_member(x, FLOOR_KEYS["floor"]).alias("floor"), _member(x, FLOOR_KEYS["area"]).alias("area")))
    rows = F.filter(rows, lambda r: r["floor"].isNotNull() & r["area"].isNotNull())
    bad = F.exists(rows, lambda r: _number(r["area"]).isNull())
    return F.to_json(F.transform(rows, lambda r: F.struct(r["floor"].alias("floor"), _number(r["area"]).alias("area")))), bad


def _lands(form: _Form, path: str) -> tuple[Column, Column]:
    """The first parcel may leave its place and lot to those of the building."""
    lot = F.concat(form.text(LOT), F.lit("番"), F.coalesce(form.text(BRANCH), F.lit("")))
    def row(x: Column, i: Column) -> Column:
        first = lambda own, spare: F.when(i == 0, F.coalesce(own, spare)).otherwise(own)
        return F.struct(first(_member(x, LAND_KEYS["location"]), form.text(TOWN)).alias("location"), first(_member(x, LAND_KEYS["lot_number"]), lot).alias("lot_number"),
                        _member(x, LAND_KEYS["land_category"]).alias("land_category"), _member(x, LAND_KEYS["area"]).alias("area"))
    rows = F.transform(form.items(path), row)
    bad = F.exists(rows, lambda r: r["area"].isNotNull() & _number(r["area"]).isNull())
    typed = F.transform(rows, lambda r: F.struct(r["location"].alias("location"), r["lot_number"].alias("lot_number"), r["land_category"].alias("land_category"), _number(r["area"]).alias("area")))
    return F.to_json(typed, {"ignoreNullFields": "false"}), bad


def _plain(form: _Form, path: str) -> tuple[Column, Column]:
    return form.text(path), F.lit(False)


def _numeric(form: _Form, path: str) -> tuple[Column, Column]:
    raw = form.text(path)
    return _tidy(_number(raw)), raw.isNotNull() & _number(raw).isNull()


def _floor(form: _Form, path: str) -> tuple[Column, Column]:
    raw = form.text(path)
    return F.when(F.contains(raw, F.lit("階")), raw).otherwise(F.concat(raw, F.lit("階部分"))), F.lit(False)


TRANSFORMS = {None: _plain, "location": _location, "number": _numeric, "date": _date, "floor": _floor, "floors": _floors, "lands": _lands}


def convert_legacy(docs: DataFrame, mapping: list[tuple] = LEGACY, key: str = "file_hash") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(buildings, units, values, rejects) of documents(key, house_number, document: JSON text) of the older form.

    The mapping is compiled to one column for each of its rows, so a document is parsed and read once. A document is rejected as a
    whole, with a reason, if its text is no JSON, its house number does not end with the branch it prints, or a value does not have
    the form its transform asks for. Rights of land are columns only where all parcels agree. ``values``: key, field_code, value, path.
    """
    form = _Form(F.col("_doc"))
    # dealt out first: documents of one file are otherwise parsed by one task
    parsed = spread(docs.select(key, "house_number", "document"), key).select(key, F.nullif(F.trim(nfkc(F.col("house_number"))), F.lit("")).alias("house_number"), F.try_parse_json("document").alias("_doc"))
    made = {column: TRANSFORMS[transform](form, path) for path, _, column, transform in mapping}
    whole = F.coalesce(form.get("敷地権", "boolean"), F.lit(False))
    rights = {}
    for column, name in RIGHT_KEYS.items():
        found = F.transform(form.items("土地"), lambda x: _member(x, name))
        same = (F.size(found) > 0) & F.forall(found, lambda x: x.isNotNull()) & (F.size(F.array_distinct(found)) == 1)
        one = F.when(whole & same, F.try_element_at(found, F.lit(1)))
        rights[column] = (one, F.lit(False)) if column == "land_right_type" else (_tidy(_number(one)), one.isNotNull() & _number(one).isNull())
    branch = form.text("専有部分.家屋番号_枝番")
    named = F.coalesce(F.endswith("house_number", F.concat(F.lit("の"), branch)), F.lit(False))
    reason = F.when(F.col("_doc").isNull(), "not json").when(~named, "house number")
    for column, (_, bad) in {**made, **rights}.items():
        reason = reason.when(F.coalesce(bad, F.lit(False)), f"{column}: form")
    columns = {**made, **rights}
    # written once: all four results read it, and a filter on it would otherwise move below and parse the document for every test
    wide = parsed.select(key, "house_number", reason.alias("reason"), *[value.alias(column) for column, (value, _) in columns.items()])
    wide = cut_lineage(wide)
    good = wide.filter("reason is null").drop("reason")
    tables = {column: table for _, table, column, _ in mapping} | dict.fromkeys(RIGHT_KEYS, "units")
    paths = {column: path for path, _, column, _ in mapping} | {c: f"土地.{n}" for c, n in RIGHT_KEYS.items()} | {"house_number": "house_number"}
    pick = lambda name: [c for c in columns if tables[c] == name]
    rows = good.unpivot([key], ["house_number", *columns], "field_code", "value").filter("value is not null")
    path = F.create_map(*[F.lit(x) for pair in paths.items() for x in pair])
    return (good.select(key, *pick("buildings")), good.select(key, "house_number", *pick("units")), rows.withColumn("path", path[F.col("field_code")]),
            wide.filter("reason is not null").select(key, "reason"))
