"""JOB-1 and JOB-3 for ruled ledger text: segmented lines to field rows with evidence.

Every value is a row (file_hash, path, value, sources, needs_review); documents are never nested.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import ERA_DATE
from ..functions.text import arabic_numerals, has_gaiji, nfkc_compact, old_numerals, parse_area, split_place, split_places
from ..operators.ordered import row_numbers
from ..operators.segment import carry_labels, labelled_values, last_filled, records, segment_records
from ..session import cut_lineage
from . import ledger

# ---- fixed values -----------------------------------------------------------------------------------
CAPTION = r"^(?:[1①]?(?:順位番号|土地の符号|種類|構造|地番)|1構造|1種類|1土地の符号|1地番)"
FLOOR_AREA = r"((?:地下)?\d+階)(?:部分)?([\d,]+):(\d{2})"
LAND_CATEGORIES = ("宅地", "田", "畑", "山林", "雑種地", "公衆用道路", "原野", "境内地", "墓地", "池沼", "水道用地",
                   "用悪水路", "保安林", "学校用地", "鉄道用地", "井溝", "堤", "牧場", "塩田", "鉱泉地", "ため池", "ダム", "公園")
LIEN_AMOUNT = r"(?:債権額|極度額)(金[\d,]+(?:億)?(?:[\d,]+)?万?円)"
LABEL_PATHS = {
    ("building", "建物の名称"): "building.name",
    ("unit", "家屋番号"): "unit.house_number",
    ("unit", "建物の名称"): "unit.name",
}
MAX_PARCELS = 6
# -----------------------------------------------------------------------------------------------------

SOURCES = "array<struct<page:int,text:string>>"
FIELD_COLUMNS = ["file_hash", "path", "value", "sources", "needs_review"]


def sources_of(lines: Column) -> Column:
    return F.transform(lines, lambda l: F.struct(l["page"].cast("int").alias("page"), l["raw"].alias("text")))


def _rows(df: DataFrame, *leaves: tuple[Column, Column, Column]) -> DataFrame:
    """Field rows of several (path, value, sources) leaves in one pass over ``df``."""
    each = F.explode(F.array(*[F.struct(p.alias("path"), v.cast("string").alias("value"), s.cast(SOURCES).alias("sources")) for p, v, s in leaves]))
    return df.select("file_hash", each.alias("_f")).select("file_hash", "_f.*").filter(F.coalesce("value", F.lit("")) != "")


def _cell(i: int) -> Column:
    return F.try_element_at(F.col("cells"), F.lit(i + 1))


def body_rows(recs: DataFrame, section: str, width: int) -> DataFrame:
    """Data rows of a section: no headings, no column captions."""
    return recs.filter((F.col("section") == section) & ~F.col("heading") & (F.col("width") == width) & ~_cell(0)["text"].rlike(CAPTION))


def _area_number(whole: Column, cents: Column) -> Column:
    text = F.concat(F.replace(whole, F.lit(","), F.lit("")), F.lit("."), cents).try_cast("decimal(18,2)")
    return text.cast("string")


def prepare_lines(lines: DataFrame) -> DataFrame:
    """Old positional kanji numerals become arabic in every line of a file that prints any."""
    old = lines.groupBy("file_hash").agg(F.bool_or(old_numerals(F.col("text"))).alias("old_numerals"))
    joined = lines.join(old, "file_hash")
    return joined.withColumn("text", F.when(F.col("old_numerals"), arabic_numerals(F.col("text"))).otherwise(F.col("text")))


def section_kinds(recs: DataFrame) -> DataFrame:
    """Document type of each file from the headings it has."""
    has = lambda s: F.bool_or(F.col("section") == s)
    found = recs.groupBy("file_hash").agg(has("unit").alias("unit"), has("land").alias("land"), has("house").alias("house"), has("land_right").alias("rights"))
    kind = F.when(F.coalesce("unit", F.lit(False)), "unit").when(F.coalesce("land", F.lit(False)), "land").when(F.coalesce("house", F.lit(False)), "house").otherwise("unknown")
    return found.select("file_hash", kind.alias("kind"), F.coalesce("rights", F.lit(False)).alias("has_right_section"))


def _last_rows(rows: DataFrame, columns: dict[str, Column], paths: dict[str, str]) -> DataFrame:
    """Each column's last valid entry as field rows. Column structs hold ``value`` and ``lines``."""
    last = last_filled(rows, ["file_hash"], "record_id", columns)
    return _rows(last, *[(F.lit(path), F.col(f"{name}.value"), sources_of(F.col(f"{name}.lines"))) for name, path in paths.items()])


def _valued(value: Column, cell: Column, ok: Column | None = None) -> Column:
    keep = value.isNotNull() & (value.cast("string") != "")
    return F.when(keep if ok is None else keep & ok, F.struct(value.cast("string").alias("value"), cell["lines"].alias("lines")))


def label_fields(labelled: DataFrame) -> DataFrame:
    """Values printed next to a label: names, house number and the location with its lots."""
    split = labelled.withColumn("_p", F.when(F.col("label") == "所在", split_places(F.col("value"))))
    split = (split.withColumn("_places", F.array_distinct(F.transform("_p", lambda p: p["place"])))
             .withColumn("_lots", F.filter(F.transform("_p", lambda p: p["lot"]), lambda l: l.isNotNull())))
    one_place = F.size("_places") == 1
    location = F.when(one_place, F.try_element_at("_places", F.lit(1))).otherwise(F.array_join(F.transform("_p", lambda p: p["place"]), "\n"))
    lots = F.when(one_place, F.array_join("_lots", "、")).otherwise(F.array_join(F.transform("_p", lambda p: F.coalesce(p["lot"], F.lit(""))), "\n"))
    at = lambda section, label: (F.col("section") == section) & (F.col("label") == label)
    src = sources_of(F.col("lines"))
    leaves = [(F.lit(path), F.when(at(section, label), F.col("value")), src) for (section, label), path in LABEL_PATHS.items()]
    leaves += [(F.lit("building.location"), F.when(at("building", "所在"), location), src),
               (F.lit("building.lot_number"), F.when(at("building", "所在"), lots), src),
               (F.lit("lands.0.location"), F.when(at("land", "所在"), F.col("value")), src)]
    return _rows(split, *leaves)


def title_fields(recs: DataFrame) -> DataFrame:
    """Building and unit title columns still in effect."""
    building = body_rows(recs, "building", 3)
    structure, floors = _cell(0), _cell(1)
    out = _last_rows(building, {"structure": _valued(structure["current"], structure, F.contains(structure["current"], F.lit("造")))},
                     {"structure": "building.structure"}).unionByName(_floor_rows(building, floors))
    unit = body_rows(recs, "unit", 4)
    kind, build, area, cause = (_cell(i) for i in range(4))
    floor = F.regexp_extract(area["current"], FLOOR_AREA, 1)
    size = _area_number(F.regexp_extract(area["current"], FLOOR_AREA, 2), F.regexp_extract(area["current"], FLOOR_AREA, 3))
    date = F.nullif(F.regexp_extract(cause["current"], f"({ERA_DATE})新築", 1), F.lit(""))
    return out.unionByName(_last_rows(unit, {
        "type": _valued(kind["current"], kind, ~kind["struck"]),
        "structure": _valued(build["current"], build, F.contains(build["current"], F.lit("造"))),
        "floor": _valued(floor, area), "area": _valued(size, area, floor != ""), "built": _valued(date, cause)},
        {"type": "unit.type", "structure": "unit.structure", "floor": "unit.floor", "area": "unit.registered_area", "built": "unit.built_date"}))


def _floor_rows(building: DataFrame, floors: Column) -> DataFrame:
    """Floor areas of the last record that lists any."""
    listed = building.withColumn("_floors", floors["lines"]).withColumn("_hits", F.flatten(F.transform("_floors", lambda l: F.transform(
        F.regexp_extract_all(l["text"], F.lit(f"({FLOOR_AREA})"), 1), lambda m: F.struct(m.alias("m"), l["page"].alias("page"), l["raw"].alias("raw"))))))
    last = listed.filter(F.size("_hits") > 0).groupBy("file_hash").agg(F.max_by("_hits", "record_id").alias("_hits"))
    each = last.select("file_hash", F.posexplode("_hits").alias("_i", "_h"))
    text = F.col("_h.m")
    sources = F.array(F.struct(F.col("_h.page").cast("int").alias("page"), F.col("_h.raw").alias("text")))
    path = lambda part: F.concat(F.lit("building.floor_areas."), F.col("_i"), F.lit(f".{part}"))
    area = _area_number(F.regexp_extract(text, FLOOR_AREA, 2), F.regexp_extract(text, FLOOR_AREA, 3))
    return _rows(each, (path("floor"), F.regexp_extract(text, FLOOR_AREA, 1), sources), (path("area"), area, sources))


def site_parcels(recs: DataFrame) -> DataFrame:
    """Parcels of the site, keyed by their symbol, each column's last entry, with the rights that name them."""
    rows = body_rows(recs, "site", 5)
    symbol, place, category, area = (_cell(i) for i in range(4))
    rows = rows.withColumn("symbol", F.when(symbol["current"] != "", symbol["current"]).otherwise(symbol["text"])).withColumn("_place", split_place(place["current"]))
    size = parse_area(area["current"]).cast("decimal(18,2)")
    has_place = place["current"] != ""
    merged = last_filled(rows, ["file_hash", "symbol"], "record_id", {
        "location": _valued(F.col("_place.place"), place, has_place), "lot_number": _valued(F.col("_place.lot"), place, has_place),
        "category": _valued(category["current"], category), "area": _valued(size, area), "_first": F.when(F.lit(True), F.struct(F.col("page_no"), symbol["all_lines"].alias("lines")))})
    first = rows.groupBy("file_hash", "symbol").agg(F.min("record_id").alias("first_record"), F.min("page_no").alias("page_no"))
    parcels = row_numbers(merged.join(first, ["file_hash", "symbol"]), ["file_hash"], F.col("page_no"), ["first_record"], "_no").withColumn("parcel_no", (F.col("_no") - 1).cast("int"))

    right_rows = body_rows(recs, "land_right", 4)
    mark, kind, share = _cell(0), _cell(1), _cell(2)
    rights = right_rows.filter(~kind["struck"] & (kind["current"] != "")).select(
        "file_hash", "record_id", F.explode(F.split(mark["current"], "[・、]")).alias("symbol"),
        F.struct(kind["current"].alias("value"), kind["lines"].alias("lines")).alias("right_type"),
        F.struct(share["current"].alias("value"), share["lines"].alias("lines")).alias("right_share"))
    named = rights.groupBy("file_hash", "symbol").agg(F.max_by(F.struct("right_type", "right_share"), "record_id").alias("_r"))
    return parcels.join(named, ["file_hash", "symbol"], "left").withColumn("right_type", F.col("_r.right_type")).withColumn("right_share", F.col("_r.right_share"))


def parcel_fields(parcels: DataFrame) -> DataFrame:
    path = lambda part: F.concat(F.lit("lands."), F.col("parcel_no"), F.lit(f".{part}"))
    leaves = [(path(part), F.col(f"{part}.value"), sources_of(F.col(f"{part}.lines")))
              for part in ("location", "lot_number", "category", "area", "right_type", "right_share")]
    return _rows(parcels, (path("identifier"), F.col("symbol"), sources_of(F.col("_first.lines"))), *leaves)


def land_right_fields(recs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Whether a land right exists and its common type and share; a complete unit document without the section has none."""
    kind, share = _cell(1), _cell(2)
    rows = body_rows(recs, "land_right", 4).filter(~kind["struck"] & (kind["current"] != "")).select(
        "file_hash", "record_id", kind["current"].alias("k"), kind["lines"].alias("kl"), share["current"].alias("s"), share["lines"].alias("sl"))
    g = rows.groupBy("file_hash").agg(F.count_distinct("k").alias("_nk"), F.count_distinct("s").alias("_ns"),
                                      F.min_by(F.struct("k", "kl", "s", "sl"), "record_id").alias("_f"))
    kind_src = sources_of(F.col("_f.kl"))
    out = _rows(g, (F.lit("land_right.exists"), F.lit("true"), kind_src), (F.lit("land_right.type"), F.when(F.col("_nk") == 1, F.col("_f.k")), kind_src),
                (F.lit("land_right.share"), F.when(F.col("_ns") == 1, F.col("_f.s")), sources_of(F.col("_f.sl"))))
    absent = kinds.filter("kind = 'unit' and not has_right_section").join(g.select("file_hash"), "file_hash", "left_anti")
    return out.unionByName(_rows(absent, (F.lit("land_right.exists"), F.lit("false"), F.array(F.struct(F.lit(1).alias("page"), F.lit("専有部分の建物の表示").alias("text"))))))


def land_title_fields(recs: DataFrame) -> DataFrame:
    """A land document: one parcel, each column's last valid modification."""
    lot, category, area = _cell(0), _cell(1), _cell(2)
    size = parse_area(area["current"]).cast("decimal(18,2)")
    return _last_rows(body_rows(recs, "land", 4), {
        "lot": _valued(lot["current"], lot, lot["current"].rlike(r"^\d+番\d*$")),
        "category": _valued(category["current"], category, category["current"].isin(*LAND_CATEGORIES)), "area": _valued(size, area)},
        {"lot": "lands.0.lot_number", "category": "lands.0.category", "area": "lands.0.area"})


def type_fields(kinds: DataFrame) -> DataFrame:
    title = F.when(F.col("kind") == "unit", "専有部分の建物の表示").when(F.col("kind") == "house", "主である建物の表示").when(F.col("kind") == "land", "土地の表示")
    source = F.array(F.struct(F.lit(1).alias("page"), title.alias("text")))
    doc = F.when(F.col("kind").isin("unit", "house"), "building").otherwise(F.col("kind"))
    prop = F.when(F.col("kind") == "land", "land_only").when(F.col("kind") == "house", "detached_house")
    return _rows(kinds, (F.lit("document_type"), doc, source), (F.lit("property_type"), prop, source))


def owner_entries(recs: DataFrame) -> DataFrame:
    rank, purpose, detail = _cell(0), _cell(1), _cell(3)
    return body_rows(recs, "A", 4).select("file_hash", F.col("record_id").alias("ord"), rank["current"].alias("rank"),
                                          purpose["current"].alias("purpose"), purpose["struck"].alias("struck"), detail["lines"].alias("lines"))


def lien_state(recs: DataFrame) -> DataFrame:
    """JOB-3, ruled text: a lien whose purpose is struck was cancelled."""
    rank, purpose, detail = _cell(0), _cell(1), _cell(3)
    text = detail["text"]
    current = F.when(detail["current"] != "", detail["current"]).otherwise(text)
    part = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    rows = body_rows(recs, "B", 4).filter(F.contains(purpose["text"], F.lit("抵当権設定")))
    liens = rows.select(
        "file_hash", "page_no", "record_id", rank["text"].alias("rank"), purpose["text"].alias("kind"), (~purpose["struck"]).alias("active"),
        part(current, LIEN_AMOUNT).alias("amount"), part(text, r"債務者(.+?)(?=(?:根)?抵当権者|$)").alias("debtor"),
        part(text, r"(?:(?:根)?抵当権者|権利者)(.+?)(?=共同担保|順位|$)").alias("creditor"), detail["all_lines"].alias("lines"), purpose["all_lines"].alias("purpose_lines"))
    return row_numbers(liens, ["file_hash"], F.col("page_no"), ["record_id"], "_no").withColumn("lien_no", (F.col("_no") - 1).cast("int")).drop("_no")


def lien_fields(liens: DataFrame) -> DataFrame:
    leaves = [(F.concat(F.lit("mortgages."), F.col("lien_no"), F.lit(f".{part}")), F.col(part),
               sources_of(F.col("purpose_lines" if part in ("rank", "kind", "active") else "lines")))
              for part in ("rank", "kind", "active", "amount", "debtor", "creditor")]
    return _rows(liens, *leaves)


def leasehold_fields(recs: DataFrame) -> DataFrame:
    """The first lease-type right of section B that is still in effect."""
    purpose = _cell(1)
    kind = F.when(F.contains(purpose["current"], F.lit("地上権設定")), "地上権").when(F.contains(purpose["current"], F.lit("賃借権設定")), "賃借権")
    rows = body_rows(recs, "B", 4).filter(~purpose["struck"]).select("file_hash", "record_id", kind.alias("k"), purpose["lines"].alias("lines")).filter("k is not null")
    first = rows.groupBy("file_hash").agg(F.min_by(F.struct("k", "lines"), "record_id").alias("_f"))
    src = sources_of(F.col("_f.lines"))
    return _rows(first, (F.lit("leasehold.exists"), F.lit("true"), src), (F.lit("leasehold.type"), F.col("_f.k"), src),
                 (F.lit("tenure_type"), F.lit("leasehold"), src))


def holder_fields(holders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Owners one by one, and the joined owner fields when nothing about them is open."""
    none = F.array().cast(SOURCES)
    out = _rows(holders, *[(F.concat(F.lit("owners."), F.col("holder_no"), F.lit(f".{part}")), F.col(part), none)
                           for part in ("name", "address", "share", "corporate_number", "rank")])
    sure = holders.join(reviews.filter("path = 'owners'"), "file_hash", "left_anti")
    # The joined text is one field value; it is as long as the document's list of current owners.
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("holder_no", F.col(c).alias("v")))), lambda x: x["v"]), "\n")
    g = sure.groupBy("file_hash").agg(lines("name").alias("name"), lines("address").alias("address"), F.bool_and(F.coalesce("address", F.lit("")) != "").alias("_all"))
    return out.unionByName(_rows(g, (F.lit("owner.name"), F.col("name"), none), (F.lit("owner.address"), F.when(F.col("_all"), F.col("address")), none)))


def registry_extract(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JOB-1: (field rows, review paths, warnings) of ruled ledger lines.

    Struck text never becomes a value. ``lines``: file_hash, page_no, line_no, text, flags. Records and
    current owners are checkpointed, since many fields are read from them.
    """
    prepared = prepare_lines(lines)
    recs = cut_lineage(records(segment_records(prepared.drop("old_numerals"))))
    kinds = lines.select("file_hash").distinct().join(section_kinds(recs), "file_hash", "left").na.fill({"kind": "unknown", "has_right_section": False})
    typed = recs.join(kinds.select("file_hash", "kind"), "file_hash")
    unit_recs, land_recs = typed.filter("kind = 'unit'"), typed.filter("kind = 'land'")
    parcels = site_parcels(unit_recs)
    holders, owner_reviews, notes = ledger.ownership_replay(owner_entries(recs))
    holders, owner_reviews = cut_lineage(holders), cut_lineage(owner_reviews)
    fields = type_fields(kinds)
    for part in (label_fields(labelled_values(carry_labels(typed.filter("kind in ('unit', 'land')")))), title_fields(unit_recs), parcel_fields(parcels),
                 land_right_fields(unit_recs, kinds), land_title_fields(land_recs), holder_fields(holders, owner_reviews), lien_fields(lien_state(recs)), leasehold_fields(recs)):
        fields = fields.unionByName(part)
    closed = lines.filter("page_no = 1").groupBy("file_hash").agg(F.bool_or(F.contains(nfkc_compact(F.col("text")), F.lit("閉鎖"))).alias("_c")).filter("_c")
    known = owner_reviews.unionByName(closed.select("file_hash", F.lit("document_type").alias("path"))).dropDuplicates().withColumn("_r", F.lit(True))
    fields = (fields.join(known, ["file_hash", "path"], "left")
              .withColumn("needs_review", F.coalesce("_r", F.lit(False)) | has_gaiji(F.col("value"))).drop("_r"))
    odd = fields.filter(has_gaiji(F.col("value")))
    reviews = known.drop("_r").unionByName(odd.select("file_hash", "path")).dropDuplicates()
    many = parcels.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_PARCELS)
    old = prepared.filter("old_numerals").select("file_hash").distinct()
    warnings = (notes.unionByName(many.select("file_hash", F.concat(F.lit("parcels beyond the form: "), F.col("n")).alias("warning")))
                .unionByName(closed.select("file_hash", F.lit("possibly a closed record").alias("warning")))
                .unionByName(old.select("file_hash", F.lit("old kanji numerals were read as digits").alias("warning")))
                .unionByName(odd.select("file_hash", F.concat(F.col("path"), F.lit(": untranscribable character")).alias("warning")))
                .unionByName(kinds.filter("kind = 'unknown'").select("file_hash", F.lit("title part not recognised").alias("warning"))))
    return fields, reviews, warnings
