"""Entity resolution (JN-1..8, 10, 29, 31; FLT-5, FLT-6, SRT-2, SRT-3).

Matches are counted on grouped keys: each side is reduced to (key, matches, smallest id) before it
is joined, so a key shared by very many masters never multiplies rows. Candidate rows themselves are
listed by ``candidate_pairs`` only for requests that a person has to decide.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import CONDOMINIUM_KINDS, DOCUMENT_KINDS
from ..functions.evidence import parcel_key
from ..functions.text import match_text, room_key
from .ordered import newest


def _grouped(masters: DataFrame, keys: list[str], id_col: str, tag: str) -> DataFrame:
    """(keys, count, smallest id) for masters whose keys are all filled."""
    filled = masters
    for k in keys:
        filled = filled.filter(F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    return filled.groupBy(*keys).agg(F.count_distinct(id_col).alias(f"_n_{tag}"), F.min(id_col).alias(f"_id_{tag}"))


def two_of_three(incoming: DataFrame, masters: DataFrame, keys: tuple[str, str, str], id_col: str,
                 out: str = "building") -> DataFrame:
    """JN-2: masters that agree on at least two of three filled keys.

    Adds ``<out>_matches`` and, when there is exactly one, ``<out>_id``. The three pair counts minus
    twice the full-agreement count is the number of distinct masters.
    """
    a, b, c = keys
    result = incoming
    for tag, on in (("ab", [a, b]), ("ac", [a, c]), ("bc", [b, c]), ("abc", [a, b, c])):
        result = result.join(_grouped(masters, on, id_col, tag), on, "left")
    pairs = [F.coalesce(F.col(f"_n_{t}"), F.lit(0)) for t in ("ab", "ac", "bc")]
    matches = pairs[0] + pairs[1] + pairs[2] - 2 * F.coalesce(F.col("_n_abc"), F.lit(0))
    best = F.coalesce(*[F.col(f"_id_{t}") for t in ("ab", "ac", "bc")])
    return (result.withColumn(f"{out}_matches", matches)
            .withColumn(f"{out}_id", F.when(matches == 1, best))
            .drop(*[f"_{p}_{t}" for p in ("n", "id") for t in ("ab", "ac", "bc", "abc")]))


def candidate_pairs(incoming: DataFrame, masters: DataFrame, keys: tuple[str, str, str], in_id: str, id_col: str) -> DataFrame:
    """JN-6: the candidates behind a match, one row each, from three equi-joins."""
    a, b, c = keys
    found = None
    for on in ([a, b], [a, c], [b, c]):
        side = masters.select(id_col, *on)
        for k in on:
            side = side.filter(F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
        hit = incoming.select(in_id, *on).join(side, on).select(in_id, id_col)
        found = hit if found is None else found.unionByName(hit)
    return found.dropDuplicates()


def match_unit_exact(incoming: DataFrame, units: DataFrame) -> DataFrame:
    """JN-1: units with the same house number."""
    grouped = _grouped(units, ["house_number"], "unit_id", "unit")
    joined = incoming.join(grouped, "house_number", "left")
    n = F.coalesce("_n_unit", F.lit(0))
    return (joined.withColumn("unit_matches", n).withColumn("unit_id", F.when(n == 1, F.col("_id_unit")))
            .drop("_n_unit", "_id_unit"))


def building_keys(df: DataFrame) -> DataFrame:
    """Folded location, parcel set and name of a building row."""
    return (df.withColumn("location_key", match_text(F.col("registry_location")))
            .withColumn("parcels_key", parcel_key(F.col("land_lots")))
            .withColumn("name_key", match_text(F.col("building_name"))))


BUILDING_KEYS = ("location_key", "parcels_key", "name_key")


def match_unit_by_room(incoming: DataFrame, units: DataFrame, buildings: DataFrame) -> DataFrame:
    """JN-3: units of the matched buildings with the same folded room name.

    Rooms take their building's keys, so the two-of-three count runs on rooms directly.
    """
    rooms = (units.select("unit_id", "building_id", F.col("unit_name").alias("_room"))
             .join(building_keys(buildings).select("building_id", *BUILDING_KEYS), "building_id")
             .withColumn("room_key", room_key(match_text(F.col("_room")))))
    asked = incoming.withColumn("room_key", room_key(match_text(F.col("unit_name"))))

    def roomed(df: DataFrame, keep: list[str]) -> DataFrame:
        cols = [F.when((F.col(k) != "") & (F.col("room_key") != ""), F.concat(F.col(k), F.lit("\u0004"), F.col("room_key"))).alias(f"_r_{k}")
                for k in BUILDING_KEYS]
        return df.select(*keep, *cols)

    keys = tuple(f"_r_{k}" for k in BUILDING_KEYS)
    asked = roomed(asked, incoming.columns)
    return two_of_three(asked, roomed(rooms, ["unit_id"]), keys, "unit_id", out="room").drop(*keys)


def match_entities(incoming: DataFrame, buildings: DataFrame, units: DataFrame, choice: DataFrame | None = None) -> DataFrame:
    """JOB-15: house number first, else two building keys plus the room; one status row per request.

    ``incoming``: incoming_id, property_type, house_number, unit_name, building_name, registry_location, land_lots.
    ``choice`` (incoming_id, selected_unit_id, selected_building_id) may only narrow the candidates found.
    """
    keyed = building_keys(incoming)
    by_house = match_unit_exact(keyed, units).withColumnsRenamed({"unit_matches": "_house_n", "unit_id": "_house_id"})
    by_building = two_of_three(by_house, building_keys(buildings), BUILDING_KEYS, "building_id")
    found = match_unit_by_room(by_building, units, buildings)
    by_number = F.col("_house_n") > 0
    found = (found
             .withColumn("unit_matches", F.when(by_number, F.col("_house_n")).otherwise(F.col("room_matches")))
             .withColumn("unit_id", F.when(by_number, F.col("_house_id")).otherwise(F.col("room_id")))
             .withColumn("building_matches", F.when(by_number, F.lit(0)).otherwise(F.col("building_matches")))
             .withColumn("building_id", F.when(~by_number, F.col("building_id"))))
    refused = F.lit(None).cast("string")
    if choice is not None:
        found, refused = _apply_choice(found, choice, buildings, units)
    owner = units.select(F.col("unit_id"), F.col("building_id").alias("_unit_building"))
    found = found.join(owner, "unit_id", "left")
    lots = F.col("land_lots")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    incomplete = (blank("house_number") | blank("unit_name") | blank("registry_location") | lots.isNull() | (F.size(lots) == 0)
                  | F.exists(lots, lambda l: (F.coalesce(l["location"], F.lit("")) == "") | (F.coalesce(l["lot_number"], F.lit("")) == "")))
    incomplete = F.coalesce(incomplete, F.lit(True))
    allowed = F.coalesce(F.col("property_type").isin(*CONDOMINIUM_KINDS), F.lit(False))
    status = (F.when(~allowed, "blocked").when(refused.isNotNull(), "blocked")
              .when(F.col("unit_matches") > 1, "ambiguous").when(F.col("unit_matches") == 1, "existing")
              .when(F.col("building_matches") > 1, "ambiguous").when(incomplete, "incomplete").otherwise("new"))
    reason = (F.when(~allowed, "property type not supported").when(refused.isNotNull(), refused)
              .when(F.col("unit_matches") > 1, "several units match")
              .when(F.col("unit_matches") == 1, F.lit(None))
              .when(F.col("building_matches") > 1, "several buildings match")
              .when(incomplete, "identity incomplete"))
    existing = F.col("unit_matches") == 1
    return found.select(
        "incoming_id", status.alias("status"), reason.alias("reason"),
        F.when(allowed & existing, F.col("unit_id")).alias("unit_id"),
        F.when(allowed, F.when(existing, F.col("_unit_building")).otherwise(F.col("building_id"))).alias("building_id"),
        "unit_matches", "building_matches")


def _apply_choice(found: DataFrame, choice: DataFrame, buildings: DataFrame, units: DataFrame):
    """JN-4: a chosen unit or building must be among the current candidates."""
    asked = found.join(choice, "incoming_id", "left")
    unit_side = (units.join(building_keys(buildings).select("building_id", *BUILDING_KEYS), "building_id")
                 .select(F.col("unit_id").alias("selected_unit_id"), F.col("house_number").alias("_s_house"),
                         room_key(match_text(F.col("unit_name"))).alias("_s_room"),
                         *[F.col(k).alias(f"_s_{k}") for k in BUILDING_KEYS]))
    building_side = building_keys(buildings).select(
        F.col("building_id").alias("selected_building_id"), *[F.col(k).alias(f"_b_{k}") for k in BUILDING_KEYS])
    asked = asked.join(unit_side, "selected_unit_id", "left").join(building_side, "selected_building_id", "left")

    def agree(prefix: str) -> Column:
        same = [F.when((F.col(k) != "") & (F.col(k) == F.col(f"{prefix}{k}")), 1).otherwise(0) for k in BUILDING_KEYS]
        return same[0] + same[1] + same[2] >= 2

    room = room_key(match_text(F.col("unit_name")))
    is_candidate = F.when(F.col("_house_n") > 0, F.col("_s_house") == F.col("house_number")).otherwise(
        agree("_s_") & (room != "") & (room == F.col("_s_room")))
    is_candidate = F.coalesce(is_candidate, F.lit(False))
    building_ok = F.coalesce(agree("_b_") & (F.col("unit_matches") == 0), F.lit(False))
    has_unit = F.coalesce(F.col("selected_unit_id").cast("string"), F.lit("")) != ""
    has_building = ~has_unit & (F.coalesce(F.col("selected_building_id").cast("string"), F.lit("")) != "")
    chosen = (asked
              .withColumn("_refused", F.when(has_unit & ~is_candidate, "chosen unit is not a candidate")
                          .when(has_building & ~building_ok, "chosen building is not a candidate"))
              .withColumn("unit_id", F.when(has_unit & is_candidate, F.col("selected_unit_id")).otherwise(F.col("unit_id")))
              .withColumn("unit_matches", F.when(has_unit & is_candidate, F.lit(1)).otherwise(F.col("unit_matches")))
              .withColumn("building_id", F.when(has_building & building_ok, F.col("selected_building_id")).otherwise(F.col("building_id")))
              .withColumn("building_matches", F.when(has_building & building_ok, F.lit(1)).otherwise(F.col("building_matches"))))
    return chosen, F.col("_refused")


def match_status(matches: Column) -> Column:
    """JN-5 on a plain count: none, one or several."""
    return F.when(matches == 0, "new").when(matches == 1, "existing").otherwise("ambiguous")


def open_cases(matched: DataFrame, cases: DataFrame) -> DataFrame:
    """JN-6: cases of each matched unit, one row per case; order by created_at when shown."""
    return matched.filter("unit_id is not null").select("incoming_id", "unit_id").join(
        cases.select("unit_id", "case_id", "case_status", "updated_at", "created_at"), "unit_id")


def identity_cascade(reports: DataFrame, units: DataFrame, tiers: list[tuple[str, list[str]]], id_col: str = "unit_id") -> DataFrame:
    """JN-7: explicit id, then unique house number, then a unique composite key.

    ``tiers`` = [(tier name, key columns)] in order; the first tier is the explicit id. An explicit id
    ends the cascade, found or not; several hits in a middle tier stop it too.
    """
    result = reports
    stop, answer, via = F.lit(False), F.lit(None), F.lit(None)
    for i, (tier, keys) in enumerate(tiers):
        grouped = _grouped(units, keys, id_col, tier)
        asked = F.lit(True)
        for k in keys:
            asked = asked & (F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
        result = result.withColumn(f"_asked_{tier}", asked).join(
            grouped.withColumnsRenamed({k: f"_g_{tier}_{k}" for k in keys}),
            _all_equal([(F.col(k), F.col(f"_g_{tier}_{k}")) for k in keys]), "left").drop(*[f"_g_{tier}_{k}" for k in keys])
        n = F.coalesce(F.col(f"_n_{tier}"), F.lit(0))
        here = F.col(f"_asked_{tier}") & ~stop
        answer = F.when(answer.isNull() & here & (n == 1), F.col(f"_id_{tier}")).otherwise(answer)
        via = F.when(via.isNull() & here & (n == 1), F.lit(tier)).otherwise(via)
        closes = F.col(f"_asked_{tier}") if i == 0 else F.col(f"_asked_{tier}") & (n >= 1)
        stop = stop | (here & closes)
    found = result.withColumn("resolved_id", answer).withColumn("resolved_by", via)
    return found.drop(*[f"_{p}_{t}" for p in ("n", "id", "asked") for t, _ in tiers])


def _all_equal(pairs) -> Column:
    test = F.lit(True)
    for left, right in pairs:
        test = test & (left == right)
    return test


def match_building_strict(incoming: DataFrame, buildings: DataFrame) -> DataFrame:
    """JN-8: same folded location and the same ordered parcel list; several hits are refused."""
    def keyed(df: DataFrame) -> DataFrame:
        lots = F.array_sort(F.transform(F.col("land_lots"), lambda l: F.struct(l["location"].alias("a"), l["lot_number"].alias("b"))))
        return df.withColumn("_loc", match_text(F.col("registry_location"))).withColumn(
            "_lots", F.array_join(F.transform(lots, lambda l: F.concat_ws("\u0002", l["a"], l["b"])), "\u0003"))
    grouped = _grouped(keyed(buildings), ["_loc", "_lots"], "building_id", "b")
    joined = keyed(incoming).join(grouped, ["_loc", "_lots"], "left")
    n = F.coalesce("_n_b", F.lit(0))
    return (joined.withColumn("building_matches", n).withColumn("building_id", F.when(n == 1, F.col("_id_b")))
            .withColumn("reason", F.when(n > 1, "ambiguous building")).drop("_loc", "_lots", "_n_b", "_id_b"))


def known_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """JN-10: per request, are its hashes stored and for which unit; more than one unit stops it.

    ``files``: request_id, file_hash; ``stored``: file_hash, unit_id.
    """
    pairs = stored.filter("unit_id is not null").select("file_hash", "unit_id").dropDuplicates()
    linked = files.select("request_id", "file_hash").join(pairs, "file_hash", "left")
    summary = linked.groupBy("request_id").agg(
        F.count_distinct("file_hash").alias("files"),
        F.count_distinct(F.when(F.col("unit_id").isNotNull(), F.col("file_hash"))).alias("known"),
        F.count_distinct("unit_id").alias("units"), F.min("unit_id").alias("_unit"))
    return (summary.withColumn("unit_id", F.when(F.col("units") == 1, F.col("_unit"))).drop("_unit")
            .withColumn("status", F.when(F.col("units") > 1, "conflict")
                        .when((F.col("known") == F.col("files")) & (F.col("units") == 1), "cached").otherwise("missing")))


def find_or_create(requests: DataFrame, buildings: DataFrame, units: DataFrame, cases: DataFrame) -> DataFrame:
    """JN-29: reuse or create building (by location), unit (by house number) and open case."""
    b = _grouped(buildings, ["registry_location"], "building_id", "b")
    u = (units.filter(F.coalesce(F.col("house_number"), F.lit("")) != "").groupBy("house_number")
         .agg(F.count_distinct("unit_id").alias("_n_u"), F.min("unit_id").alias("_id_u"),
              F.min_by("building_id", "unit_id").alias("_u_building")))
    open_ = open_case(cases).select(F.col("unit_id").alias("_id_u"), F.col("case_id").alias("_case"))
    joined = requests.join(b, "registry_location", "left").join(u, "house_number", "left").join(open_, "_id_u", "left")
    n_b, n_u = F.coalesce("_n_b", F.lit(0)), F.coalesce("_n_u", F.lit(0))
    blank = F.lit(False)
    for c in ("building_name", "unit_name", "registry_location", "house_number"):
        blank = blank | (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    crossed = (n_u >= 1) & ~F.coalesce(F.col("_u_building") == F.col("_id_b"), F.lit(False))
    outcome = (F.when(blank, "input").when((n_b > 1) | crossed, "ambiguous")
               .when(n_b == 0, "create_building").when(n_u == 0, "create_unit")
               .when(F.col("_case").isNull(), "create_case").otherwise("reuse"))
    settled = ~outcome.isin("input", "ambiguous")
    return joined.select(*requests.columns, outcome.alias("outcome"),
                         F.when(settled & (n_b == 1), F.col("_id_b")).alias("building_id"),
                         F.when(settled & (n_u >= 1), F.col("_id_u")).alias("unit_id"),
                         F.when(settled & (n_u >= 1), F.col("_case")).alias("case_id"))


def open_case(cases: DataFrame) -> DataFrame:
    """SRT-2: the newest case of a unit that is not completed."""
    live = cases.filter(F.coalesce(F.col("case_status"), F.lit("")) != "completed")
    return newest(live, ["unit_id"], [F.desc_nulls_last("updated_at"), F.asc("case_id")])


def missing_open_cases(units: DataFrame, cases: DataFrame) -> DataFrame:
    """SRT-2: units that need a new draft case."""
    live = cases.filter(F.coalesce(F.col("case_status"), F.lit("")) != "completed")
    return units.select("unit_id").join(live, "unit_id", "left_anti").withColumn("case_status", F.lit("draft"))


def ambiguous_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """SRT-3: keys that more than one row answers to."""
    return df.groupBy(*keys).count().filter("count > 1").withColumnRenamed("count", "rows")


def resolve_case_refs(refs: DataFrame, cases: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-31: a reference is a case id or ``unit-<id>``; returns (resolved, rejects)."""
    by_unit = (refs.filter(F.col("ref").startswith("unit-")).withColumn("unit_id", F.expr("substring(ref, 6)"))
               .join(units.select(F.col("unit_id").cast("string").alias("unit_id"), "building_id"), "unit_id")
               .select("ref", F.lit(None).cast("string").alias("case_id"), "unit_id", "building_id"))
    by_case = (refs.filter(~F.col("ref").startswith("unit-"))
               .join(cases.select(F.col("case_id").cast("string").alias("ref"), F.col("unit_id").cast("string").alias("unit_id")), "ref")
               .join(units.select(F.col("unit_id").cast("string").alias("unit_id"), "building_id"), "unit_id")
               .select("ref", F.col("ref").alias("case_id"), "unit_id", "building_id"))
    resolved = by_unit.unionByName(by_case)
    return resolved, refs.join(resolved, "ref", "left_anti")


# ---- fixed values: title and file-name patterns of each document kind, in order ---------------
TITLE_RULES = [
    ("text", r"履歴事項全部証明書|現在事項全部証明書|商号", "other"),
    ("text", r"調査報告書|管理に係る.{0,3}重要事項", "report"),
    ("text", r"重要事項説明書", "purchase"),
    ("text", r"全部事項証明書|表題部|権利部[（(]甲区", "registry"),
    ("rules", r"管理規約|使用細則", "rules"),
    ("zoning", r"用途地域|都市計画情報", "zoning"),
]
ARTICLE_ONE = r"第[1１一]条"
ZONING_NOTE = r"この図は本区の都市計画に関する証明ではありません|(?i)wagmap"
NAME_RULES = [
    (r"会社|商業|法人|委任状|依頼|申込|長期修繕|図面|台帳", "other"),
    (r"重調|調査報告", "report"),
    (r"重説|重要事項説明", "purchase"),
    (r"謄本|登記|全部事項", "registry"),
    (r"規約|細則", "rules"),
    (r"用途地域|都市計画", "zoning"),
]
# -----------------------------------------------------------------------------------------------


def title_flags(pages: DataFrame, key: str = "file_hash", head_chars: int | None = None) -> DataFrame:
    """SRT-4: per file, which title patterns its pages show (flags t0, t1, ... in the order of ``TITLE_RULES``).

    Every page is read. ``head_chars`` restricts where the first page counts as head; by default all of it does.
    """
    from ..functions.text import strip_spaces
    text = strip_spaces(F.coalesce("text", F.lit("")))
    first = F.col("page_no") == 1
    head = F.substring(text, 1, head_chars) if head_chars else text
    flags = []
    for i, (scope, pattern, _) in enumerate(TITLE_RULES):
        seen = F.bool_or(text.rlike(pattern)) if scope == "text" else F.bool_or(first & head.rlike(pattern))
        if scope == "rules":
            seen = seen & F.bool_or(text.rlike(ARTICLE_ONE))
        elif scope == "zoning":
            seen = seen | F.bool_or(text.rlike(ZONING_NOTE))
        flags.append(seen.alias(f"t{i}"))
    return pages.groupBy(key).agg(*flags)


def title_kind() -> Column:
    """The kind of the first title pattern that a file shows, from its flags."""
    kind = F.lit(None).cast("string")
    for i, (_, _, name) in reversed(list(enumerate(TITLE_RULES))):
        kind = F.when(F.col(f"t{i}"), name).otherwise(kind)
    return kind


def name_kind(name: Column) -> Column:
    kind = F.lit(None).cast("string")
    for pattern, value in reversed(NAME_RULES):
        kind = F.when(name.rlike(pattern), value).otherwise(kind)
    return kind


def settle_kind(by_text: Column, by_name: Column, supported: tuple[str, ...] = DOCUMENT_KINDS) -> Column:
    """Two signals that disagree, or an unsupported kind, give null."""
    kind = F.coalesce(by_text, by_name)
    clash = by_text.isNotNull() & by_name.isNotNull() & (by_text != by_name)
    return F.when(~clash & kind.isin(*supported), kind)


def classify(files: DataFrame, pages: DataFrame, head_chars: int | None = None) -> DataFrame:
    """FLT-5: kind of each file from the titles on its pages and its name."""
    joined = files.join(title_flags(pages, head_chars=head_chars), "file_hash", "left")
    return joined.withColumn("kind", settle_kind(title_kind(), name_kind(F.col("name")))).drop(*[f"t{i}" for i in range(len(TITLE_RULES))])


def route_kinds(kinds: DataFrame, choices: DataFrame, active: tuple[str, ...]) -> DataFrame:
    """FLT-6: route of each file: selected, excluded, skipped or unknown. ``choices``: file_hash, chosen."""
    kind = F.coalesce(F.col("chosen"), F.col("kind"))
    route = (F.when(kind == "skip", "skipped").when(kind.isin(*active), "selected")
             .when(kind.isin(*DOCUMENT_KINDS), "excluded").otherwise("unknown"))
    return kinds.join(choices, "file_hash", "left").withColumn("route", route).drop("chosen")


def upload_batches(files: DataFrame, has_case: bool) -> DataFrame:
    """SET-5: for a new mixed upload, disclosures go first. ``files``: job_id, kind, ..."""
    if has_case:
        return files.withColumn("batch", F.lit(1))
    mixed = files.groupBy("job_id").agg((F.bool_or(F.col("kind") == "purchase") & F.bool_or(~F.col("kind").eqNullSafe(F.lit("purchase")))).alias("_mixed"))
    return files.join(mixed, "job_id").withColumn(
        "batch", F.when(F.col("_mixed") & ~F.col("kind").eqNullSafe(F.lit("purchase")), 2).otherwise(1)).drop("_mixed")
