"""Matching, registration, adoption policies, views, sources and sinks on small fixtures."""
import datetime as dt
import json

from pyspark.sql import functions as F, types as T

from shirube import schemas
from shirube.catalog import load_catalog
from shirube.operators import adopt, aggregates, resolve, versions, views
from shirube.operators.ordered import Last, Running, row_numbers, scan
from shirube.plans import store as S
from shirube.sources import sinks, tables

LOT = [("海区 見本", "7番・1", None, None)]
B = [("b1", "見本ハイツ", "海区見本", None, None, None, LOT, None), ("b2", "別館", "海区見本", None, None, None, [("海区見本", "9番", None, None)], None), ("b3", "見本ハイツ", "山区", None, None, None, LOT, None)]


def unit(i, b, house, room, **kw):
    row = dict.fromkeys(f.name for f in T.StructType.fromDDL(schemas.UNITS))
    row.update(unit_id=i, building_id=b, house_number=house, unit_name=room, **kw)
    return tuple(row.values())


def masters(spark):
    units = [unit("u1", "b1", "h1", "101号室"), unit("u2", "b1", "h2", "102"), unit("u3", "b3", "h3", "102号室"), unit("u4", "b2", "dup", "1"), unit("u5", "b2", "dup", "2")]
    return spark.createDataFrame(B, schemas.BUILDINGS), spark.createDataFrame(units, schemas.UNITS)


def test_matching_never_guesses(spark):
    buildings, units = masters(spark)
    lots = "array<struct<location:string,lot_number:string>>"
    kind = "condominium_land_right"
    ask = [("exact", kind, "h1", "x", "?", "?", None), ("room", kind, "new", "101", "見本ハイツ", "海区見本", [("海区見本", "7番1")]), ("two", kind, "new", "102", "見本ハイツ", "空", [("海区見本", "7番1")]),
           ("dup", kind, "dup", "9", "?", "?", None), ("fresh", kind, "new", "5", "新館", "川区", [("川区", "1番")]), ("short", kind, "new", None, "新館", "川区", None),
           ("house", "detached_house", "h1", "x", "?", "?", None), ("one", kind, "new", "7", "見本ハイツ", "空", [("空", "8番")])]
    incoming = spark.createDataFrame(ask, f"incoming_id string, property_type string, house_number string, unit_name string, building_name string, registry_location string, land_lots {lots}")
    got = {r.incoming_id: (r.status, r.unit_id, r.building_id) for r in resolve.match_entities(incoming, buildings, units).collect()}
    assert got["exact"] == ("existing", "u1", "b1") and got["room"] == ("existing", "u1", "b1")
    assert got["two"][0] == "ambiguous" and got["dup"][0] == "ambiguous" and got["dup"][1] is None
    assert got["fresh"] == ("new", None, None) and got["short"][0] == "incomplete" and got["house"][0] == "blocked" and got["one"] == ("new", None, None)
    choice = spark.createDataFrame([("two", "u3", None), ("dup", "u1", None)], "incoming_id string, selected_unit_id string, selected_building_id string")
    got = {r.incoming_id: (r.status, r.unit_id) for r in resolve.match_entities(incoming, buildings, units, choice).collect()}
    assert got["two"] == ("existing", "u3") and got["dup"][0] == "blocked"
    keyed = resolve.building_keys(incoming)
    pairs = resolve.candidate_pairs(keyed, resolve.building_keys(buildings), resolve.BUILDING_KEYS, "incoming_id", "building_id")
    assert {(r.incoming_id, r.building_id) for r in pairs.collect()} == {("room", "b1"), ("room", "b3"), ("two", "b1"), ("two", "b3")}


def test_registration_is_idempotent(spark):
    buildings, units = masters(spark)
    empty = {n: spark.createDataFrame([], d) for n, d in schemas.STORE.items()}
    stored = {**empty, "buildings": buildings, "units": spark.createDataFrame([unit("u1", "b1", "h1", "101", current_owner_name="旧主", registered_area=None)], schemas.UNITS)}
    req = "incoming_id string, request_key string, expected_status string, expected_unit_id string, expected_building_id string, case_mode string, resume_case_id string"
    requests = spark.createDataFrame([("a", "k1", "existing", "u1", "b1", "new", None), ("n", "k2", "new", None, None, "new", None), ("m", "k3", "existing", "u9", "b1", "new", None)], req)
    matched = spark.createDataFrame([("a", "existing", "u1", "b1"), ("n", "new", None, None), ("m", "existing", "u1", "b1")], "incoming_id string, status string, unit_id string, building_id string")
    val = "incoming_id string, file_hash string, original_filename string, field_code string, value_json string, confidence double, page_no int, source_text string, needs_review boolean"
    values = spark.createDataFrame([("a", "f1", "x.pdf", "current_owner_name", '"新主"', 1.0, 1, "新主", False), ("n", "f2", "y.pdf", "current_owner_name", '"甲"', 1.0, 1, "甲", False)], val)
    master = values.select("incoming_id", "field_code", "value_json")
    out = S.register(requests, matched, values, master, stored)
    assert {r.incoming_id: r.outcome for r in out["results"].collect()} == {"a": "registered", "n": "registered", "m": "match_changed"}
    assert [(r.field_code, r.old_value_json, r.new_value_json) for r in out["diffs"].collect()] == [("current_owner_name", "旧主", "新主")]
    assert out["units"].count() == 1 and out["versions"].count() == 2 and out["cases"].count() == 2
    again = {**stored, "imports": out["imports"].select("content_hash", F.lit(None).cast("string").alias("document_version_id"), F.lit(None).cast("string").alias("raw_json"), F.lit(None).cast("timestamp").alias("created_at"))}
    rerun = S.register(requests, matched, values, master, again)
    assert {r.incoming_id: r.outcome for r in rerun["results"].collect()}["a"] == "reused" and rerun["versions"].count() == 0 and rerun["diffs"].count() == 0

    # one new unit asked for twice, and one request sent twice, in the same batch
    requests = spark.createDataFrame([("p", "k7", "new", None, None, "new", None), ("q", "k8", "new", None, None, "new", None), ("r", "k8", "new", None, None, "new", None)], req)
    matched = spark.createDataFrame([(i, "new", None, None) for i in "pqr"], "incoming_id string, status string, unit_id string, building_id string")
    values = spark.createDataFrame([(i, "f9", "z.pdf", c, v, 1.0, 1, v, False) for i in "pqr" for c, v in (("registry_location", '"港区"'), ("land_lots", '["1番"]'), ("house_number", '"1番の2"'))], val)
    out = S.register(requests, matched, values, values.select("incoming_id", "field_code", "value_json"), stored)
    assert {r.incoming_id: r.outcome for r in out["results"].collect()} == {"p": "registered", "q": "registered", "r": "reused"}
    assert [out[n].count() for n in ("buildings", "units", "documents", "versions", "cases")] == [1, 1, 1, 1, 2] and out["units"].first().incoming_id == "p"


def test_report_scenario(spark):
    """Hold keeps the master, a changed master is stale, weak evidence blocks, one adoption applies, a repeat is reused."""
    day = dt.date(2026, 1, 1)
    base = dict(unit_id="u", asked_unit_id="u", field_code="management_fee", review_status="unreviewed", action="adopt", old_json="12000", new_json="13500", is_trusted=True, entity_level="unit",
                document_type="important_report", requested_at=day)
    cases = {"hold": dict(action="hold"), "apply": {}, "later": dict(requested_at=dt.date(2026, 2, 1)), "weak": dict(is_trusted=False), "done": dict(review_status="applied"), "other": dict(asked_unit_id="z"),
             "stale": dict(unit_id="v", asked_unit_id="v"), "fill": dict(unit_id="w", asked_unit_id="w"), "null": dict(new_json="null"), "word": dict(action="drop")}
    requests = spark.createDataFrame([{**base, **v, "diff_id": k} for k, v in cases.items()])
    current = spark.createDataFrame([("u", "management_fee", "12000"), ("v", "management_fee", "13000"), ("w", "management_fee", None)], "unit_id string, field_code string, master_json string")
    got = {r.diff_id: (r.decision, r.reason) for r in adopt.adopt_master(requests, current).collect()}
    assert got["hold"] == ("held", None) and got["apply"] == ("applied", None) and got["later"] == ("refused", "Master changed; reload")
    assert got["weak"][1] == "Evidence review required" and got["done"] == ("reused", None) and got["other"][1] == "Unit mismatch"
    assert got["stale"][1] == "Master changed; reload" and got["fill"][0] == "applied" and got["null"][1] == "Invalid decision" and got["word"][1] == "Invalid decision"
    new = adopt.apply_master(spark.createDataFrame([("u", None), ("v", None)], "unit_id string, management_fee decimal(18,2)"),
                             spark.createDataFrame([("u", "management_fee", "13500")], "unit_id string, field_code string, value string"), "unit_id", ["management_fee"])
    assert {r.unit_id: r.management_fee and int(r.management_fee) for r in new.collect()} == {"u": 13500, "v": None}


def test_other_adoption_policies(spark):
    day = dt.date(2026, 1, 1)
    rep = dict(document_id="d", field_code="fee", value_json="1", source_text="q", page_no=1, needs_review=False, approved=False, verified=False, reviewed_by="r", as_of_date=day, baseline_id="b", current_id="b",
               current_date=day, requested_at=day)
    cases = {"ok": {}, "who": dict(reviewed_by=" "), "quote": dict(source_text=""), "flag": dict(needs_review=None), "seen": dict(needs_review=True, verified=True, field_code="x"), "stale": dict(current_id="c"),
             "old": dict(as_of_date=None, field_code="y")}
    got = {r.diff_id: r.reason or r.decision for r in adopt.approve_report(spark.createDataFrame([{**rep, **v, "diff_id": k} for k, v in cases.items()],
           "document_id string, field_code string, value_json string, source_text string, page_no int, needs_review boolean, approved boolean, verified boolean, reviewed_by string, as_of_date date, baseline_id string, current_id string, current_date date, requested_at date, diff_id string")).collect()}
    assert got == {"ok": "applied", "who": "Reviewer required", "quote": "Evidence required", "flag": "Resolve reading uncertainty before approval", "seen": "applied", "stale": "Review is stale", "old": "Older or unknown reference date"}
    rule = dict(document_id="d", building_id="b", case_building_id="b", field_code="pet", review_status="unreviewed", action="adopt", old_json="1", new_json="2", is_trusted=True, other_json="1", requested_at=day)
    cases = {"ok": {}, "case": dict(case_building_id="z"), "weak": dict(is_trusted=False), "stale": dict(other_json="9", field_code="q")}
    got = {r.diff_id: r.reason or r.decision for r in adopt.adopt_rules(spark.createDataFrame([{**rule, **v, "diff_id": k} for k, v in cases.items()])).collect()}
    assert got == {"ok": "applied", "case": "Case mismatch", "weak": "Evidence review required", "stale": "Stale review"}
    ptr = dict(case_id="k", field_code="management_fee", in_scope=True, document_type="important_report", review_status="unreviewed", action="adopt", old_json="1", old_version_id="v1", new_json="2", as_of_date=day,
               is_trusted=True, requested_at=day)
    cases = {"ok": {}, "source": dict(document_type="registry"), "stale": dict(old_version_id="v0"), "older": dict(as_of_date=dt.date(2020, 1, 1))}
    pointers = spark.createDataFrame([("k", "management_fee", "e1")], "case_id string, field_code string, value_id string")
    vals = spark.createDataFrame([("e1", "1", "v1", day)], "value_id string, value_json string, version_id string, as_of_date date")
    got = {r.diff_id: r.reason or r.decision for r in adopt.adopt_pointer(spark.createDataFrame([{**ptr, **v, "diff_id": k} for k, v in cases.items()]), pointers, vals).collect()}
    assert got == {"ok": "applied", "source": "Source mismatch", "stale": "Review is stale", "older": "Older source"}


def test_ordered_scan_does_not_depend_on_buckets_or_partitions(spark):
    df = spark.range(400).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    spec = {"n": Running(F.lit(1)), "last": Last(F.col("v"), inclusive=False)}
    one = sorted(tuple(r) for r in scan(df, ["k"], F.lit(0), ["o"], spec).collect())
    many = sorted(tuple(r) for r in scan(df.orderBy(F.rand(1)).repartition(7), ["k"], F.floor(F.col("o") / 11), ["o"], spec).collect())
    assert one == many and max(r[3] for r in one) == 134


def test_zone_letters_and_order(spark):
    new = spark.createDataFrame([("b", "h1", 1), ("b", "h2", 2), ("full", "z", 1)], "building_id string, file_hash string, ord int")
    have = spark.createDataFrame([("b", "h1", "B")] + [("full", f"f{i}", c) for i, c in enumerate("ABCD")], "building_id string, file_hash string, zone_label string")
    done, rejected = aggregates.letter_zones(new, have)
    assert [(r.file_hash, r.zone_label) for r in done.collect()] == [("h2", "A")] and [r.building_id for r in rejected.collect()] == ["full"]
    zones = spark.createDataFrame([("b", 0, "x"), ("b", 1, "y"), ("c", 0, "z")], "building_id string, position int, v string")
    moved, bad = aggregates.reorder_zones(zones, spark.createDataFrame([("b", [1, 0]), ("c", [1])], "building_id string, order array<int>"))
    assert {r.v: (r.position, r.zone_label) for r in moved.collect()} == {"x": (1, "B"), "y": (0, "A")} and bad.count() == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "b.txt").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "c.pdf").write_bytes(b"hello")
    good, bad = tables.land_files(spark, str(tmp_path / "in"))
    assert [r.name for r in good.collect()] == ["a.pdf"] and {r.name: r.reason for r in bad.collect()} == {"b.txt": "not a pdf name", "c.pdf": "not a pdf"}
    docs = tmp_path / "docs.txt"
    docs.write_text("\n".join(json.dumps(x) for x in ({"a": 1, "b": "x"}, {"a": 1}, {"a": "one", "b": "x"}, {"a": 2, "b": "y", "c": 0})))
    ok, rejects = tables.read_bundles(spark, str(docs), T.StructType.fromDDL("a int, b string"))
    assert [tuple(r) for r in ok.collect()] == [(1, "x")] and sorted(r.reason for r in rejects.collect()) == ["keys", "keys", "type"]
    rows = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, v int")
    for _ in range(2):
        sinks.append_absent(rows, str(tmp_path / "t"), ["key"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_snapshot(rows, str(tmp_path / "m"))
    sinks.write_snapshot(rows.limit(1), str(tmp_path / "m"))
    assert sinks.read_snapshot(spark, str(tmp_path / "m")).count() == 1
    sinks.export_csv(spark.createDataFrame([("=x", True)], "code string, ok boolean"), str(tmp_path / "csv"))
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "csv").glob("*.csv"))
    assert text.startswith("﻿code") and "'=x,対応済み" in text


def test_guards_and_catalog(spark):
    assert load_catalog(spark).count() == load_catalog(spark).select("field_code").distinct().count()
    docs = spark.createDataFrame([("k", "rules", "見本 ハイツ", None), ("k", "rules", "別館", None), ("k", "report", None, "h2")], "case_id string, kind string, building_name string, house_number string")
    cases = spark.createDataFrame([("k", "見本ハイツ", "h1")], "case_id string, case_building_name string, case_house_number string")
    good, bad = views.entity_guard(docs, cases)
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["building name differs", "house number differs"]
    names = [("a", "建物謄本.pdf"), ("b", "会社謄本.pdf"), ("c", "scan001.pdf"), ("d", "重説.pdf")]
    files = spark.createDataFrame(names, "file_hash string, name string")
    pages = spark.createDataFrame([("d", 1, "重要事項調査報告書")], "file_hash string, page_no int, text string")
    assert {r.file_hash: r.kind for r in resolve.classify(files, pages).collect()} == {"a": "registry", "b": None, "c": None, "d": None}
