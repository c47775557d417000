"""Registration that writes attributes, old versions, first pointers and pointer changes."""
import datetime as dt
import os

from test_adoption import frame

from shirube import schemas
from shirube.plans import adoption, registration as R
from shirube.session import cut_lineage

at = lambda m: dt.datetime(2026, 3, 1) + dt.timedelta(minutes=m)
REQUEST = "incoming_id string, request_key string, expected_status string, expected_unit_id string, expected_building_id string, case_mode string, resume_case_id string, requested_at timestamp"
MATCH = "incoming_id string, status string, unit_id string, building_id string"
VALUE = "incoming_id string, file_hash string, original_filename string, field_code string, value_json string, confidence double, page_no int, source_text string, needs_review boolean"


def read(spark, rows):
    values = spark.createDataFrame([(i, f, f"{f}.pdf", c, v, 0.95, 1, "q", False) for i, f, c, v in rows], VALUE)
    return values, values.select("incoming_id", "field_code", "value_json")


def test_registered_batch(spark):
    store = {n: frame(spark, n, []) for n in schemas.STORE}
    store["units"] = frame(spark, "units", [dict(unit_id="u", building_id="b", current_owner_name="old")])
    store["buildings"] = frame(spark, "buildings", [dict(building_id="b", building_name="x")])
    store["documents"] = frame(spark, "documents", [dict(document_id="d0", document_type="registry", unit_id="u", building_id="b")])
    store["versions"] = frame(spark, "versions", [dict(document_version_id="v0", document_id="d0", version_no=1, uploaded_at=at(-9)), dict(document_version_id="v1", document_id="d0", version_no=2, uploaded_at=at(-8))])
    good = dict(field_code="current_owner_name", value_json='"old"', confidence=0.99, page_no=1, source_text="q", needs_review=False)
    store["values"] = frame(spark, "values", [dict(extracted_value_id="e0", document_version_id="v0", created_at=at(-9), approved=True, **good), dict(extracted_value_id="e1", document_version_id="v1", created_at=at(-8), approved=False, **good)])

    # two requests for one new unit: the earlier one, though named later in the alphabet, gives its attributes; one request repeated; one existing unit with a new owner
    requests = spark.createDataFrame([("z", "k1", "new", None, None, "new", None, at(1)), ("a", "k2", "new", None, None, "new", None, at(2)), ("r", "k1", "new", None, None, "new", None, at(3)), ("o", "k3", "existing", "u", "b", "new", None, at(4))], REQUEST)
    matched = spark.createDataFrame([(i, "new", None, None) for i in "zar"] + [("o", "existing", "u", "b")], MATCH)
    new = lambda i, file, owner, area: [(i, file, "registry_location", '"港区"'), (i, file, "land_lots", '[{"location":"港区","lot_number":"1番"}]'), (i, file, "house_number", '"1番の2"'), (i, file, "current_owner_name", f'"{owner}"'), (i, file, "registered_area", area)]
    values, master = read(spark, new("z", "f1", "first", "55.5") + new("a", "f2", "second", "66") + new("r", "f1", "first", "55.5") + [("o", "f3", "current_owner_name", '"new"')])
    results, changes = R.register_batch(requests, matched, values, master, store)
    assert {r.incoming_id: r.outcome for r in results.collect()} == {"z": "registered", "a": "registered", "r": "reused", "o": "registered"}
    (unit,) = changes["units"].collect()
    (building,) = changes["buildings"].collect()
    assert (unit.current_owner_name, float(unit.registered_area), unit.house_number, unit.building_id, unit.updated_at) == ("first", 55.5, "1番の2", building.building_id, at(1))
    assert building.registry_location == "港区" and [(l.location, l.lot_number) for l in building.land_lots] == [("港区", "1番")]
    assert [(r.field_code, r.old_version_id, r.old_value_json, r.new_value_json) for r in changes["diffs"].collect()] == [("current_owner_name", "v0", "old", "new")]
    assert {r.uploaded_at for r in changes["versions"].collect()} == {at(1), at(2), at(4)} and changes["values"].count() == 11
    for name, rows in changes.items():
        assert rows.schema == store[name].schema or rows.columns == store[name].columns

    # a purchase document starts the pointers of its case; a later registry document then shows up as a change of the pointer
    store = adoption.updated(store, changes)
    case = [r.case_id for r in results.collect() if r.incoming_id == "o"][0]
    bought = spark.createDataFrame([("p", "k9", "existing", "u", "b", "resume", case, at(9))], REQUEST)
    values, master = read(spark, [("p", "f9", "seller_name", '"甲"'), ("p", "f9", "sale_price", "null")])
    match = spark.createDataFrame([("p", "existing", "u", "b")], MATCH)
    results, changes = R.register_batch(bought, match, values, master, store, R.PURCHASE)
    assert [r.outcome for r in results.collect()] == ["registered"]
    (row,) = changes["cases"].collect()
    assert set(row.purchase_values) == {"seller_name", "current_owner_name"} and row.purchase_values["current_owner_name"] == "e0"
    found = [(r.field_code, r.old_version_id, r.old_value_json, r.new_value_json, r.affected_field) for r in changes["diffs"].collect()]
    assert found == [("current_owner_name", "v0", '"old"', '"new"', f"purchase:{case}")]
    after = adoption.updated(store, changes)
    assert R.sync_pointers(after, after["cases"]).count() == 0
    again, more = R.register_batch(bought, match, values, master, after, R.PURCHASE)
    assert [r.outcome for r in again.collect()] == ["reused"] and all(rows.count() == 0 for rows in more.values())


def test_registration_writes_its_decisions_once(spark):
    store = {n: frame(spark, n, []) for n in schemas.STORE}
    requests = spark.createDataFrame([("a", "k1", "new", None, None, "new", None, at(2)), ("b", "k1", "new", None, None, "new", None, at(1)), ("c", "k1", "new", None, None, "new", None, None)], REQUEST)
    matched = spark.createDataFrame([(i, "new", None, None) for i in "abc"], MATCH)
    values, master = read(spark, [(i, "f", "current_owner_name", f'"{i}"') for i in "abc"])
    cut_lineage(requests)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    results, changes = R.register_batch(requests, matched, values, master, store)
    new = set(os.listdir(folder)) - before
    assert len(new) == 2 and all(any(f.endswith(".zstd.parquet") for f in os.listdir(f"{folder}/{n}")) for n in new)  # requests; requests and files
    assert {r.incoming_id: r.outcome for r in results.collect()} == {"a": "reused", "b": "registered", "c": "reused"}
    assert [(r.current_owner_name, r.updated_at) for r in changes["units"].collect()] == [("b", at(1))] and changes["diffs"].count() == 0
