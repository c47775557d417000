"""Workspace view and cached imports on a small store."""
import datetime as dt

from pyspark.sql import types as T

from shirube import schemas
from shirube.catalog import load_catalog
from shirube.plans import store as S
from shirube.sources import tables

NOW = dt.datetime(2026, 1, 1)


def rows(name, *items):
    names = [f.name for f in T.StructType.fromDDL(schemas.STORE[name])]
    return [tuple(item.get(n) for n in names) for item in items]


def test_workspace_and_known_files(spark):
    data = {
        "buildings": rows("buildings", dict(building_id="b1", building_name="見本ハイツ")),
        "units": rows("units", dict(unit_id="u1", building_id="b1"), dict(unit_id="u2", building_id="b1")),
        "cases": rows("cases", dict(case_id="c1", unit_id="u1", case_status="draft", updated_at=NOW)),
        "documents": rows("documents", dict(document_id="d1", document_type="important_report", unit_id="u1", building_id="b1"), dict(document_id="d2", document_type="management_rules", building_id="b1"),
                          dict(document_id="d3", document_type="registry"), dict(document_id="d4", document_type="zoning", building_id="b1")),
        "versions": rows("versions", dict(document_version_id="v1", document_id="d1", version_no=1, file_hash="h1", uploaded_at=NOW), dict(document_version_id="v2", document_id="d1", version_no=2, file_hash="h2", uploaded_at=dt.datetime(2026, 2, 1)),
                         dict(document_version_id="v4", document_id="d4", version_no=1, file_hash="h4", uploaded_at=NOW)),
        "values": rows("values", *[dict(extracted_value_id=f"e{v}", document_version_id=v, field_code="management_fee", value_json=x, confidence=0.9, source_text="q", page_no=1, needs_review=False) for v, x in (("v1", "12000"), ("v2", "13500"))]),
        "diffs": rows("diffs", dict(diff_id="f1", document_id="d1", old_version_id="v1", new_version_id="v2", field_code="management_fee", old_value_json="12000", new_value_json="13500", review_status="unreviewed", affected_field="management_fee")),
        "imports": [],
    }
    store = tables.snapshot({n: spark.createDataFrame(data[n], schemas.STORE[n]) for n in schemas.STORE})
    view = S.workspace_view(store, load_catalog(spark))
    cases = {r.case_id: (r.review_count, r.diff_count) for r in view["cases"].collect()}
    assert cases == {"c1": (0, 1), "unit-u2": (0, 0)}
    diff = view["diffs"].first()
    assert diff.recommended_source == "new" and diff.can_adopt and diff.label == "対象住戸の月額管理費（円）"
    assert [r.document_id for r in view["unlinked"].collect()] == ["d3"]
    assert {(r.case_id, r.version_id) for r in view["fields"].collect()} == {("c1", "v1"), ("c1", "v2")}
    files = spark.createDataFrame([("r1", "h1", "a.pdf"), ("r2", "h1", "a.pdf"), ("r2", "hx", "x.pdf")], "request_id string, file_hash string, name string")
    found, lost = S.import_known(files, store)
    assert {r.request_id: (r.status, r.case_id) for r in found.collect()} == {"r1": ("cached", "c1"), "r2": ("missing", "c1")}
    assert [r.name for r in lost.collect()] == ["x.pdf"]
