"""JOB-16 as a store update: masters with their attributes, old versions of changes, first pointers and pointer changes (ADP-6, DIF-4)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schemas
from ..functions.evidence import is_absent
from ..operators import versions
from ..operators.ordered import newest
from ..session import cut_lineage
from .adoption import Store, updated
from .store import _id, register

PURCHASE = "purchase_important_explanation"


def _fit(rows: DataFrame, table: str, **known: Column) -> DataFrame:
    """Rows in the table's schema; what they do not have is null."""
    made = []
    for f in T.StructType.fromDDL(schemas.STORE[table]):
        col = known.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None))
        made.append(col.cast(f.dataType).alias(f.name))
    return rows.select(*made)


def _typed(text: Column, kind: T.DataType) -> Column:
    """A JSON value as a column of a master; text of another form is null."""
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.from_json(text, kind)
    return F.regexp_replace(text, '^"|"$', "").try_cast(kind)


def _attributes(rows: DataFrame, master: DataFrame, table: str) -> DataFrame:
    """rows(incoming_id, ids) with the sure values of the request that made them, one column for each attribute of the table."""
    fields = [f for f in T.StructType.fromDDL(schemas.STORE[table]) if f.name not in ("unit_id", "building_id", "updated_at")]
    wide = master.filter(F.col("field_code").isin(*[f.name for f in fields]) & ~is_absent(F.col("value_json"))).groupBy("incoming_id").agg(*[F.max(F.when(F.col("field_code") == f.name, F.col("value_json"))).alias(f.name) for f in fields])
    joined = rows.join(wide, "incoming_id", "left")
    return joined.select(*rows.columns, *[_typed(F.col(f.name), f.dataType).alias(f.name) for f in fields])


def _readings(store: Store, cases: DataFrame) -> DataFrame:
    """Values of documents of the cases' units, and of the rules of their buildings: case_id and what the pointer operators need."""
    docs = store["documents"].select("document_id", "document_type", F.col("unit_id").alias("_unit"), F.col("building_id").alias("_building"))
    held = cases.select("case_id", "unit_id").join(store["units"].select("unit_id", "building_id"), "unit_id", "left")
    own = docs.join(held.select("case_id", F.col("unit_id").alias("_unit")), "_unit")
    rules = docs.filter("_unit is null and document_type = 'management_rules'").join(held.select("case_id", F.col("building_id").alias("_building")), "_building")
    scope = own.select("case_id", "document_id", "document_type", F.lit(True).alias("own")).unionByName(rules.select("case_id", "document_id", "document_type", F.lit(False).alias("own")))
    v = store["versions"].select("document_version_id", "document_id", "uploaded_at")
    return scope.join(v, "document_id").join(store["values"], "document_version_id").withColumnsRenamed({"extracted_value_id": "value_id", "document_version_id": "version_id", "value_as_of_date": "as_of_date"})


def start_pointers(store: Store, cases: DataFrame, version_ids: DataFrame) -> DataFrame:
    """ADP-6: rows of cases that had no pointers, with those they start from.

    Per field a trusted value of the unit's documents that is approved or in one of the versions (version_id); approved and newer ones first.
    ``cases``: case_id.
    """
    fresh = store["cases"].join(cases.select("case_id").distinct(), "case_id", "left_semi").filter("purchase_values is null")
    given = version_ids.select("version_id").distinct().withColumn("_given", F.lit(True))
    usable = _readings(store, fresh).filter("own").join(given, "version_id", "left").filter(F.coalesce("_given", F.lit(False)) | F.coalesce("approved", F.lit(False)))
    usable = usable.withColumn("approved", F.coalesce("approved", F.lit(False)))
    first = versions.initial_baseline(usable, ["case_id", "field_code"], [F.desc("created_at"), F.asc("value_id")])
    maps = first.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("field_code", "value_id"))).alias("_start"))  # at most the catalog's fields
    joined = fresh.join(maps, "case_id", "left")
    return joined.withColumn("purchase_values", F.coalesce("_start", F.create_map().cast("map<string,string>"))).select(*store["cases"].columns)


def sync_pointers(store: Store, cases: DataFrame) -> DataFrame:
    """DIF-4: new diff rows of the cases: a field's newest reading from its own source against the evidence the case points to."""
    pointed = store["cases"].join(cases.select("case_id").distinct(), "case_id", "left_semi").filter("purchase_values is not null")
    latest = versions.latest_by_source(_readings(store, pointed), ["case_id", "field_code"], [F.desc("uploaded_at"), F.desc("created_at"), F.asc("value_id")])
    pointers = pointed.select("case_id", F.explode("purchase_values").alias("field_code", "value_id"))
    old = store["values"].select(F.col("extracted_value_id").alias("value_id"), F.col("document_version_id").alias("version_id"), "value_json", F.col("value_as_of_date").alias("as_of_date"))
    recorded = store["diffs"].filter("affected_field like 'purchase:%'").select(F.substring("affected_field", 10, 2**31 - 1).alias("case_id"), "field_code", "new_version_id", F.col("old_value_json").alias("old_json"))
    found = versions.diff_adopted(latest.drop("value_id"), pointers, old, recorded)
    affected = F.concat(F.lit("purchase:"), "case_id")
    return _fit(found, "diffs", diff_id=_id("diff", affected, F.col("field_code"), F.col("version_id"), F.col("old_json")), new_version_id=F.col("version_id"), old_value_json=F.col("old_json"),
                new_value_json=F.col("value_json"), review_status=F.lit("unreviewed"), affected_field=affected)


def register_batch(requests: DataFrame, matched: DataFrame, values: DataFrame, master: DataFrame, store: Store, document_type: str = "registry") -> tuple[DataFrame, Store]:
    """JOB-16: (results, changed rows per table, in the store's schemas), for ``adoption.updated`` or ``commits.commit``.

    Arguments as for ``register``; ``requests`` also has requested_at. Of requests for one new master the earliest gives its attributes.
    A change names the version its old value was read from, approved and newer ones first. Purchase documents give a case that has
    none its first pointers; afterwards every registered case gets the changes of its pointers, once. The decisions are written once
    (``register``); tables of changes follow from them when they are read.
    """
    out = register(requests, matched, values, master, store, document_type)
    results = out["results"]
    held = store["values"].join(store["versions"].select("document_version_id", "document_id"), "document_version_id").join(store["documents"].select("document_id", F.col("unit_id").alias("_u")), "document_id")
    bare = F.regexp_replace("value_json", '^"|"$', "")
    source = held.select("_u", F.col("field_code").alias("_f"), bare.alias("_v"), F.col("document_version_id").alias("_old"), "approved", "created_at")
    old = out["diffs"].join(source, (F.col("unit_id") == F.col("_u")) & (F.col("field_code") == F.col("_f")) & F.col("_v").eqNullSafe(F.col("old_value_json")), "left")
    old = newest(old, ["diff_id"], [F.desc_nulls_last("approved"), F.desc_nulls_last("created_at"), F.asc("_old")])
    at = F.col("requested_at")
    changes = {
        "buildings": _fit(_attributes(out["buildings"], master, "buildings"), "buildings"),
        "units": _fit(_attributes(out["units"], master, "units"), "units", updated_at=at),
        "cases": _fit(out["cases"], "cases"), "documents": _fit(out["documents"], "documents"),
        "versions": _fit(out["versions"], "versions", uploaded_at=at, is_current=F.lit(False)),
        "values": _fit(out["values"], "values", created_at=at, approved=F.lit(False), reviewed=F.lit(False)),
        "diffs": _fit(old, "diffs", old_version_id=F.col("_old")),
        "imports": _fit(out["imports"], "imports", created_at=at)}
    done = results.filter("outcome = 'registered'").select("case_id", "unit_id")
    pointed = updated({"cases": store["cases"]}, {"cases": changes["cases"]})["cases"].filter("purchase_values is not null").join(done.select("case_id"), "case_id", "left_semi")
    if document_type != PURCHASE and pointed.isEmpty():  # no case points to anything, so no pointer has changed
        return results, changes
    changes = {name: cut_lineage(rows) for name, rows in changes.items()}
    done = cut_lineage(done)
    now = updated({**store}, changes)
    if document_type == PURCHASE:
        started = cut_lineage(start_pointers(now, done, changes["versions"].select(F.col("document_version_id").alias("version_id"))))
        changes["cases"] = cut_lineage(updated({"cases": changes["cases"]}, {"cases": started})["cases"])
        now = updated(now, {"cases": started})
    changes["diffs"] = changes["diffs"].unionByName(cut_lineage(sync_pointers(now, done)))
    return results, changes
