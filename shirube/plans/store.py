"""JOB-16, JOB-17, JOB-20: registration into the store, the workspace view and cached imports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.evidence import content_key
from ..operators import adopt, resolve, versions, views
from ..operators.aggregates import review_counts
from ..operators.ordered import newest
from ..session import cut_lineage

REGISTRY_FIELDS = versions.MASTER_DIFF_FIELDS


def _id(kind: str, *cols: Column) -> Column:
    """Stable id from the natural key, so a rerun makes the same rows."""
    return content_key(F.lit(kind), *cols)


def register(requests: DataFrame, matched: DataFrame, values: DataFrame, master: DataFrame, store: dict[str, DataFrame], document_type: str = "registry") -> dict[str, DataFrame]:
    """JOB-16: new store rows of a batch of registrations.

    Where ``requests`` has requested_at, requests count by it and carry it into the rows they make; else they count by incoming_id.

    ``requests``: incoming_id, request_key, expected_status, expected_unit_id, expected_building_id, case_mode, resume_case_id;
    ``matched``: the re-run match (status, unit_id, building_id); ``values``: incoming_id, file_hash, original_filename, field_code,
    value_json, confidence, page_no, source_text, needs_review; ``master``: incoming_id, field_code, value_json (sure values).
    A request whose match changed since it was shown, or that was already imported, adds nothing. New masters take their ids from
    location, parcels and house number where these are sure, so two requests for one new unit make one; the earliest names it.
    """
    timed = ["requested_at"] if "requested_at" in requests.columns else []
    earliest = [F.asc_nulls_last(c) for c in timed] + [F.asc("incoming_id")]
    joined = requests.join(matched, "incoming_id")
    seen = store["imports"].select(F.col("content_hash").alias("request_key")).withColumn("_seen", F.lit(True))
    joined = joined.join(seen, "request_key", "left")
    named = lambda code: F.max(F.when(F.col("field_code") == code, F.col("value_json")))
    natural = master.groupBy("incoming_id").agg(named("registry_location").alias("_place"), named("land_lots").alias("_lots"), named("house_number").alias("_house"))
    joined = joined.join(natural, "incoming_id", "left")
    same = (F.col("status").eqNullSafe(F.col("expected_status")) & F.col("unit_id").eqNullSafe(F.col("expected_unit_id"))
            & F.col("building_id").eqNullSafe(F.col("expected_building_id")))
    resumed = store["cases"].select(F.col("case_id").alias("resume_case_id"), F.col("unit_id").alias("_case_unit"))
    joined = joined.join(resumed, "resume_case_id", "left")
    bad_case = (F.col("case_mode") == "resume") & ~F.coalesce(F.col("_case_unit") == F.col("unit_id"), F.lit(False))
    outcome = (F.when(F.col("_seen"), "reused").when(~F.coalesce(F.col("status").isin("new", "existing"), F.lit(False)) | ~same, "match_changed")
               .when(bad_case, "invalid_case").when(~F.col("case_mode").isin("new", "resume"), "invalid_case").otherwise("registered"))
    # of requests with one key that could be registered the first counts, the others find it done
    staged = joined.withColumn("outcome", outcome)
    place = F.row_number().over(Window.partitionBy("request_key", "outcome").orderBy(*earliest))
    staged = staged.withColumn("outcome", F.when((F.col("outcome") == "registered") & (place > 1), "reused").otherwise(F.col("outcome")))
    staged = cut_lineage(staged.drop("expected_status", "expected_unit_id", "expected_building_id", "status", "_seen", "_case_unit"))  # one row a request; all tables follow from it
    go = staged.filter("outcome = 'registered'")
    go = (go.withColumn("_new_building", F.col("building_id").isNull()).withColumn("_new_unit", F.col("unit_id").isNull())
          .withColumn("building_id", F.coalesce("building_id", F.when(F.col("_place").isNotNull(), _id("building", F.col("_place"), F.coalesce("_lots", F.lit("")))), _id("building", F.col("request_key"))))
          .withColumn("unit_id", F.coalesce("unit_id", F.when(F.col("_place").isNotNull() & F.col("_house").isNotNull(), _id("unit", F.col("building_id"), F.col("_house"))), _id("unit", F.col("request_key"))))
          .withColumn("case_id", F.when(F.col("case_mode") == "resume", F.col("resume_case_id")).otherwise(_id("case", F.col("request_key")))))
    target = go.select("incoming_id", *timed, "building_id", "unit_id", "case_id", "_new_unit")

    known = (store["versions"].join(store["documents"].filter(F.col("document_type") == document_type).select("document_id", "unit_id"), "document_id")
             .groupBy("unit_id", "file_hash").agg(F.min_by("document_version_id", "uploaded_at").alias("_known"), F.min_by("document_id", "uploaded_at").alias("_known_doc")))
    files = values.select("incoming_id", "file_hash", "original_filename").dropDuplicates(["incoming_id", "file_hash"]).join(target, "incoming_id").join(known, ["unit_id", "file_hash"], "left")
    files = (files.withColumn("document_version_id", F.coalesce("_known", _id("version", F.col("unit_id"), F.lit(document_type), F.col("file_hash"))))
             .withColumn("document_id", F.coalesce("_known_doc", _id("document", F.col("unit_id"), F.lit(document_type), F.col("file_hash")))).withColumn("is_new", F.col("_known").isNull()))
    files = cut_lineage(files.drop("_known", "_known_doc"))  # one row a request and file
    fresh = newest(files.filter("is_new"), ["document_version_id"], earliest)
    new_values = values.drop("original_filename").join(fresh.select("incoming_id", *timed, "file_hash", "document_version_id", "document_id", "unit_id"), ["incoming_id", "file_hash"])
    new_values = new_values.withColumn("extracted_value_id", _id("value", F.col("document_version_id"), F.col("field_code")))

    # Changes only for units that existed, for sure values of the watched fields that this version holds, not recorded before.
    fields = list(REGISTRY_FIELDS)
    prior = versions.unpivot_master(store["units"], "unit_id", fields)
    no_pointers = store["cases"].filter("purchase_values is not null").select("case_id")
    plain = lambda c: F.regexp_replace(F.col(c), '^"|"$', "")
    sure = master.filter(F.col("field_code").isin(*fields)).join(target.filter("not _new_unit"), "incoming_id").join(no_pointers, "case_id", "left_anti")
    held = values.filter(F.col("field_code").isin(*fields)).select("incoming_id", "file_hash", "field_code", "value_json").join(files.select("incoming_id", "file_hash", "document_version_id", "document_id"), ["incoming_id", "file_hash"])
    sides = (sure.join(held, ["incoming_id", "field_code", "value_json"]).join(prior, ["unit_id", "field_code"], "left")
             .withColumn("new_json", plain("value_json")).withColumnRenamed("master_json", "old_json").filter(~F.col("old_json").eqNullSafe(F.col("new_json"))))
    recorded = store["diffs"].join(store["documents"].select("document_id", "unit_id"), "document_id").select(
        "unit_id", "field_code", plain("old_value_json").alias("old_json"), plain("new_value_json").alias("new_json"))
    diffs = adopt.not_imported(sides, recorded, ["unit_id", "field_code", "old_json", "new_json"]) if document_type == "registry" else sides.limit(0)
    diffs = newest(diffs, ["unit_id", "field_code", "old_json", "new_json"], [F.asc("document_version_id")])
    diffs = diffs.select(_id("diff", F.col("unit_id"), F.col("field_code"), F.col("old_json"), F.col("new_json")).alias("diff_id"), "document_id", "unit_id",
                         F.col("document_version_id").alias("new_version_id"), "field_code", F.col("old_json").alias("old_value_json"), F.col("new_json").alias("new_value_json"),
                         F.lit("unreviewed").alias("review_status"), F.concat(F.lit("units."), F.col("field_code")).alias("affected_field"))
    results = staged.select("incoming_id", "outcome").join(target.drop("_new_unit", *timed), "incoming_id", "left")
    return {
        "results": results,
        "buildings": newest(go.filter("_new_building"), ["building_id"], earliest).select("building_id", "incoming_id"),
        "units": newest(go.filter("_new_unit"), ["unit_id"], earliest).select("unit_id", "building_id", "incoming_id", *timed),
        "cases": go.filter("case_mode = 'new'").select("case_id", "unit_id", F.lit("draft").alias("case_status")),
        "documents": fresh.select("document_id", F.lit(document_type).alias("document_type"), "building_id", "unit_id", "case_id", F.col("original_filename").alias("title")),
        "versions": fresh.select("document_version_id", "document_id", F.lit(1).alias("version_no"), "file_hash", "original_filename", F.lit("provisional").alias("status"),
                                 F.lit("seller_provided" if document_type == "registry" else "historical_purchase_document").alias("source_type"), *timed),
        "values": new_values, "diffs": diffs, "imports": go.select(F.col("request_key").alias("content_hash"), "incoming_id", *timed)}


def workspace_view(store: dict[str, DataFrame], catalog: DataFrame) -> dict[str, DataFrame]:
    """JOB-17: cases with their documents, field views, diff sides, counts, unlinked documents and base imports.

    Every part is a flat table keyed by case; nothing is nested into one row per case.
    """
    units = store["units"]
    cases = views.cases_or_units(store["cases"].select("case_id", "unit_id", "case_status"), units)
    cases = cases.join(units.select("unit_id", "building_id"), "unit_id")
    scope = views.case_documents(cases, store["documents"])
    v = store["versions"].withColumnRenamed("document_version_id", "version_id")
    fields = views.field_view(store["values"].withColumnRenamed("document_version_id", "version_id"), catalog)
    case_fields = scope.join(v.select("version_id", "document_id", "version_no", "original_filename", "as_of_date", "uploaded_at"), "document_id").join(fields, "version_id")
    pointed = store["cases"].select("case_id", F.col("purchase_values").isNotNull().alias("_pointed"))
    labels = catalog.select("field_code", "label")
    diffs = scope.join(store["diffs"], "document_id").join(pointed, "case_id", "left")
    own = F.col("affected_field").eqNullSafe(F.concat(F.lit("purchase:"), F.col("case_id")))
    pointer_diff = F.coalesce(F.col("affected_field"), F.lit("")).startswith("purchase:")
    diffs = diffs.filter(F.when(F.coalesce("_pointed", F.lit(False)), own).otherwise(~pointer_diff)).drop("_pointed")
    values = store["values"].withColumnRenamed("document_version_id", "version_id")
    sides = versions.diff_sides(diffs, values, v, labels)
    newer = F.col("new_trusted") & (F.coalesce("old_date", F.lit("")) != "") & (F.coalesce("new_date", F.lit("")) > F.col("old_date"))
    sides = sides.withColumn("recommended_source", F.when(newer, "new")).withColumn("can_adopt", F.col("new_trusted"))
    counts = review_counts(case_fields.select("case_id", "needs_review"), sides.select("case_id", "review_status"))
    imports = store["imports"].join(v.select(F.col("version_id").alias("document_version_id"), "document_id"), "document_version_id").join(
        store["documents"].select("document_id", "unit_id"), "document_id")
    return {"cases": cases.join(counts, "case_id", "left").na.fill(0, ["review_count", "diff_count"]), "fields": case_fields, "diffs": sides,
            "unlinked": views.unlinked_documents(store["documents"]), "base_imports": versions.first_import(imports, ["unit_id"])}


def import_known(files: DataFrame, store: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """JOB-20: (requests, missing files). All hashes stored and one unit means its open case; otherwise what is missing.

    ``files``: request_id, file_hash, name.
    """
    stored = store["versions"].join(store["documents"].select("document_id", "unit_id"), "document_id").select("file_hash", "unit_id")
    known = resolve.known_files(files, stored)
    cases = resolve.open_case(store["cases"]).select("unit_id", F.col("case_id"))
    found = known.join(cases, "unit_id", "left").withColumn("needs_case", (F.col("status") == "cached") & F.col("case_id").isNull())
    lost = files.join(stored.select("file_hash").distinct(), "file_hash", "left_anti")
    return found, lost
