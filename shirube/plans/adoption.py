"""ADP-1..4 as updates of the store: decisions, and the rows that change because of them.

A policy looks up its own evidence, baseline and current values in the store. What it returns are the changed rows of values, diffs,
versions, cases and masters; ``updated`` puts them into the tables, ``sources.commits`` publishes them together. A batch has one writer
and takes its requests by time (``operators.settle``): a request that names something an earlier one of the batch has replaced is
stale, one that asks again for what has just been applied is reused.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.evidence import is_absent, trusted, value_source
from ..operators.ordered import newest
from ..operators.settle import settle
from ..operators.versions import MASTER_DIFF_FIELDS, OPEN_STATUSES, unpivot_master
from ..session import cut_lineage

KEYS = {"values": ["extracted_value_id"], "diffs": ["diff_id"], "versions": ["document_version_id"], "cases": ["case_id"],
        "units": ["unit_id"], "buildings": ["building_id"]}
BASELINES = "document_version_id string, field_code string, baseline_id string"
Store = dict[str, DataFrame]


@dataclass(frozen=True)
class Adoption:
    """``decisions``: request_id, field_code, decision (applied, reused, held, refused), reason. ``changes``: changed rows per table,
    and under ``reviews`` one new log row per applied decision."""
    decisions: DataFrame
    changes: Store


def updated(store: Store, changes: Store) -> Store:
    """The store after the changes; tables without changes stay as they are."""
    out = dict(store)
    for name, rows in changes.items():
        if name in KEYS:
            kept = store[name].join(rows.select(*KEYS[name]), KEYS[name], "left_anti")
            out[name] = kept.unionByName(rows.select(*store[name].columns))
        elif name in store:
            out[name] = store[name].unionByName(rows)
    return out


def _new_values(store: Store, *more: str | Column) -> DataFrame:
    return store["values"].select(F.col("document_version_id").alias("new_version_id"), "field_code", F.col("extracted_value_id").alias("value_id"), "value_json", "value_as_of_date", *more)


def _with_new_side(asked: DataFrame, store: Store) -> DataFrame:
    """``asked`` (new_version_id, field_code) with the value it is about and the value's document, under the names the policies use.

    Values move once; documents of versions are looked up for what was asked.
    """
    v = _new_values(store, "confidence", "page_no", "source_text", "needs_review", F.coalesce("approved", F.lit(False)).alias("approved"))
    versions = store["versions"].select(F.col("document_version_id").alias("_version"), F.col("document_id").alias("new_document_id"))
    read = asked.join(v, ["new_version_id", "field_code"], "left")
    return read.join(versions, F.when(F.col("value_id").isNotNull(), F.col("new_version_id")) == F.col("_version"), "left").drop("_version")


def _documents(store: Store) -> DataFrame:
    return store["documents"].select("document_id", "document_type", F.col("unit_id").alias("document_unit"), F.col("building_id").alias("document_building"))


def _with_diffs(requests: DataFrame, store: Store) -> DataFrame:
    diffs = store["diffs"].select("diff_id", "document_id", "old_version_id", "new_version_id", "field_code", "old_value_json", "new_value_json", "review_status", "affected_field")
    return requests.join(diffs, "diff_id", "left")


def _diff_requests(requests: DataFrame, store: Store) -> DataFrame:
    """Requests about diffs, with the diff, its new value and the document."""
    return _with_new_side(_with_diffs(requests, store), store).join(_documents(store), "document_id", "left")


def _stands(default_review: bool) -> Column:
    """The value stands on evidence."""
    return F.coalesce(trusted(F.col("value_json"), F.col("confidence"), F.col("page_no"), F.col("source_text"), F.col("needs_review"), default_review), F.lit(False))


def _same() -> Column:
    """The new value is still the one the diff shows."""
    return F.col("value_json").eqNullSafe(F.col("new_value_json"))


def _gate(default_review: bool) -> Column:
    return _same() & _stands(default_review)


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _decide(staged: DataFrame, target: Column, stale: str, *more: str) -> DataFrame:
    """``staged``: request_id, requested_at, value_id, stage ("ok" or the outcome). Adds decision, reason, and ``fresh`` on what changes the store.

    Of the other columns only those named here or in ``more`` are kept, and requests move by their id twice, the second time only those with something to settle.
    """
    kept = [c for c in ("request_id", "diff_id", "requested_at", "field_code", "new_version_id", "value_id", "stage", *more) if c in staged.columns]
    ok, calm = F.col("stage") == "ok", F.col("stage").isin("reused", "held")
    request = Window.partitionBy("request_id")  # as many rows as a request has fields
    marked = staged.filter("request_id is not null").select(*kept, target.alias("target")).withColumns({"_whole": F.bool_and(ok | calm).over(request), "_some": F.bool_or(ok).over(request)})
    marked = cut_lineage(marked.withColumn("_waits", F.col("_whole") & F.col("_some")).drop("_some"))  # read three times from here on
    claims = marked.filter("_waits and stage = 'ok'").select("request_id", "target", F.col("value_id").alias("choice"), F.struct("requested_at", "request_id").alias("ticket"))
    settled = settle(claims).groupBy(F.col("request_id").alias("_r")).agg(F.bool_and("won").alias("_won"), F.collect_set(F.when(F.col("fresh"), F.col("target"))).alias("_fresh"))
    waited = marked.filter("_waits").join(settled, F.col("request_id") == F.col("_r"), "left")
    waited = cut_lineage(waited.withColumn("fresh", _yes(ok & F.array_contains("_fresh", F.col("target")))).drop("_r", "_fresh"))
    joined = marked.filter("not _waits").withColumn("_won", F.lit(None).cast("boolean")).withColumn("fresh", F.lit(False)).unionByName(waited)
    lost = _yes(~F.col("_won"))
    done = F.col("_whole") & ~lost
    decision = F.when(~done, "refused").when(calm, F.col("stage")).when(F.col("fresh"), "applied").otherwise("reused")
    reason = (F.when(done, F.lit(None).cast("string")).when(~(ok | calm), F.col("stage"))
              .when(ok & lost, stale).otherwise("Another field of the request was refused"))
    return joined.withColumns({"decision": decision, "reason": reason, "fresh": F.col("fresh") & done}).drop("_whole", "_waits", "_won", "target")


def _decisions(decided: DataFrame) -> DataFrame:
    return decided.select("request_id", "field_code", "decision", "reason")


def _reviews(decided: DataFrame, reviewer: Column) -> DataFrame:
    return decided.filter("fresh").select("request_id", F.col("new_version_id").alias("document_version_id"), "field_code", reviewer.alias("reviewed_by"), F.col("requested_at").alias("reviewed_at"))


def _diff_changes(decided: DataFrame, store: Store, reviewer: str) -> DataFrame:
    """Diffs of applied requests are applied; held ones are reviewed, unless the batch applied them (before or after the hold)."""
    marks = decided.filter("fresh or decision = 'held'").groupBy("diff_id").agg(
        F.max("fresh").alias("_applied"), F.max(F.when(F.col("fresh"), F.col("requested_at"))).alias("_at"), F.max("requested_at").alias("_last"))
    status = F.when(F.col("_applied"), "applied").otherwise("reviewed")
    joined = store["diffs"].join(marks, "diff_id")
    return (joined.withColumn("review_status", status).withColumn("reviewed_at", F.coalesce("_at", "_last").cast(store["diffs"].schema["reviewed_at"].dataType))
            .withColumn("reviewed_by", F.lit(reviewer)).select(*store["diffs"].columns))


def _held_after(decided: DataFrame) -> DataFrame:
    """A hold that follows the adoption of the same diff finds it applied."""
    applied = decided.filter("fresh").groupBy(F.col("diff_id").alias("_d")).agg(F.min(F.struct("requested_at", "request_id")).alias("_applied"))
    held = decided.filter("decision = 'held'").join(applied, F.col("diff_id") == F.col("_d"), "left")
    late = _yes(F.struct("requested_at", "request_id") > F.col("_applied"))
    held = held.withColumn("decision", F.when(late, "reused").otherwise("held")).drop("_applied", "_d")
    return decided.filter("decision <> 'held'").unionByName(held)  # only holds move


def _approve(store: Store, on: DataFrame, off: DataFrame | None = None) -> DataFrame:
    """Value rows whose flags change. ``on``, ``off``: value_id."""
    marks = on.select(F.col("value_id").alias("extracted_value_id"), F.lit(True).alias("_flag"))
    if off is not None:
        marks = off.select(F.col("value_id").alias("extracted_value_id"), F.lit(False).alias("_flag")).unionByName(marks)
    marks = marks.groupBy("extracted_value_id").agg(F.max("_flag").alias("_flag"))
    joined = store["values"].join(marks, "extracted_value_id")
    return joined.withColumn("approved", F.col("_flag")).withColumn("reviewed", F.coalesce("reviewed", F.lit(False)) | F.col("_flag")).select(*store["values"].columns)


def _current_flags(store: Store, values: DataFrame, documents: DataFrame) -> DataFrame:
    """Versions of the named documents whose ``is_current`` differs from "holds an approved value"."""
    mine = store["versions"].join(documents.select("document_id").distinct(), "document_id", "left_semi")
    now = updated({"values": store["values"]}, {"values": values})["values"]
    held = now.join(mine.select("document_version_id"), "document_version_id", "left_semi").groupBy("document_version_id").agg(F.max(F.coalesce("approved", F.lit(False))).alias("_now"))
    joined = mine.join(held, "document_version_id", "left").withColumn("_now", F.coalesce("_now", F.lit(False)))
    return joined.filter(~F.col("_now").eqNullSafe(F.col("is_current"))).withColumn("is_current", F.col("_now")).select(*store["versions"].columns)


def _report_stage(joined: DataFrame, store: Store) -> DataFrame:
    """Adds current_id, current_date, baseline_id for (document, field) and the outcome of the report policy (``report_stage``)."""
    held = store["values"].filter("approved").join(store["versions"].select("document_version_id", "document_id"), "document_version_id")
    current = newest(held, ["document_id", "field_code"], [F.desc("created_at"), F.desc("extracted_value_id")]).select(
        F.col("document_id").alias("_d"), F.col("field_code").alias("_f"), F.col("extracted_value_id").alias("current_id"), F.col("value_as_of_date").alias("current_date"))
    base = store["baselines"].select(F.col("document_version_id").alias("_v"), F.col("field_code").alias("_g"), "baseline_id")
    joined = joined.join(current, (F.col("new_document_id") == F.col("_d")) & (F.col("field_code") == F.col("_f")), "left").drop("_d", "_f")
    joined = joined.join(base, (F.col("new_version_id") == F.col("_v")) & (F.col("field_code") == F.col("_g")), "left").drop("_v", "_g")
    stage = (F.when(F.trim(F.coalesce("reviewed_by", F.lit(""))) == "", "Reviewer required")
             .when(~_yes(F.col("document_type") == "important_report") | F.col("document_unit").isNull(), "Unit confirmation required")
             .when(is_absent(F.col("value_json")) | (F.coalesce("source_text", F.lit("")) == "") | F.col("page_no").isNull(), "Evidence required")
             .when(F.coalesce("needs_review", F.lit(True)) & ~_yes(F.col("verified")), "Resolve reading uncertainty before approval")
             .when(F.col("approved"), "reused")
             .when(~F.col("current_id").eqNullSafe(F.col("baseline_id")), "Review is stale")
             .when(F.col("current_date").isNotNull() & ~_yes(F.col("value_as_of_date") >= F.col("current_date")), "Older or unknown reference date")
             .otherwise("ok"))
    return joined.withColumn("report_stage", stage)


def approve_report(requests: DataFrame, store: Store) -> Adoption:
    """ADP-2: report values become the approved ones of their document, against the baseline recorded when they were saved.

    ``requests``: request_id, document_version_id, field_code, reviewed_by, verified, requested_at; one row per field, and a request
    applies with all its fields or with none. The value approved before is no longer; open diffs to the new value are applied; a
    version is current while it holds an approved value. ``store`` also has baselines (``BASELINES``).
    """
    asked = _with_new_side(requests.withColumnRenamed("document_version_id", "new_version_id"), store)
    asked = asked.join(_documents(store).withColumnRenamed("document_id", "new_document_id"), "new_document_id", "left")
    staged = _report_stage(asked, store).withColumnRenamed("report_stage", "stage")
    decided = _decide(staged, F.struct("new_document_id", "field_code"), "Review is stale", "new_document_id", "current_id", "reviewed_by")
    fresh = decided.filter("fresh")
    values = _approve(store, fresh, fresh.filter("current_id is not null").select(F.col("current_id").alias("value_id")))
    hits = fresh.groupBy("new_version_id", "field_code").agg(F.max_by("reviewed_by", "requested_at").alias("_by"), F.max("requested_at").alias("_at"))
    diffs = (store["diffs"].join(hits, ["new_version_id", "field_code"]).filter("review_status = 'unreviewed'").withColumn("review_status", F.lit("applied"))
             .withColumn("reviewed_by", F.col("_by")).withColumn("reviewed_at", F.col("_at").cast(store["diffs"].schema["reviewed_at"].dataType)).select(*store["diffs"].columns))
    versions = _current_flags(store, values, fresh.select(F.col("new_document_id").alias("document_id")))
    return Adoption(_decisions(decided), {"values": values, "diffs": diffs, "versions": versions, "reviews": _reviews(decided, F.col("reviewed_by"))})


def _opening() -> Column:
    """Checks that the master and pointer policies start with."""
    status = F.col("review_status")
    return (F.when(status == "applied", "reused").when(~_yes(status.isin(*OPEN_STATUSES)), "Not reviewable").when(F.col("action") == "hold", "held")
            .when(~F.col("action").eqNullSafe(F.lit("adopt")), "Invalid decision"))


def _best_rules(store: Store) -> DataFrame:
    """Of each rules document and field the best reading (_bv, _bj) and the best of another version (_sj): enough to leave any one version out."""
    rules = store["documents"].filter("document_type = 'management_rules'").select("document_id")
    versions = store["versions"].select("document_version_id", "document_id", "version_no").join(rules, "document_id", "left_semi")
    held = store["values"].select("document_version_id", "field_code", "value_json", "approved").join(versions, "document_version_id")
    rank = [F.desc_nulls_last("approved"), F.desc("version_no"), F.desc("document_version_id")]
    place = Window.partitionBy("document_id", "field_code").orderBy(*rank)
    one = newest(held, ["document_version_id", "document_id", "field_code"], rank)  # as the rows lie after the join
    two = one.withColumn("_place", F.row_number().over(place)).filter("_place <= 2")  # each task sends two at most
    return two.withColumn("_sj", F.lead("value_json").over(place)).filter("_place = 1").select(
        F.col("document_id").alias("_bd"), F.col("field_code").alias("_bf"), F.col("document_version_id").alias("_bv"), F.col("value_json").alias("_bj"), "_sj")


def adopt_rules(requests: DataFrame, store: Store, reviewer: str = "reviewer") -> Adoption:
    """ADP-3: rules of the building a case lies in. A missing review flag blocks; the old side is the best other version of the document.

    ``requests``: request_id, diff_id, case_id, action (adopt or hold), requested_at. The adopted value is approved beside the others.
    Lookups are as in ``adopt_pointer``.
    """
    buildings = store["cases"].select("case_id", "unit_id").join(store["units"].select("unit_id", "building_id"), "unit_id").select("case_id", F.col("building_id").alias("case_building"))
    asked = _with_diffs(requests, store)
    opening = (F.when(F.col("review_status") == "applied", "reused").when(F.col("action") == "hold", "held")
               .when(~F.col("action").eqNullSafe(F.lit("adopt")), "Evidence review required"))
    asked = asked.withColumn("_opening", opening).drop("affected_field", "old_version_id", "review_status", "action")
    asked = asked.join(_new_values(store, _stands(True).alias("_stands")).drop("value_as_of_date"), ["new_version_id", "field_code"], "left")
    gate = _same() & _yes(F.col("_stands"))
    asked = asked.withColumn("_opening", F.coalesce("_opening", F.when(~gate, "Evidence review required"))).drop("value_json", "new_value_json", "_stands")
    asked = cut_lineage(asked).join(_documents(store), "document_id", "left")
    asked = asked.withColumn("_building", F.when(F.col("document_type") == "management_rules", F.col("document_building"))).drop("document_type", "document_unit", "document_building")
    asked = asked.join(buildings, "case_id", "left").withColumn("_there", _yes(F.col("_building") == F.col("case_building"))).drop("_building", "case_building")
    asked = asked.join(_best_rules(store), (F.col("document_id") == F.col("_bd")) & (F.col("field_code") == F.col("_bf")), "left")
    other = F.when(F.col("_bv").eqNullSafe(F.col("new_version_id")), F.col("_sj")).otherwise(F.col("_bj"))
    stage = (F.when(~F.col("_there"), "Case mismatch").when(F.col("_opening").isNotNull(), F.col("_opening"))
             .when(~other.eqNullSafe(F.col("old_value_json")), "Stale review").otherwise("ok"))
    decided = _decide(asked.withColumn("stage", stage), F.struct("document_id", "field_code"), "Stale review")
    return Adoption(_decisions(_held_after(decided)), {"values": _approve(store, decided.filter("fresh")), "diffs": _diff_changes(decided, store, reviewer), "reviews": _reviews(decided, F.lit(reviewer))})


def _pointed(store: Store) -> DataFrame:
    """Cases with their unit's building, and under ``_now`` what the values they point to say."""
    cases = store["cases"].select("case_id", F.col("unit_id").alias("case_unit"), "purchase_values").join(store["units"].select(F.col("unit_id").alias("case_unit"), F.col("building_id").alias("case_building")), "case_unit", "left")
    named = store["cases"].select(F.col("case_id").alias("_case"), F.explode(F.map_values("purchase_values")).alias("now_id"))
    values = store["values"].select(F.col("extracted_value_id").alias("now_id"), F.col("value_json").alias("now_json"), F.col("document_version_id").alias("now_version"), F.col("value_as_of_date").alias("now_date"))
    now = named.join(values, "now_id").groupBy("_case").agg(F.collect_list(F.struct("now_id", "now_json", "now_version", "now_date")).alias("_now"))  # at most the catalog's fields
    return cases.join(now, F.col("case_id") == F.col("_case"), "left").drop("_case")


def adopt_pointer(requests: DataFrame, store: Store, reviewer: str = "reviewer") -> Adoption:
    """ADP-4: a case points to newer evidence of a field; stale by value and version, and never to older data.

    ``requests``: request_id, diff_id, case_id, action, requested_at. The old side is what ``cases.purchase_values`` names now.
    Each lookup moves all requests, so what it settles becomes one column before the next; rows are cut after the two large tables.
    """
    asked = _with_diffs(requests, store)
    asked = asked.withColumn("_mine", F.col("affected_field").eqNullSafe(F.concat(F.lit("purchase:"), F.col("case_id")))).withColumn("_opening", _opening()).drop("affected_field", "review_status", "action")
    asked = asked.join(_new_values(store, _stands(False).alias("_stands")), ["new_version_id", "field_code"], "left")
    asked = cut_lineage(asked.withColumn("_gate", _same() & _yes(F.col("_stands"))).drop("value_json", "new_value_json", "_stands")).join(_documents(store), "document_id", "left")
    shared = F.col("document_unit").isNull() & (F.col("document_type") == "management_rules")
    asked = asked.withColumn("_source", _yes(F.col("document_type") == value_source(F.col("field_code")))).withColumn("_shared", _yes(shared)).drop("document_type", "document_id")
    asked = asked.join(_pointed(store), "case_id", "left").withColumn("_id", F.try_element_at("purchase_values", F.col("field_code")))
    asked = asked.withColumn("_at", F.get(F.filter("_now", lambda n: n["now_id"] == F.col("_id")), F.lit(0)))
    source = (_yes(F.col("document_unit") == F.col("case_unit")) | (F.col("_shared") & _yes(F.col("document_building") == F.col("case_building")))) & F.col("_source")
    stage = (F.when(F.col("purchase_values").isNull() | ~F.col("_mine"), "Case mismatch")
             .when(F.col("_opening").isNotNull(), F.col("_opening")).when(~source, "Source mismatch").when(~F.col("_gate"), "Evidence review required")
             .when(~F.col("_at.now_json").eqNullSafe(F.col("old_value_json")) | ~F.col("_at.now_version").eqNullSafe(F.col("old_version_id")), "Review is stale")
             .when(_yes(F.col("value_as_of_date") < F.col("_at.now_date")), "Older source").otherwise("ok"))
    decided = _decide(asked.withColumn("stage", stage), F.struct("case_id", "field_code"), "Review is stale", "case_id")
    moved = decided.filter("fresh").groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("field_code", "value_id"))).alias("_new"))  # at most the catalog's fields
    kept = F.map_filter("purchase_values", lambda k, _: ~F.map_contains_key(F.col("_new"), k))
    changed = store["cases"].join(moved, "case_id").withColumn("purchase_values", F.map_concat(kept, "_new")).select(*store["cases"].columns)
    return Adoption(_decisions(_held_after(decided)), {"cases": changed, "diffs": _diff_changes(decided, store, reviewer), "reviews": _reviews(decided, F.lit(reviewer))})


def adopt_master(requests: DataFrame, store: Store, catalog: DataFrame, reviewer: str = "reviewer") -> Adoption:
    """ADP-1: readings become values of the unit or building master they are about.

    ``requests``: request_id, diff_id, unit_id (null where none was named), action, requested_at; ``catalog``: field_code, entity_level.
    A report reading also has to pass the report policy and is approved by it; it may fill a master that is still empty.
    """
    asked = _diff_requests(requests.withColumnRenamed("unit_id", "asked_unit"), store)
    asked = asked.join(catalog.select("field_code", "entity_level"), "field_code", "left").withColumn("reviewed_by", F.lit(reviewer)).withColumn("verified", F.lit(False))
    asked = _report_stage(asked, store)
    entity = F.when(F.col("entity_level") == "unit", F.col("document_unit")).when(F.col("entity_level") == "building", F.col("document_building"))
    asked = asked.withColumn("entity_id", entity)
    masters, fields = None, {}
    for level, name in (("unit", "units"), ("building", "buildings")):
        plain = [f.name for f in store[name].schema if f.name not in ("unit_id", "building_id", "updated_at") and f.dataType.simpleString().split("<")[0] not in ("array", "map", "struct")]
        fields[name] = plain
        long = unpivot_master(store[name], KEYS[name][0], plain).select(F.lit(level).alias("_level"), F.col(KEYS[name][0]).alias("_id"), F.col("field_code").alias("_f"), "master_json")
        masters = long if masters is None else masters.unionByName(long)
    column = F.when(F.col("entity_level") == "unit", F.col("field_code").isin(*fields["units"])).when(F.col("entity_level") == "building", F.col("field_code").isin(*fields["buildings"]))
    asked = asked.join(masters.withColumn("_has", F.lit(True)), (F.col("entity_level") == F.col("_level")) & (F.col("entity_id") == F.col("_id")) & (F.col("field_code") == F.col("_f")), "left").drop("_level", "_id", "_f")
    bare = F.regexp_replace("old_value_json", '^"|"$', "")
    same = F.col("master_json").eqNullSafe(F.when(~is_absent(F.col("old_value_json")), bare))
    fills = F.col("master_json").isNull() & (F.col("document_type") != "registry")
    opening = _opening()
    stage = (F.when(F.col("document_unit").isNull() | _yes(F.col("asked_unit") != F.col("document_unit")), "Unit mismatch").when(opening.isNotNull(), opening)
             .when(is_absent(F.col("new_value_json")), "Invalid decision").when(~_gate(False), "Evidence review required")
             .when(~_yes(F.col("entity_level").isin("unit", "building")), "Unsupported field").when(F.col("entity_id").isNull(), "Missing target")
             .when(_yes(column) & F.col("_has").isNull(), "Missing master").when(_yes(column) & ~(same | _yes(fills)), "Master changed; reload")
             .when(~_yes(F.col("document_type").isin("registry", "important_report")), "Unsupported document")
             .when((F.col("document_type") == "registry") & ~F.col("field_code").isin(*MASTER_DIFF_FIELDS), "Unsupported registry diff")
             .when(F.col("document_type") == "important_report", F.col("report_stage")).otherwise("ok"))
    decided = _decide(asked.withColumn("stage", stage).withColumn("_column", _yes(column)), F.struct("entity_level", "entity_id", "field_code"), "Master changed; reload",
                      "entity_level", "entity_id", "_column", "new_value_json", "document_type", "document_id", "current_id")
    fresh = decided.filter("fresh")
    off = fresh.filter("document_type = 'important_report' and current_id is not null").select(F.col("current_id").alias("value_id"))
    values = _approve(store, fresh, off)
    changes = {"values": values, "diffs": _diff_changes(decided, store, reviewer), "reviews": _reviews(decided, F.lit(reviewer)),
               "versions": _current_flags(store, values, fresh.filter("document_type = 'important_report'").select("document_id"))}
    for level, name in (("unit", "units"), ("building", "buildings")):
        key = KEYS[name][0]
        mine = fresh.filter((F.col("entity_level") == level) & F.col("_column"))
        wide = mine.groupBy(F.col("entity_id").alias(key)).agg(F.max("requested_at").alias("_at"), *[
            F.max(F.when(F.col("field_code") == f, F.struct(F.regexp_replace("new_value_json", '^"|"$', "").alias("v")))).alias(f"_new_{f}") for f in fields[name]])
        joined = store[name].join(wide, key)
        for f in fields[name]:
            joined = joined.withColumn(f, F.when(F.col(f"_new_{f}").isNotNull(), F.col(f"_new_{f}.v").try_cast(store[name].schema[f].dataType)).otherwise(F.col(f)))
        if "updated_at" in store[name].columns:
            joined = joined.withColumn("updated_at", F.col("_at").cast(store[name].schema["updated_at"].dataType))
        changes[name] = joined.select(*store[name].columns)
    return Adoption(_decisions(_held_after(decided)), changes)
