"""Adoption decisions (ADP-1..6, JN-9, JN-13, JN-14, AGG-19, AGG-22, SNK-2).

Each operator returns one row per request with ``decision`` (applied, reused, held, refused) and
``reason``. A batch has one writer: of several requests that could apply to the same target, the
earliest applies and the others are stale, because they see its value.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.evidence import choice_key, is_absent, value_source
from .versions import MASTER_DIFF_FIELDS, OPEN_STATUSES


def _first_wins(staged: DataFrame, target: list[str]) -> DataFrame:
    """Settle requests whose ``_stage`` is "ok": the earliest per target applies.

    The earliest is found by a map-side combined minimum, so a much requested target stays cheap.
    """
    ok = F.col("_stage") == "ok"
    ticket = F.struct("requested_at", "diff_id")
    first = staged.groupBy(*target).agg(F.min(F.when(ok, ticket)).alias("_first"))
    on = F.lit(True)
    for t in target:
        on = on & F.col(t).eqNullSafe(F.col(f"_t_{t}"))
    first = first.withColumnsRenamed({t: f"_t_{t}" for t in target})
    joined = staged.join(first, on, "left").drop(*[f"_t_{t}" for t in target])
    won = ok & (ticket == F.col("_first"))
    decision = (F.when(F.col("_stage").isin("held", "reused"), F.col("_stage"))
                .when(won, "applied").otherwise("refused"))
    reason = (F.when(F.col("_stage").isin("held", "reused") | won, F.lit(None).cast("string"))
              .when(ok, F.col("_stale")).otherwise(F.col("_stage")))
    return joined.withColumn("decision", decision).withColumn("reason", reason).drop("_stage", "_first", "_stale")


def _opening(requests: DataFrame) -> Column:
    """Checks every policy starts with, in order."""
    status = F.col("review_status")
    return (F.when(status == "applied", "reused")
            .when(~status.isin(*OPEN_STATUSES), "Not reviewable")
            .when(F.col("action") == "hold", "held")
            .when(~F.col("action").eqNullSafe(F.lit("adopt")), "Invalid decision"))


def stale_check(requests: DataFrame, current: DataFrame, id_col: str = "unit_id") -> DataFrame:
    """JN-13: does the master still hold the old value? ``current``: id, field_code, master_json.

    A report reading may also fill a master that is still empty. A field without master column passes.
    """
    cur = current.select(F.col(id_col).alias("_id"), F.col("field_code").alias("_f"), "master_json", F.lit(True).alias("_has"))
    joined = requests.join(cur, (F.col(id_col) == F.col("_id")) & (F.col("field_code") == F.col("_f")), "left")
    fills = (F.col("document_type") != "registry") & is_absent(F.col("master_json"))
    fresh = F.col("master_json").eqNullSafe(F.col("old_json")) | fills | F.col("_has").isNull()
    return joined.withColumn("is_fresh", fresh).drop("_id", "_f", "_has")


def adopt_master(requests: DataFrame, current: DataFrame) -> DataFrame:
    """ADP-1: adopt or hold changes to unit and building masters.

    ``requests``: diff_id, unit_id, asked_unit_id, field_code, review_status, action, old_json, new_json,
    is_trusted, entity_level, document_type, requested_at.
    """
    checked = stale_check(requests, current)
    registry_field = (F.col("document_type") != "registry") | F.col("field_code").isin(*MASTER_DIFF_FIELDS)
    stage = (F.when(~F.col("unit_id").eqNullSafe(F.col("asked_unit_id")) | F.col("unit_id").isNull(), "Unit mismatch")
             .when(_opening(requests).isNotNull(), _opening(requests))
             .when(is_absent(F.col("new_json")), "Invalid decision")
             .when(~F.coalesce(F.col("is_trusted"), F.lit(False)), "Evidence review required")
             .when(~F.coalesce(F.col("entity_level").isin("unit", "building"), F.lit(False)), "Unsupported field")
             .when(~F.col("is_fresh"), "Master changed; reload")
             .when(~F.col("document_type").isin("registry", "important_report"), "Unsupported document")
             .when(~registry_field, "Unsupported registry diff").otherwise("ok"))
    staged = checked.withColumn("_stage", stage).withColumn("_stale", F.lit("Master changed; reload"))
    return _first_wins(staged, ["unit_id", "field_code"])


def approve_report(requests: DataFrame) -> DataFrame:
    """ADP-2: approve report values against the baseline recorded when they were saved.

    ``requests``: diff_id, document_id, field_code, value_json, source_text, page_no, needs_review, approved,
    verified, reviewed_by, as_of_date, baseline_id, current_id, current_date, requested_at.
    """
    stage = (F.when(F.trim(F.coalesce(F.col("reviewed_by"), F.lit(""))) == "", "Reviewer required")
             .when(is_absent(F.col("value_json")) | (F.coalesce(F.col("source_text"), F.lit("")) == "") | F.col("page_no").isNull(), "Evidence required")
             .when(F.coalesce(F.col("needs_review"), F.lit(True)) & ~F.coalesce(F.col("verified"), F.lit(False)), "Resolve reading uncertainty before approval")
             .when(F.coalesce(F.col("approved"), F.lit(False)), "reused")
             .when(~F.col("current_id").eqNullSafe(F.col("baseline_id")), "Review is stale")
             .when(F.col("current_date").isNotNull() & (F.col("as_of_date").isNull() | (F.col("as_of_date") < F.col("current_date"))), "Older or unknown reference date")
             .otherwise("ok"))
    staged = requests.withColumn("_stage", stage).withColumn("_stale", F.lit("Review is stale"))
    return _first_wins(staged, ["document_id", "field_code"])


def adopt_rules(requests: DataFrame) -> DataFrame:
    """ADP-3: building rules; a missing review flag blocks. The old side is the best other version.

    ``requests``: diff_id, document_id, building_id, case_building_id, field_code, review_status, action,
    old_json, new_json, is_trusted (gated with default review), other_json, requested_at.
    """
    stage = (F.when(~F.col("building_id").eqNullSafe(F.col("case_building_id")), "Case mismatch")
             .when(F.col("review_status") == "applied", "reused")
             .when(F.col("action") == "hold", "held")
             .when(~F.col("action").eqNullSafe(F.lit("adopt")) | is_absent(F.col("new_json"))
                   | ~F.coalesce(F.col("is_trusted"), F.lit(False)), "Evidence review required")
             .when(~F.col("other_json").eqNullSafe(F.col("old_json")), "Stale review").otherwise("ok"))
    staged = requests.withColumn("_stage", stage).withColumn("_stale", F.lit("Stale review"))
    return _first_wins(staged, ["document_id", "field_code"])


def adopt_pointer(requests: DataFrame, pointers: DataFrame, values: DataFrame) -> DataFrame:
    """ADP-4: move a case's evidence pointer; stale by value and version, and never to older data.

    ``requests``: diff_id, case_id, field_code, in_scope, document_type, review_status, action, old_json,
    old_version_id, new_json, as_of_date, is_trusted, requested_at.
    """
    now = pointers.join(values.select("value_id", F.col("value_json").alias("_now_json"), F.col("version_id").alias("_now_version"),
                                      F.col("as_of_date").alias("_now_date")), "value_id").drop("value_id")
    joined = requests.join(now, ["case_id", "field_code"], "left")
    source_ok = F.col("in_scope") & (F.col("document_type") == value_source(F.col("field_code")))
    stage = (F.when(_opening(requests).isNotNull(), _opening(requests))
             .when(~F.coalesce(source_ok, F.lit(False)), "Source mismatch")
             .when(is_absent(F.col("new_json")) | ~F.coalesce(F.col("is_trusted"), F.lit(False)), "Evidence review required")
             .when(~F.col("_now_json").eqNullSafe(F.col("old_json")) | ~F.col("_now_version").eqNullSafe(F.col("old_version_id")), "Review is stale")
             .when(F.coalesce(F.col("as_of_date") < F.col("_now_date"), F.lit(False)), "Older source").otherwise("ok"))
    staged = joined.withColumn("_stage", stage).withColumn("_stale", F.lit("Review is stale"))
    return _first_wins(staged, ["case_id", "field_code"]).drop("_now_json", "_now_version", "_now_date")


def keep_old(choices: DataFrame, diffs: DataFrame) -> DataFrame:
    """ADP-5: choosing the old side holds the diff and stores a choice bound to both values."""
    open_ = diffs.filter(~F.col("review_status").isin("applied", "ignored"))
    joined = choices.join(open_.select("diff_id", "old_json", "new_json"), "diff_id", "left")
    found = F.col("new_json").isNotNull() | F.col("old_json").isNotNull()
    return (joined.withColumn("choice_key", F.when(found, choice_key(F.col("diff_id"), F.col("old_json"), F.col("new_json"))))
            .withColumn("decision", F.when(found, "held").otherwise("refused"))
            .withColumn("reason", F.when(~found, "Not reviewable")))


def init_pointers(cases: DataFrame, baseline: DataFrame) -> DataFrame:
    """ADP-6: first pointers of cases that have none, one row per field (WIN-3 gives the baseline)."""
    fresh = cases.filter("purchase_values is null").select("case_id", "unit_id")
    return fresh.join(baseline.select("unit_id", "field_code", "value_id"), "unit_id").select("case_id", "field_code", "value_id")


def pointer_map(pointers: DataFrame) -> DataFrame:
    """Pointers of a case as one map; a case has at most one entry per catalog field."""
    return pointers.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("field_code", "value_id"))).alias("purchase_values"))


def adopted_values(cases: DataFrame, values: DataFrame) -> DataFrame:
    """JN-14: the evidence rows a case points to."""
    pointed = cases.select("case_id", F.explode("purchase_values").alias("field_code", "value_id"))
    return pointed.join(values.drop("field_code"), "value_id")


def mark_accepted(values: DataFrame, pointers: DataFrame) -> DataFrame:
    """JN-14: flag readings that are the adopted ones."""
    p = pointers.select("value_id").dropDuplicates().withColumn("_in", F.lit(True))
    return values.join(p, "value_id", "left").withColumn("accepted", F.coalesce("_in", F.lit(False))).drop("_in")


def confirm_batch(candidates: DataFrame, selections: DataFrame, keys: list[str], candidate: str) -> DataFrame:
    """AGG-22: within each selected group the chosen candidate adopts and every other one holds.

    A selection whose choice is no longer a candidate fails only its own group.
    """
    def equal(prefix: str, cols: list[str]) -> Column:
        on = F.lit(True)
        for c in cols:
            on = on & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
        return on

    offered = candidates.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col(candidate).alias("_o_chosen"))
    picked = selections.filter("chosen is not null").join(offered, equal("_o_", [*keys, "chosen"]), "left_semi")
    known = selections.filter("chosen is null").unionByName(picked).withColumn("_known", F.lit(True))
    lost = selections.filter("chosen is not null").join(offered, equal("_o_", [*keys, "chosen"]), "left_anti").withColumn("_known", F.lit(False))
    settled = known.unionByName(lost).withColumnsRenamed({k: f"_s_{k}" for k in keys})
    joined = candidates.join(settled, equal("_s_", keys))
    action = F.when(~F.col("_known"), "reload").when(F.coalesce(F.col(candidate) == F.col("chosen"), F.lit(False)), "adopt").otherwise("hold")
    return joined.withColumn("action", action).drop("_known", *[f"_s_{k}" for k in keys])


def review_route(affected_field: Column, document_type: Column) -> Column:
    """Which adoption policy a confirmed candidate goes to."""
    return (F.when(F.coalesce(affected_field, F.lit("")).startswith("purchase:"), "pointer")
            .when(document_type == "management_rules", "rules").otherwise("master"))


def split_reused(incoming: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """JN-9: a row whose key an earlier row carries is reused; ``first_id`` is that row."""
    first = incoming.groupBy(*keys).agg(F.min(id_col).alias("first_id"))
    return incoming.join(first, keys).withColumn("status", F.when(F.col(id_col) == F.col("first_id"), "new").otherwise("reused"))


def not_imported(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """JN-9 / SNK-1: incoming rows whose null-safe key is not stored yet."""
    stored = existing.select(*[F.col(k).alias(f"_x_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_x_{k}"))
    return incoming.join(stored, on, "left_anti")


def review_log(decisions: DataFrame) -> DataFrame:
    """AGG-19: one log row per applied decision."""
    return decisions.filter("decision = 'applied'").select("diff_id", "field_code", "reviewed_by", F.col("requested_at").alias("reviewed_at"))


def apply_master(master: DataFrame, adopted: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """SNK-2: new master snapshot; adopted values replace the old ones column by column.

    ``adopted``: id, field_code, value. Fields are the catalog's, so the pivot has a fixed width.
    """
    wide = adopted.groupBy(id_col).agg(*[
        F.max(F.when(F.col("field_code") == f, F.struct(F.col("value").alias("v")))).alias(f"_new_{f}") for f in fields])
    joined = master.join(wide, id_col, "left")
    for f in fields:
        kind = master.schema[f].dataType
        joined = joined.withColumn(f, F.when(F.col(f"_new_{f}").isNotNull(), F.col(f"_new_{f}.v").try_cast(kind)).otherwise(F.col(f)))
    return joined.drop(*[f"_new_{f}" for f in fields])
