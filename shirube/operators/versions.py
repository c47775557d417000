"""Versions, baselines and changes (WIN-1..5, 18..20, JN-9, JN-12, DIF-1..5, AGG-11, AGG-16, AGG-20, WIN-12)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.evidence import is_absent, trusted, value_source
from .ordered import Last, newest, row_numbers, scan

# ---- fixed values: registry fields that are compared with the unit master --------------------
MASTER_DIFF_FIELDS = ("current_owner_name", "current_owner_address", "active_mortgages", "registered_area",
                      "land_right_type", "land_right_numerator", "land_right_denominator")
OPEN_STATUSES = ("unreviewed", "reviewed")
# -----------------------------------------------------------------------------------------------

FIELD_KEYS = ["document_id", "field_code"]
VERSION_ORDER = ["as_of_date", "version_id"]


def year_bucket(col: str = "as_of_date") -> Column:
    """Order-following bucket for dated versions."""
    return F.coalesce(F.year(col), F.lit(0))


def latest_version(versions: DataFrame) -> DataFrame:
    """WIN-1: the current version of a document, else the highest number."""
    return newest(versions, ["document_id"], [F.desc("is_current"), F.desc("version_no")])


def number_versions(new: DataFrame, existing: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """WIN-2: version numbers continue after the highest stored one."""
    stored = existing.groupBy("document_id").agg(F.max("version_no").alias("_stored"))
    placed = row_numbers(new, ["document_id"], bucket, order, "_place")
    return (placed.join(stored, "document_id", "left")
            .withColumn("version_no", F.coalesce("_stored", F.lit(0)) + F.col("_place")).drop("_stored", "_place"))


def gated(values: DataFrame, default_review: bool = False) -> DataFrame:
    """FLT-1 as a column ``is_trusted``."""
    return values.withColumn("is_trusted", trusted(
        F.col("value_json"), F.col("confidence"), F.col("page_no"), F.col("source_text"), F.col("needs_review"), default_review))


def initial_baseline(values: DataFrame, keys: list[str], recency: list[Column]) -> DataFrame:
    """WIN-3: per key the trusted value to start from; approved ones first, then the newest."""
    return newest(gated(values).filter("is_trusted"), keys, [F.desc("approved"), *recency])


def latest_by_source(values: DataFrame, keys: list[str], recency: list[Column]) -> DataFrame:
    """WIN-4: newest value of each field, read only from the field's own source type."""
    own = values.filter((F.col("document_type") == value_source(F.col("field_code"))) & ~is_absent(F.col("value_json")))
    return newest(own, keys, recency)


def with_previous(values: DataFrame, policy: str, bucket: Column | None = None,
                  keys: list[str] = FIELD_KEYS, order: list[str] = VERSION_ORDER) -> DataFrame:
    """WIN-5: the earlier reading each value is compared with, as struct ``old``.

    ``approved``: the last approved earlier reading. ``rules``: that one, else the reading just before.
    """
    reading = F.struct("version_id", "value_json", "as_of_date")
    outputs = {"_approved": Last(F.when(F.col("approved"), reading), inclusive=False)}
    if policy == "rules":
        outputs["_before"] = Last(reading, inclusive=False)
    found = scan(values, keys, year_bucket() if bucket is None else bucket, order, outputs)
    old = F.coalesce(*[F.col(name) for name in outputs])
    return found.withColumn("old", old).drop(*outputs)


def _changed(found: DataFrame) -> DataFrame:
    return found.filter(F.col("old").isNotNull() & ~F.col("old.value_json").eqNullSafe(F.col("value_json")))


def diff_report(values: DataFrame, **kw) -> DataFrame:
    """DIF-2: against the last approved value. A change to "unknown" stays visible but can never be adopted."""
    return _changed(with_previous(values, "approved", **kw)).withColumn("adoptable", ~is_absent(F.col("value_json")))


def diff_rules(values: DataFrame, **kw) -> DataFrame:
    """DIF-3: against the last approved value, else the version before."""
    return _changed(with_previous(values, "rules", **kw))


def unpivot_master(master: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Wide master rows to (id, field_code, master_json)."""
    return master.select(id_col, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(
        [id_col], fields, "field_code", "master_json")


def diff_master(values: DataFrame, master: DataFrame, id_col: str, known: DataFrame | None = None,
                fields: tuple[str, ...] = MASTER_DIFF_FIELDS) -> DataFrame:
    """DIF-1: readings of whitelisted fields that differ from the master row.

    ``known`` holds (id, field_code, old_json, new_json) already recorded; those are not repeated.
    """
    usable = values.filter(F.col("field_code").isin(*fields) & ~is_absent(F.col("value_json")))
    sides = usable.join(unpivot_master(master, id_col, list(fields)), [id_col, "field_code"])
    diffs = (sides.filter(~F.col("master_json").eqNullSafe(F.col("value_json")))
             .withColumnsRenamed({"master_json": "old_json", "value_json": "new_json"}))
    if known is not None:
        k = known.select(*[F.col(c).alias(f"_{c}") for c in (id_col, "field_code", "old_json", "new_json")])
        seen = F.lit(True)
        for c in (id_col, "field_code", "old_json", "new_json"):
            seen = seen & F.col(c).eqNullSafe(F.col(f"_{c}"))
        diffs = diffs.join(k, seen, "left_anti")
    return diffs


def diff_adopted(newest_values: DataFrame, pointers: DataFrame, values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """DIF-4: newest source value against the evidence the case points to; older data never wins.

    ``pointers``: case_id, field_code, value_id. ``newest_values`` carries case_id and field_code.
    """
    old = values.select(F.col("value_id"), F.col("version_id").alias("old_version_id"),
                        F.col("value_json").alias("old_json"), F.col("as_of_date").alias("old_date"))
    base = pointers.join(old, "value_id", "left").drop("value_id")
    sides = newest_values.join(base, ["case_id", "field_code"], "left")
    older = F.coalesce(F.col("as_of_date") < F.col("old_date"), F.lit(False))
    diffs = sides.filter(~F.col("value_json").eqNullSafe(F.col("old_json")) & ~older)
    if known is not None:
        k = known.select(F.col("case_id").alias("_c"), F.col("field_code").alias("_f"),
                         F.col("new_version_id").alias("_v"), F.col("old_json").alias("_o"))
        diffs = diffs.join(k, (F.col("case_id") == F.col("_c")) & (F.col("field_code") == F.col("_f"))
                           & (F.col("version_id") == F.col("_v")) & F.col("old_json").eqNullSafe(F.col("_o")), "left_anti")
    return diffs


def diff_local_report(values: DataFrame, previous: DataFrame) -> DataFrame:
    """DIF-5: an unsaved reading against the case's earlier report values; shown, never adoptable."""
    old = previous.select("case_id", "field_code", F.col("value_json").alias("old_json"))
    return (values.join(old, ["case_id", "field_code"])
            .filter(~is_absent(F.col("value_json")) & ~F.col("value_json").eqNullSafe(F.col("old_json")))
            .withColumn("can_adopt", F.lit(False)))


def diff_sides(diffs: DataFrame, values: DataFrame, versions: DataFrame, labels: DataFrame) -> DataFrame:
    """JN-12: both evidence sides of every diff. ``labels`` is the small field catalog."""
    def side(prefix: str) -> DataFrame:
        v = values.select("version_id", "field_code", "value_json", "confidence", "page_no", "source_text", "value_as_of_date", "needs_review")
        meta = versions.select("version_id", "original_filename", "as_of_date", "uploaded_at")
        both = gated(v).join(meta, "version_id", "left")
        date = F.coalesce(F.col("value_as_of_date").cast("string"), F.col("as_of_date").cast("string"), F.col("uploaded_at").cast("string"))
        return both.select(F.col("version_id").alias(f"{prefix}_version_id"), "field_code",
                           F.col("original_filename").alias(f"{prefix}_filename"), date.alias(f"{prefix}_date"),
                           F.col("page_no").alias(f"{prefix}_page"), F.col("source_text").alias(f"{prefix}_quote"),
                           F.col("is_trusted").alias(f"{prefix}_trusted"))
    return (diffs.join(side("new"), ["new_version_id", "field_code"], "left")
            .join(side("old"), ["old_version_id", "field_code"], "left")
            .join(labels.select("field_code", "label"), "field_code", "left")
            .withColumn("label", F.coalesce("label", "field_code"))
            .withColumn("new_trusted", F.coalesce("new_trusted", F.lit(False))))


def recommend(sides: DataFrame, keys: list[str], candidate: str, date: str = "new_date",
              base_date: str = "old_date", trust: str = "new_trusted") -> DataFrame:
    """AGG-11 + WIN-12: one row per candidate group.

    The newest trusted candidate is recommended only when it is dated after the baseline; ties go to
    the smallest candidate id. Candidates stay rows of ``sides``; groups hold counts, not arrays.
    """
    ok = F.col(trust)
    day = F.coalesce(F.col(date).cast("string"), F.lit(""))
    pick = F.min_by(candidate, F.when(ok, _newest_first(day, F.col(candidate))))
    return (sides.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(ok).alias("trusted_candidates"),
        pick.alias("_best"),
        F.max(F.when(ok, day)).alias("_best_date"),
        F.max(F.coalesce(F.col(base_date).cast("string"), F.lit(""))).alias("_base_date"))
        .withColumn("recommended", F.when(F.col("_best_date") > F.col("_base_date"), F.col("_best")))
        .drop("_best", "_best_date", "_base_date"))


def _newest_first(day: Column, candidate: Column) -> Column:
    """Sort key whose minimum is the latest day and, within it, the smallest candidate."""
    flipped = F.translate(day, "0123456789", "9876543210")
    return F.struct(F.when(day == "", "~").otherwise(flipped).alias("d"), candidate.alias("c"))


def current_versions(values: DataFrame) -> DataFrame:
    """AGG-20: a version is current while any of its values is approved."""
    return values.groupBy("version_id").agg(F.bool_or("approved").alias("is_current"))


def approved_fields(values: DataFrame) -> DataFrame:
    """AGG-16: approved values of a version, one row per field."""
    return values.filter("approved").select("version_id", "field_code", "value_json", "confidence",
                                            "needs_review", "source_text", "page_no", "value_as_of_date")


def latest_overlay(overlays: DataFrame, mode: str) -> DataFrame:
    """WIN-18: newest human check, per field (disclosures) or the newest whole file (rules)."""
    if mode == "field":
        return newest(overlays, ["file_hash", "field_code"], [F.desc("verified_at")])
    top = overlays.groupBy("file_hash", "overlay_id").agg(F.max("verified_at").alias("_at"))
    chosen = newest(top, ["file_hash"], [F.desc("_at"), F.asc("overlay_id")]).drop("_at")
    return overlays.join(chosen, ["file_hash", "overlay_id"], "left_semi")


def first_import(imports: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-19: the earliest import is the base record."""
    return newest(imports, keys, [F.asc("created_at"), F.asc("content_hash")])


def since_last_reset(entries: DataFrame, keys: list[str], order: str, is_reset: Column) -> DataFrame:
    """WIN-20: entries before the last whole replacement no longer matter.

    The cut is a map-side combined maximum joined back, so a long ledger is never gathered.
    """
    cut = entries.filter(is_reset).groupBy(*keys).agg(F.max(order).alias("_reset"))
    return (entries.join(cut, keys, "left")
            .filter(F.col("_reset").isNull() | (F.col(order) >= F.col("_reset"))).drop("_reset"))
