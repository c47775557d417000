"""Counts, single-hit extraction, costs, jobs and inventories (AGG-*, SET-*, STR batch forms)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_applicable, zone_key
from .ordered import Running, newest, scan


def single_hit(hits: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-1: a label's value counts only if it was found exactly once; ``hits`` keeps all candidates."""
    one = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("value", "page_no", "source_text")).alias("_hit"))
    single = F.col("hits") == 1
    return one.select(*keys, "hits", *[F.when(single, F.col(f"_hit.{c}")).alias(c) for c in ("value", "page_no", "source_text")],
                      (~single).alias("needs_review"))


def first_wins(values: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WIN-13: the first layout and page that produced a code keep it."""
    return newest(values, keys, [F.asc(c) for c in order])


def dedupe_fields(values: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-2: a code given twice in one document has no value and needs review."""
    n = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"), F.first("value", ignorenulls=True).alias("_v"),
                                  F.max(F.struct("page_no", "source_text", "confidence")).alias("_meta"))
    twice = F.col("_times") > 1
    return n.select(*keys, F.when(~twice, F.col("_v")).alias("value"),
                    *[F.when(~twice, F.col(f"_meta.{c}")).alias(c) for c in ("page_no", "source_text", "confidence")],
                    twice.alias("is_duplicate"))


def complete_fields(values: DataFrame, documents: DataFrame, codes: list[str], key: str) -> DataFrame:
    """AGG-3: one row per document and catalog code; missing ones read "not obtained".

    The catalog is a fixed small list, exploded on each document row.
    """
    expected = documents.select(key, F.explode(F.array(*[F.lit(c) for c in codes])).alias("field_code"))
    joined = expected.join(values.withColumn("_got", F.lit(True)), [key, "field_code"], "left")
    return joined.withColumn("obtained", F.coalesce("_got", F.lit(False))).drop("_got")


def zoning_status(values: DataFrame, pages: DataFrame, required: tuple[str, ...] = ("zoning_type", "building_coverage_ratio", "floor_area_ratio")) -> DataFrame:
    """AGG-18: parsed when the required codes are there, needs_ai when no page has text, else review."""
    got = values.groupBy("file_hash").agg(F.count_distinct(F.when(F.col("field_code").isin(*required), F.col("field_code"))).alias("_got"))
    blank = pages.groupBy("file_hash").agg(F.bool_and(F.trim(F.coalesce("text", F.lit(""))) == "").alias("_blank"))
    status = F.when(F.coalesce("_got", F.lit(0)) == len(required), "parsed").when(F.col("_blank"), "needs_ai").otherwise("needs_review")
    return blank.join(got, "file_hash", "left").select("file_hash", status.alias("status"))


def review_counts(values: DataFrame, diffs: DataFrame, key: str = "case_id") -> DataFrame:
    """AGG-7: fields to review and open diffs per case."""
    v = values.groupBy(key).agg(F.count_if("needs_review").alias("review_count"))
    d = diffs.groupBy(key).agg(F.count_if(F.col("review_status") == "unreviewed").alias("diff_count"))
    return v.join(d, key, "full_outer").na.fill(0)


def quality_summary(fields: DataFrame, corrections: DataFrame, documents: DataFrame, liens: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """AGG-8: per group counts of good, pending and missing fields, corrections, documents and liens."""
    f = fields.groupBy(key).agg(
        F.count_if(F.col("value").isNotNull() & ~F.coalesce("needs_review", F.lit(False))).alias("good"),
        F.count_if(F.coalesce("needs_review", F.lit(False))).alias("pending"),
        F.count_if(F.col("value").isNull()).alias("unavailable"))
    c = corrections.groupBy(key).agg(*[F.count_if(F.col("category") == x).alias(f"corrected_{x}") for x in categories])
    d = documents.groupBy(key).agg(F.count_if("all_text").alias("text_documents"), F.count_if(~F.col("all_text")).alias("scan_documents"))
    m = liens.groupBy(key).agg(F.count_if("active").alias("active_liens"), F.count_if(~F.col("active")).alias("inactive_liens"),
                               F.count_if(F.col("active").isNull()).alias("unknown_liens"))
    return d.join(f, key, "left").join(c, key, "left").join(m, key, "left").na.fill(0)


def values_per_document(values: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """AGG-10: evidence of each field per source document; unsourced fields go to the first document.

    ``values``: group, field_code, value_json, sources; ``files``: group, file_hash, ord.
    """
    sourced = values.select(group, "field_code", "value_json", "needs_review", "confidence", F.posexplode("sources").alias("_at", "_s"))
    per = sourced.groupBy(group, "field_code", F.col("_s.file_hash").alias("file_hash")).agg(
        F.first("value_json").alias("value_json"), F.first("needs_review").alias("needs_review"), F.first("confidence").alias("confidence"),
        F.min_by(F.col("_s.page"), "_at").alias("page_no"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col("_s.text").alias("t")))), lambda x: x["t"])), "\n").alias("source_text"))
    first = files.groupBy(group).agg(F.min_by("file_hash", "ord").alias("file_hash"))
    bare = (values.filter(F.coalesce(F.size("sources"), F.lit(0)) <= 0).join(first, group)
            .select(group, "field_code", "file_hash", "value_json", "needs_review", "confidence",
                    F.lit(None).cast("int").alias("page_no"), F.lit("").alias("source_text")))
    return per.unionByName(bare)


def group_hash(files: DataFrame, keys: list[str], hash_col: str = "file_hash") -> DataFrame:
    """AGG-15: order-free hash of a file group. A group is one upload, so its set is short."""
    return files.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(hash_col)), "|"), 256).alias("group_hash"))


def estimate_cost(pages: DataFrame, keys: list[str], price: dict) -> DataFrame:
    """AGG-13: reading cost per file; an unknown rate that is needed makes it null.

    ``price``: usd_to_jpy, input_per_1m, output_per_1m, image_page_usd, prompt_tokens, output_tokens.
    """
    dec = lambda v: F.lit(None if v is None else str(v)).cast("decimal(18,6)")
    sized = pages.groupBy(*keys).agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).cast("decimal(20,0)").alias("bytes"),
                                     F.count_if(F.col("mode") != "text").cast("decimal(20,0)").alias("images"))
    usd = ((F.col("bytes") + price["prompt_tokens"]) * dec(price["input_per_1m"]) + dec(price["output_per_1m"]) * price["output_tokens"]) / F.lit(1000000)
    image = F.when(F.col("images") > 0, F.col("images") * dec(price["image_page_usd"])).otherwise(F.lit(0))
    total = F.ceil((usd + image) * dec(price["usd_to_jpy"])).cast("long")
    return sized.select(*keys, F.col("bytes").cast("long").alias("bytes"), F.col("images").cast("long").alias("images"), total.alias("estimate"))


def cost_totals(plan: DataFrame, keys: list[str], cap: float | None = None) -> DataFrame:
    """AGG-14: totals in which one unknown part makes the total unknown, with the cap check."""
    unknown = F.bool_or((F.col("mode") == "ai") & F.col("estimate").isNull())
    total = F.when(~unknown, F.coalesce(F.sum(F.when(F.col("mode") == "ai", F.col("estimate"))), F.lit(0)))
    out = plan.groupBy(*keys).agg(*[F.count_if(F.col("mode") == m).alias(m) for m in ("cache", "local", "ai")], total.alias("estimate"))
    blocked = F.lit(False) if cap is None else (F.col("ai") > 0) & (F.col("estimate").isNull() | (F.col("estimate") > cap))
    return out.withColumn("blocked", blocked)


def running_cost(usage: DataFrame, keys: list[str], bucket: Column, order: list[str]) -> DataFrame:
    """AGG-14: session totals; once a cost is unknown, later totals of that session are too."""
    found = scan(usage, keys, bucket, order, {"_cost": Running(F.coalesce("cost", F.lit(0))), "_gaps": Running(F.when(F.col("cost").isNull(), 1).otherwise(0))})
    return found.withColumn("total_cost", F.when(F.col("_gaps") == 0, F.col("_cost"))).drop("_cost", "_gaps")


def actual_cost(usage: DataFrame, price: dict) -> Column:
    dec = lambda v: F.lit(None if v is None else str(v)).cast("decimal(18,6)")
    return F.ceil((F.col("input_tokens") * dec(price["input_per_1m"]) + F.col("output_tokens") * dec(price["output_per_1m"])) / 1000000 * dec(price["usd_to_jpy"])).cast("long")


def job_state(events: DataFrame, job: str = "job_id") -> DataFrame:
    """STR-5: latest status and run counter of each job."""
    at = F.struct("ts", "event_id")
    return events.groupBy(job).agg(F.max_by("status", at).alias("status"), F.max("ts").alias("updated_at"),
                                   F.count_if(F.col("status") == "running").alias("runs"))


def stalled_jobs(events: DataFrame, now: Column, job: str = "job_id", minutes: int = 25, live: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """STR-4: a live job that has been silent too long counts as failed."""
    silent = F.col("status").isin(*live) & (F.col("updated_at") + F.expr(f"interval {minutes} minutes") < now)
    return job_state(events, job).withColumn("stalled", silent).withColumn("status", F.when(F.col("stalled"), "failed").otherwise(F.col("status")))


def match_grants(events: DataFrame, keys: list[str], bucket: Column, order: list[str], minutes: int = 30) -> DataFrame:
    """STR-6: a use is granted by the plan just before it, once, within the plan's lifetime.

    ``events`` hold both: is_plan, ts. Only the plan directly before a use can grant it, since a later
    plan replaces an earlier one and a use consumes it, so one ordered scan replaces the range join.
    """
    from .ordered import Last
    seen = scan(events, keys, bucket, order, {"_before": Last(F.struct("is_plan", "ts", "event_id"), inclusive=False)})
    granted = F.coalesce(F.col("_before.is_plan") & (F.col("ts") <= F.col("_before.ts") + F.expr(f"interval {minutes} minutes")), F.lit(False))
    return (seen.filter(~F.col("is_plan")).withColumn("granted", granted)
            .withColumn("plan_id", F.when(granted, F.col("_before.event_id"))).drop("_before"))


def group_zones(zones: DataFrame, building: str = "building_id") -> DataFrame:
    """AGG-12: zones with the same folded value of a code share one entry and a combined marker.

    ``zones``: building, position (0-based), field_code, value, needs_review.
    """
    usable = zones.filter(is_applicable(F.col("value")) & ~F.coalesce("needs_review", F.lit(False)))
    letter = F.char(F.lit(65) + F.col("position").cast("int"))
    return (usable.withColumn("_key", zone_key(F.col("value"))).groupBy(building, "field_code", "_key").agg(
        F.min_by("value", "position").alias("value"), F.min("position").alias("first_position"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("position", letter.alias("l")))), lambda p: F.concat(F.lit("("), p["l"], F.lit(")"))), "").alias("marker"))
        .drop("_key"))


def letter_zones(new: DataFrame, existing: DataFrame, letters: str = "ABCD") -> tuple[DataFrame, DataFrame]:
    """WIN-14: new zones take the unused letters in order; files already there are skipped.

    ``new``: building_id, file_hash, ord; ``existing``: building_id, file_hash, zone_label. Returns
    (lettered, rejected): a building that would get more zones than letters rejects its new ones.
    """
    fresh = new.join(existing.select("building_id", "file_hash").dropDuplicates(), ["building_id", "file_hash"], "left_anti").dropDuplicates(["building_id", "file_hash"])
    used = existing.groupBy("building_id").agg(F.collect_set("zone_label").alias("_used"), F.count(F.lit(1)).alias("_have"))
    want = fresh.groupBy("building_id").agg(F.count(F.lit(1)).alias("_want"))
    joined = fresh.join(want, "building_id").join(used, "building_id", "left")
    fits = F.col("_want") + F.coalesce("_have", F.lit(0)) <= len(letters)
    rejected = joined.filter(~fits).select(*new.columns)
    ranked = joined.filter(fits).withColumn("_n", F.row_number().over(Window.partitionBy("building_id").orderBy("ord", "file_hash")))
    free = F.array_except(F.array(*[F.lit(c) for c in letters]), F.coalesce("_used", F.array().cast("array<string>")))
    return ranked.select(*new.columns, F.try_element_at(free, F.col("_n")).alias("zone_label")), rejected


def reorder_zones(zones: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """WIN-15: a valid permutation gives a new order and letters; anything else is rejected.

    ``zones``: building_id, position, ...; ``orders``: building_id, order ARRAY<INT>.
    """
    n = zones.groupBy("building_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    checked = orders.join(n, "building_id", "left")
    valid = F.col("_n").isNotNull() & (F.size("order") == F.col("_n")) & (F.array_sort("order") == F.sequence(F.lit(0), F.col("_n") - 1))
    valid = F.coalesce(valid, F.lit(False))
    moved = checked.filter(valid).select("building_id", F.posexplode("order").alias("_to", "position"))
    done = (zones.join(moved, ["building_id", "position"]).withColumn("position", F.col("_to"))
            .withColumn("zone_label", F.char(F.lit(65) + F.col("_to"))).drop("_to"))
    return done, checked.filter(~valid).drop("_n")


def allocate_slots(items: DataFrame, keys: list[str], bucket: Column, order: list[str], capacity: Column) -> DataFrame:
    """WIN-16: the first items fill the form's slots; the others stay as overflow rows."""
    placed = scan(items, keys, bucket, order, {"slot": Running(F.lit(1))})
    return placed.withColumn("overflow", F.col("slot") > capacity)


def zoning_version(zones: DataFrame, previous: DataFrame) -> DataFrame:
    """AGG-23: date and confidence of a merged zone version (at most a few zones per building)."""
    g = zones.groupBy("building_id").agg(
        F.max("reference_date").alias("_date"), F.bool_or(F.coalesce("needs_review", F.lit(True))).alias("_open"), F.count(F.lit(1)).alias("zones"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "source_filename"))), lambda z: z["source_filename"]), "／").alias("filenames"))
    return (g.join(previous.select("building_id", F.col("as_of_date").alias("_prev")), "building_id", "left")
            .select("building_id", "zones", "filenames", F.coalesce("_date", "_prev").alias("as_of_date"),
                    F.when(~F.col("_open"), 1.0).alias("confidence"), (~F.col("_open")).alias("approved")))


def mapping_inventory(maps: DataFrame, names: DataFrame) -> DataFrame:
    """AGG-21: which codes have all their output names defined in the template.

    ``maps``: field_code, label, source, names ARRAY<STRING>; ``names``: name, sheet, cell.
    """
    each = maps.select("field_code", "source", F.explode_outer("names").alias("name"))
    joined = each.join(names.withColumn("_has", F.lit(True)), "name", "left")
    agg = joined.groupBy("field_code", "source").agg(
        F.bool_and(F.coalesce("_has", F.lit(False))).alias("supported"),
        F.array_join(F.array_sort(F.collect_set("sheet")), " / ").alias("sheet"),
        F.array_join(F.array_sort(F.collect_set("cell")), " / ").alias("cell"))
    return maps.select("field_code", "label", "source", F.array_join("names", " / ").alias("named_range")).join(agg, ["field_code", "source"])


def next_work(cases: DataFrame, diffs: DataFrame, conflicts: DataFrame, choices: DataFrame) -> DataFrame:
    """AGG-24: next step per case: add documents, review, or ready.

    ``cases``: case_id, documents, blocked; ``diffs``: case_id, choice_key, review_status;
    ``conflicts``: case_id, chosen; ``choices``: choice_key of diffs whose old side was kept.
    """
    open_d = (diffs.filter(~F.col("review_status").isin("applied", "ignored")).join(choices.select("choice_key").dropDuplicates(), "choice_key", "left_anti")
              .groupBy("case_id").agg(F.count(F.lit(1)).alias("_d")))
    open_c = conflicts.filter("not chosen").groupBy("case_id").agg(F.count(F.lit(1)).alias("_c"))
    joined = cases.join(open_d, "case_id", "left").join(open_c, "case_id", "left")
    n = F.coalesce("_d", F.lit(0)) + F.coalesce("_c", F.lit(0))
    step = F.when(F.col("documents") == 0, "add").when(F.coalesce("blocked", F.lit(False)) | (n > 0), "review").otherwise("ready")
    return joined.withColumn("open_items", n).withColumn("next_step", step).drop("_d", "_c")


def missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """SET-3."""
    return expected.join(found.select(*keys).dropDuplicates(), keys, "left_anti")


def not_subset(requested: DataFrame, allowed: DataFrame, keys: list[str], group: str) -> DataFrame:
    """SET-2: groups that ask for something outside the allowed set, with how much."""
    return missing(requested, allowed, keys).groupBy(group).agg(F.count(F.lit(1)).alias("outside"))


def dedupe_files(files: DataFrame, keys: list[str], policy: str, order: str) -> tuple[DataFrame, DataFrame]:
    """SET-6: drop later copies silently ("drop") or return them as a report ("report")."""
    first = files.groupBy(*keys).agg(F.min(order).alias(f"_first"), F.count(F.lit(1)).alias("copies"))
    tagged = files.join(first, keys)
    kept = tagged.filter(F.col(order) == F.col("_first")).drop("_first", "copies")
    report = first.filter("copies > 1").drop("_first")
    return (kept, report) if policy == "report" else (kept, report.limit(0))


def allowed(df: DataFrame, col: str, values: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """FLT-2: rows whose value is on the list, and the others."""
    ok = F.coalesce(F.col(col).isin(*values), F.lit(False))
    return df.filter(ok), df.filter(~ok)
