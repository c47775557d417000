"""Jobs, costs, zones, slots, cards and output cells."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.evidence import spreadsheet_safe
from ..operators import aggregates, versions, views
from ..operators.ordered import row_numbers
from ..plans import contract
from .adapter import VALUES_SQL, order_values, table

PRICE = {"usd_to_jpy": 150, "input_per_1m": 2, "output_per_1m": 8, "image_page_usd": None, "prompt_tokens": 16000, "output_tokens": 16000}


def job_state(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "job_id", "event_type": "status"})
    found = aggregates.job_state(events.withColumn("status", F.when(F.col("status") == "view", "running").otherwise(F.col("status"))))
    return found.select("job_id", "status", "runs")


def stalled_jobs(spark, sf_dir):
    """Users whose last event is a click or view and silent for more than 25 minutes at the newest event."""
    events = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "job_id", "event_type": "status"})
    now = events.agg(F.max("ts")).scalar()
    return aggregates.stalled_jobs(events, now, live=("click", "view")).select("job_id", "status", "stalled")


def grant_interval_join(spark, sf_dir):
    """Purchases granted by the view directly before them within 30 minutes."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "purchase")).withColumn("is_plan", F.col("event_type") == "view")
    found = aggregates.match_grants(events, ["user_id"], F.to_date("ts"), ["ts", "event_id"])
    return found.select("event_id", "user_id", "granted", F.col("plan_id").cast("string").alias("plan_id"))


def cost_totals(spark, sf_dir):
    """Reading cost of every conversation and document source; scanned parts make it unknown."""
    docs = table(spark, sf_dir, "documents").select("source", F.when(F.col("lang") == "es", "scan").otherwise("text").alias("mode"), "text")
    conv = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), "conv_id").alias("source"), F.lit("text").alias("mode"), "text")
    return aggregates.estimate_cost(docs.unionByName(conv), ["source"], PRICE).select(
        "source", "bytes", "images", F.col("estimate").cast("string").alias("estimate"))


def cost_plans(spark, sf_dir):
    """Per customer: modes of its orders and a total that one unknown part makes unknown."""
    orders = table(spark, sf_dir, "orders")
    plan = orders.select("o_custkey", F.when(F.col("o_orderstatus") == "F", "ai").when(F.col("o_orderstatus") == "O", "local").otherwise("cache").alias("mode"),
                         F.when(F.col("o_orderpriority") != "5-LOW", F.floor(F.col("o_totalprice") / 1000)).alias("estimate"))
    found = aggregates.cost_totals(plan, ["o_custkey"], cap=500)
    return found.withColumn("estimate", F.col("estimate").cast("string"))


def running_cost(spark, sf_dir):
    """Session totals of customers in order of their orders."""
    usage = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"),
                                                  F.when(F.col("o_orderkey") % 23 != 0, F.floor(F.col("o_totalprice") / 1000)).alias("cost"))
    found = aggregates.running_cost(usage, ["o_custkey"], F.year("day"), ["day", "o_orderkey"])
    return found.select("o_custkey", "o_orderkey", F.col("total_cost").cast("string").alias("total_cost"))


def _zones(spark, sf_dir):
    """A brand is a building and its part types are zones in alphabetical order, with two coded values."""
    part = table(spark, sf_dir, "part")
    zones = part.groupBy("p_brand", "p_type").agg(F.min(F.floor(F.col("p_size") / 3)).alias("ratio"), F.max(F.floor(F.col("p_size") / 10)).alias("height"))
    return row_numbers(zones, ["p_brand"], F.ascii("p_type"), ["p_type"], "_place").withColumn("position", F.col("_place") - 1)


def zone_groups(spark, sf_dir):
    zones = _zones(spark, sf_dir).select(F.col("p_brand").alias("building_id"), "position", F.lit(None).cast("boolean").alias("needs_review"),
                                         F.concat(F.col("ratio").cast("string"), F.lit("0%")).alias("building_coverage_ratio"), F.col("height").cast("string").alias("height_district"))
    long = zones.unpivot(["building_id", "position", "needs_review"], ["building_coverage_ratio", "height_district"], "field_code", "value")
    return aggregates.group_zones(long).select("building_id", "field_code", "value", "marker")


def slot_overflow(spark, sf_dir):
    """Distinct sizes of a brand take the form's six slots in order; the rest overflow."""
    sizes = table(spark, sf_dir, "part").select("p_brand", "p_size").distinct()
    return aggregates.allocate_slots(sizes, ["p_brand"], F.floor(F.col("p_size") / 10), ["p_size"], F.lit(6))


def mapping_inventory(spark, sf_dir):
    """Nations as codes whose output names are region cells; two are defined nowhere."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    maps = nation.select(F.col("n_name").alias("field_code"), F.concat(F.lit("="), "n_name").alias("label"), F.lit("nation").alias("source"),
                         F.array(F.col("n_regionkey").cast("string"), (F.col("n_nationkey") % 7).cast("string")).alias("names"))
    names = region.select(F.col("r_regionkey").cast("string").alias("name"), F.col("r_name").alias("sheet"), F.concat(F.lit("A"), "r_regionkey").alias("cell"))
    found = aggregates.mapping_inventory(maps, names)
    return found.select("field_code", spreadsheet_safe(F.col("label")).alias("label"), "named_range", "supported", "sheet", "cell")


def contract_cells(spark, sf_dir):
    """Customers with their newest order as a flat cell table."""
    cust, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    top = versions.latest_by_source(order_values(spark, sf_dir), ["document_id", "field_code"], [F.desc("as_of_date"), F.desc("version_id")])
    fee = top.filter("field_code = 'management_fee'").select(F.col("document_id").alias("c_custkey"), F.col("value_json").alias("fee"), "as_of_date")
    wide = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(fee, "c_custkey", "left").select(
        F.col("c_custkey").alias("case_id"), F.col("c_name").alias("building_name"), F.col("n_name").alias("address"), "fee", "as_of_date")
    return contract.cells_from_columns(wide, "case_id", "基本入力", {"AB13": ("building_name", "要確認"), "X15": ("address", "要確認"), "AA70": ("fee", "")},
                                       {("U34", "X34", "AB34", "AF34"): "as_of_date"})


def source_conflicts(spark, sf_dir):
    vals = order_values(spark, sf_dir).withColumnsRenamed({"document_id": "case_id", "as_of_date": "doc_date", "version_id": "version_no"})
    return views.source_conflicts(vals, pairs=[("pet_restrictions", "pet_restrictions"), ("current_owner_name", "current_owner_name")], fold=lambda c: c)


def review_counts(spark, sf_dir):
    vals = versions.gated(order_values(spark, sf_dir)).select(F.col("document_id").alias("case_id"), (~F.col("is_trusted")).alias("needs_review"))
    diffs = versions.diff_rules(order_values(spark, sf_dir)).select(F.col("document_id").alias("case_id"), F.lit("unreviewed").alias("review_status"))
    return aggregates.review_counts(vals, diffs)


def group_hash(spark, sf_dir):
    """Order-free hash of the part set of every order."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.sha2(F.col("l_partkey").cast("string"), 256).alias("file_hash"))
    return aggregates.group_hash(line, ["l_orderkey"])


def duplicate_files(spark, sf_dir):
    """Kept first copies of each document text per language and the copies reported."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    kept, report = aggregates.dedupe_files(docs, ["file_hash"], "report", "doc_id")
    return kept.join(report, "file_hash", "left").select("doc_id", "file_hash", F.coalesce("copies", F.lit(1)).alias("copies"))


def next_work(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    docs = orders.groupBy(F.col("o_custkey").alias("case_id")).agg(F.count(F.lit(1)).alias("documents"))
    cases = cust.select(F.col("c_custkey").alias("case_id"), (F.col("c_acctbal") < -900).alias("blocked")).join(docs, "case_id", "left").na.fill(0, ["documents"])
    diffs = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("choice_key"),
                                                                F.when(F.col("o_orderstatus") == "F", "applied").otherwise("unreviewed").alias("review_status"))
    conflicts = orders.filter("o_totalprice > 480000").select(F.col("o_custkey").alias("case_id"), (F.col("o_orderstatus") == "F").alias("chosen"))
    choices = orders.filter("o_totalprice > 100000").select(F.col("o_orderkey").cast("string").alias("choice_key"))
    return aggregates.next_work(cases, diffs, conflicts, choices).select("case_id", "open_items", "next_step")


def readiness(spark, sf_dir):
    cust, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    cases = cust.select(F.col("c_custkey").alias("case_id"), (F.col("c_nationkey") != 3).alias("registered"), (F.col("c_nationkey") % 2).alias("group_review"),
                        F.when(F.col("c_mktsegment") == "BUILDING", "detached_house").otherwise("condominium_land_right").alias("property_type"))
    opened = orders.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'").select(F.col("o_custkey").alias("case_id"))
    unsaved = orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("case_id"))
    return views.readiness(cases, opened, unsaved).select("case_id", "ready", F.array_join("reasons", ";").alias("reasons"))


def attention_fields(spark, sf_dir):
    vals = versions.gated(order_values(spark, sf_dir))
    test = views.needs_attention(F.col("value_json"), ~F.col("is_trusted"), F.lit(False), F.col("field_code"), F.lit(False))
    return vals.filter(test).select("document_id", "version_id", "field_code")


QUERIES = {
    "job_state": (job_state, """SELECT user_id AS job_id, max_by(CASE event_type WHEN 'view' THEN 'running' ELSE event_type END, (ts, event_id)) AS status, count(*) FILTER (WHERE event_type = 'view') AS runs FROM events GROUP BY 1"""),
    "stalled_jobs": (stalled_jobs, """WITH s AS (SELECT user_id AS job_id, max_by(event_type, (ts, event_id)) AS st, max(ts) AS t FROM events GROUP BY 1), n AS (SELECT max(ts) AS now_ FROM events)
SELECT job_id, CASE WHEN st IN ('click', 'view') AND t + INTERVAL 25 MINUTE < now_ THEN 'failed' ELSE st END AS status, st IN ('click', 'view') AND t + INTERVAL 25 MINUTE < now_ AS stalled FROM s, n"""),
    "grant_interval_join": (grant_interval_join, """WITH e AS (SELECT *, lag(event_type) OVER w AS pt, lag(ts) OVER w AS pts, lag(event_id) OVER w AS pid FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, coalesce(pt = 'view' AND ts <= pts + INTERVAL 30 MINUTE, false) AS granted FROM e WHERE event_type = 'purchase')
SELECT event_id, user_id, granted, CASE WHEN granted THEN CAST(pid AS VARCHAR) END AS plan_id FROM g"""),
    "cost_totals": (cost_totals, """WITH p AS (SELECT source, CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS img, strlen(text) AS b FROM documents UNION ALL SELECT 'conv-' || conv_id, 0, strlen(text) FROM conversations),
s AS (SELECT source, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(img) AS BIGINT) AS images FROM p GROUP BY 1)
SELECT source, bytes, images, CASE WHEN images = 0 THEN CAST((((bytes + 16000) * 2 + 128000) * 150 + 999999) // 1000000 AS VARCHAR) END AS estimate FROM s"""),
    "cost_plans": (cost_plans, """WITH p AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'ai' WHEN 'O' THEN 'local' ELSE 'cache' END AS mode, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS e FROM orders),
g AS (SELECT o_custkey, count(*) FILTER (WHERE mode = 'cache') AS cache, count(*) FILTER (WHERE mode = 'local') AS local, count(*) FILTER (WHERE mode = 'ai') AS ai,
  bool_or(mode = 'ai' AND e IS NULL) AS unk, CAST(coalesce(sum(e) FILTER (WHERE mode = 'ai'), 0) AS BIGINT) AS total FROM p GROUP BY 1)
SELECT o_custkey, cache, local, ai, CASE WHEN NOT unk THEN CAST(total AS VARCHAR) END AS estimate, ai > 0 AND (unk OR total > 500) AS blocked FROM g"""),
    "running_cost": (running_cost, """WITH u AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 23 <> 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS cost FROM orders)
SELECT o_custkey, o_orderkey, CASE WHEN sum(CASE WHEN cost IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN CAST(CAST(sum(coalesce(cost, 0)) OVER w AS BIGINT) AS VARCHAR) END AS total_cost
FROM u WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)"""),
    "zone_groups": (zone_groups, """WITH z AS (SELECT p_brand AS building_id, p_type, CAST(min(p_size // 3) AS VARCHAR) || '0%' AS r, CAST(max(p_size // 10) AS VARCHAR) AS h, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS pos FROM part GROUP BY 1, 2),
l AS (SELECT building_id, pos, 'building_coverage_ratio' AS field_code, r AS value FROM z UNION ALL SELECT building_id, pos, 'height_district', h FROM z)
SELECT building_id, field_code, value, string_agg('(' || chr(65 + CAST(pos AS INT)) || ')', '' ORDER BY pos) AS marker FROM l GROUP BY 1, 2, 3"""),
    "slot_overflow": (slot_overflow, """WITH s AS (SELECT DISTINCT p_brand, p_size FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS slot FROM s) SELECT *, slot > 6 AS overflow FROM r"""),
    "mapping_inventory": (mapping_inventory, """WITH m AS (SELECT n_name, '''=' || n_name AS label, CAST(n_regionkey AS VARCHAR) AS a, CAST(n_nationkey % 7 AS VARCHAR) AS b FROM nation),
e AS (SELECT n_name, a AS nm FROM m UNION ALL SELECT n_name, b FROM m),
j AS (SELECT n_name, bool_and(r_regionkey IS NOT NULL) AS supported, coalesce(string_agg(DISTINCT r_name, ' / ' ORDER BY r_name), '') AS sheet, coalesce(string_agg(DISTINCT 'A' || r_regionkey, ' / ' ORDER BY 'A' || r_regionkey), '') AS cell
  FROM e LEFT JOIN region ON CAST(r_regionkey AS VARCHAR) = nm GROUP BY 1)
SELECT m.n_name AS field_code, label, a || ' / ' || b AS named_range, supported, sheet, cell FROM m JOIN j ON m.n_name = j.n_name"""),
    "contract_cells": (contract_cells, f"""WITH {VALUES_SQL}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY as_of_date DESC, version_id DESC) AS rn FROM v WHERE field_code = 'management_fee' AND document_type = 'important_report') WHERE rn = 1),
w AS (SELECT c_custkey AS case_id, c_name, n_name, t.value_json AS fee, t.as_of_date AS d FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN t ON t.document_id = c_custkey),
c AS (SELECT case_id, 'AB13' AS cell, c_name AS value FROM w UNION ALL SELECT case_id, 'X15', n_name FROM w UNION ALL SELECT case_id, 'AA70', coalesce(fee, '') FROM w
  UNION ALL SELECT case_id, 'U34', CASE WHEN d IS NULL THEN '' ELSE '平成' END FROM w UNION ALL SELECT case_id, 'X34', coalesce(CAST(year(d) - 1988 AS VARCHAR), '') FROM w
  UNION ALL SELECT case_id, 'AB34', coalesce(CAST(month(d) AS VARCHAR), '') FROM w UNION ALL SELECT case_id, 'AF34', coalesce(CAST(day(d) AS VARCHAR), '') FROM w)
SELECT case_id, '基本入力' AS sheet, cell, value FROM c"""),
    "source_conflicts": (source_conflicts, f"""WITH {VALUES_SQL}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, document_type, field_code ORDER BY as_of_date DESC, version_id DESC) AS rn FROM v WHERE document_type IN ('management_rules', 'important_report')) WHERE rn = 1)
SELECT a.document_id AS case_id, a.field_code, a.value_json AS rules_value, b.value_json AS report_value FROM l a JOIN l b ON a.document_id = b.document_id AND a.field_code = b.field_code
WHERE a.document_type = 'management_rules' AND b.document_type = 'important_report' AND a.field_code IN ('pet_restrictions', 'current_owner_name') AND a.value_json <> 'null' AND b.value_json <> 'null' AND a.value_json <> b.value_json"""),
    "review_counts": (review_counts, f"""WITH {VALUES_SQL}, seen AS (
  SELECT *, last_value(CASE WHEN approved THEN version_id END IGNORE NULLS) OVER (PARTITION BY document_id, field_code ORDER BY as_of_date, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS appr,
    lag(version_id) OVER (PARTITION BY document_id, field_code ORDER BY as_of_date, version_id) AS before FROM v),
d AS (SELECT n.document_id, count(*) AS c FROM seen n JOIN v o ON o.version_id = coalesce(n.appr, n.before) AND o.field_code = n.field_code WHERE o.value_json IS DISTINCT FROM n.value_json GROUP BY 1),
r AS (SELECT document_id, count(*) FILTER (WHERE NOT is_trusted) AS c FROM v GROUP BY 1)
SELECT r.document_id AS case_id, r.c AS review_count, coalesce(d.c, 0) AS diff_count FROM r LEFT JOIN d ON r.document_id = d.document_id"""),
    "group_hash": (group_hash, """SELECT l_orderkey, sha256(string_agg(DISTINCT sha256(CAST(l_partkey AS VARCHAR)), '|' ORDER BY sha256(CAST(l_partkey AS VARCHAR)))) AS group_hash FROM lineitem GROUP BY 1"""),
    "duplicate_files": (duplicate_files, """SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash, count(*) AS copies FROM documents GROUP BY 2"""),
    "next_work": (next_work, """WITH d AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AND o_totalprice <= 100000) + count(*) FILTER (WHERE o_totalprice > 480000 AND o_orderstatus <> 'F') AS k FROM orders GROUP BY 1)
SELECT c_custkey AS case_id, coalesce(k, 0) AS open_items, CASE WHEN n IS NULL THEN 'add' WHEN c_acctbal < -900 OR k > 0 THEN 'review' ELSE 'ready' END AS next_step FROM customer LEFT JOIN d ON o_custkey = c_custkey"""),
    "readiness": (readiness, """WITH o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS d, count(*) FILTER (WHERE o_totalprice > 450000) AS p FROM orders GROUP BY 1),
r AS (SELECT c_custkey AS case_id, concat_ws(';', CASE WHEN d > 0 THEN 'open diffs: ' || d END, CASE WHEN p > 0 THEN 'unsaved documents' END, CASE WHEN c_nationkey = 3 THEN 'not registered' END,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'property type not supported' END, CASE WHEN c_nationkey % 2 > 0 THEN 'group review open' END) AS reasons FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT case_id, reasons = '' AS ready, reasons FROM r"""),
    "attention_fields": (attention_fields, f"""WITH {VALUES_SQL} SELECT document_id, version_id, field_code FROM v WHERE NOT is_trusted AND (value_json <> 'null' OR field_code IN ('current_owner_name', 'management_fee'))"""),
}
