"""Version store, changes and adoption."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.evidence import content_key
from ..operators import adopt, versions
from ..session import cut_lineage
from .adapter import VALUES_SQL, order_values, table


def _queue_sides(spark, sf_dir):
    diffs = versions.diff_rules(versions.gated(order_values(spark, sf_dir)))
    return diffs.select(
        "document_id", "field_code", F.col("old.value_json").alias("old_value"),
        F.col("old.version_id").alias("old_version"), F.col("old.as_of_date").alias("old_date"),
        F.col("version_id").alias("new_version"), F.col("value_json").alias("new_value"),
        F.col("as_of_date").alias("new_date"), F.col("is_trusted").alias("new_trusted"))


GROUP_KEYS = ["document_id", "field_code", "old_value", "old_version"]


def review_queue(spark, sf_dir):
    """Which attributes have a newer, trusted, different reading, and which one to adopt."""
    groups = versions.recommend(_queue_sides(spark, sf_dir), GROUP_KEYS, "new_version")
    return groups.withColumn("recommended", F.col("recommended").cast("string"))


QUEUE_SQL = f"""WITH {VALUES_SQL},
seen AS (
  SELECT *, last_value(CASE WHEN approved THEN version_id END IGNORE NULLS) OVER w AS appr,
    lag(version_id) OVER (PARTITION BY document_id, field_code ORDER BY as_of_date, version_id) AS before
  FROM v WINDOW w AS (PARTITION BY document_id, field_code ORDER BY as_of_date, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sides AS (
  SELECT n.document_id, n.field_code, o.value_json AS old_value, o.version_id AS old_version, o.as_of_date AS old_date,
    n.version_id AS new_version, n.value_json AS new_value, n.as_of_date AS new_date, n.is_trusted AS new_trusted
  FROM seen n JOIN v o ON o.version_id = coalesce(n.appr, n.before) AND o.field_code = n.field_code
  WHERE o.value_json IS DISTINCT FROM n.value_json),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, field_code, old_value, old_version ORDER BY new_trusted DESC, new_date DESC, new_version) AS rn
  FROM sides),
groups AS (
  SELECT document_id, field_code, old_value, old_version, count(*) AS candidates,
    count(*) FILTER (WHERE new_trusted) AS trusted_candidates,
    max(CASE WHEN rn = 1 AND new_trusted AND new_date > old_date THEN CAST(new_version AS VARCHAR) END) AS recommended
  FROM ranked GROUP BY 1, 2, 3, 4)
"""


def initial_baseline(spark, sf_dir):
    """Trusted starting value per field, as the pointer map each case would get."""
    base = versions.initial_baseline(order_values(spark, sf_dir), ["document_id", "field_code"],
                                     [F.desc("as_of_date"), F.desc("version_id")])
    return base.select("document_id", "field_code", "version_id", "value_json", "approved")


def latest_by_source(spark, sf_dir):
    found = versions.latest_by_source(order_values(spark, sf_dir), ["document_id", "field_code"],
                                      [F.desc("as_of_date"), F.desc("version_id")])
    return found.select("document_id", "field_code", "document_type", "version_id", "value_json")


def approved_only_diffs(spark, sf_dir):
    found = versions.diff_report(order_values(spark, sf_dir))
    return found.select("document_id", "field_code", "version_id", F.col("old.version_id").alias("old_version"),
                        F.col("old.value_json").alias("old_value"), F.col("value_json").alias("new_value"), "adoptable")


def _master(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("document_id"),
        F.when(F.col("c_nationkey") % 5 == 0, None).when(F.col("c_nationkey") % 3 == 0, "F")
        .when(F.col("c_nationkey") % 3 == 1, "O").otherwise("P").alias("current_owner_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").when(F.col("c_mktsegment") == "MACHINERY", "2-HIGH")
        .otherwise("3-MEDIUM").alias("pet_restrictions"))


MASTER_SQL = """
m AS (
  SELECT c_custkey AS document_id, 'current_owner_name' AS field_code,
    CASE WHEN c_nationkey % 5 = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN 'F' WHEN c_nationkey % 3 = 1 THEN 'O' ELSE 'P' END AS master_json
  FROM customer
  UNION ALL
  SELECT c_custkey, 'pet_restrictions',
    CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' WHEN 'MACHINERY' THEN '2-HIGH' ELSE '3-MEDIUM' END FROM customer),
d AS (
  SELECT v.document_id, v.field_code, v.version_id, v.as_of_date, v.document_type, v.is_trusted, m.master_json AS old_json, v.value_json AS new_json
  FROM v JOIN m USING (document_id, field_code)
  WHERE v.value_json IS NOT NULL AND v.value_json <> 'null' AND m.master_json IS DISTINCT FROM v.value_json)
"""
MASTER_FIELDS = ("current_owner_name", "pet_restrictions")


def master_diffs(spark, sf_dir):
    found = versions.diff_master(order_values(spark, sf_dir), _master(spark, sf_dir), "document_id", fields=MASTER_FIELDS)
    return found.select("document_id", "field_code", "version_id", "old_json", "new_json")


def adoption_decisions(spark, sf_dir):
    """Every master change asked for at once; one decision and reason per request."""
    diffs = versions.diff_master(versions.gated(order_values(spark, sf_dir)), _master(spark, sf_dir), "document_id", fields=MASTER_FIELDS)
    key = F.col("version_id")
    requests = diffs.select(
        F.col("document_id").alias("unit_id"),
        F.when(key % 13 == 0, F.col("document_id") + 1).otherwise(F.col("document_id")).alias("asked_unit_id"),
        "field_code", F.concat_ws(":", key, "field_code").alias("diff_id"),
        F.when(key % 17 == 0, "applied").when(key % 19 == 0, "ignored").otherwise("unreviewed").alias("review_status"),
        F.when(key % 5 == 0, "hold").otherwise("adopt").alias("action"),
        "old_json", "new_json", "is_trusted", F.lit("unit").alias("entity_level"),
        F.when(F.col("field_code") == "pet_restrictions", "important_report").otherwise("registry").alias("document_type"),
        F.col("as_of_date").alias("requested_at"))
    current = versions.unpivot_master(_master(spark, sf_dir), "document_id", list(MASTER_FIELDS)).withColumnRenamed("document_id", "unit_id")
    decided = adopt.adopt_master(requests, current)
    return decided.select("diff_id", "decision", "reason")


ADOPT_SQL = f"""WITH {VALUES_SQL}, {MASTER_SQL},
r AS (
  SELECT document_id AS unit_id, CASE WHEN version_id % 13 = 0 THEN document_id + 1 ELSE document_id END AS asked_unit_id, field_code,
    version_id || ':' || field_code AS diff_id,
    CASE WHEN version_id % 17 = 0 THEN 'applied' WHEN version_id % 19 = 0 THEN 'ignored' ELSE 'unreviewed' END AS review_status,
    CASE WHEN version_id % 5 = 0 THEN 'hold' ELSE 'adopt' END AS action, is_trusted, as_of_date FROM d),
s AS (
  SELECT *, CASE WHEN unit_id <> asked_unit_id THEN 'Unit mismatch' WHEN review_status = 'applied' THEN 'reused'
    WHEN review_status = 'ignored' THEN 'Not reviewable' WHEN action = 'hold' THEN 'held'
    WHEN NOT is_trusted THEN 'Evidence review required'
    ELSE 'ok' END AS stage FROM r),
f AS (
  SELECT *, row_number() OVER (PARTITION BY unit_id, field_code, stage ORDER BY as_of_date, diff_id) AS rn FROM s)
SELECT diff_id,
  CASE WHEN stage = 'held' THEN 'held' WHEN stage = 'reused' THEN 'reused' WHEN stage = 'ok' AND rn = 1 THEN 'applied' ELSE 'refused' END AS decision,
  CASE WHEN stage IN ('held', 'reused') THEN NULL WHEN stage = 'ok' THEN CASE WHEN rn = 1 THEN NULL ELSE 'Master changed; reload' END ELSE stage END AS reason
FROM f"""


def confirm_batch(spark, sf_dir):
    """The recommended candidate of each group adopts, the others hold."""
    sides = cut_lineage(_queue_sides(spark, sf_dir))
    chosen = versions.recommend(sides, GROUP_KEYS, "new_version").select(*GROUP_KEYS, F.col("recommended").alias("chosen"))
    return adopt.confirm_batch(sides, chosen, GROUP_KEYS, "new_version").select("document_id", "field_code", "new_version", "action")


def reused_vs_new(spark, sf_dir):
    """Which document contents were already imported by an earlier document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", content_key(F.col("text")).alias("content_hash"))
    return adopt.split_reused(docs, ["content_hash"], "doc_id")


def version_numbers(spark, sf_dir):
    """Version numbers of each document and the current version."""
    orders = order_values(spark, sf_dir).filter("field_code = 'management_fee'").select("document_id", "version_id", "as_of_date", "approved")
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), (F.col("c_nationkey") % 4).cast("long").alias("version_no"))
    numbered = versions.number_versions(orders, stored, versions.year_bucket(), versions.VERSION_ORDER)
    current = versions.latest_version(numbered.withColumn("is_current", F.col("approved")))
    return numbered.join(current.select("version_id", F.lit(True).alias("_top")), "version_id", "left").select(
        "document_id", "version_id", "version_no", F.coalesce("_top", F.lit(False)).alias("is_latest"))


def stale_pointers(spark, sf_dir):
    """Newest source value against the adopted evidence of each case; older dates never win."""
    vals = order_values(spark, sf_dir).withColumn("value_id", F.concat_ws(":", "version_id", "field_code"))
    keys, recent = ["document_id", "field_code"], [F.desc("as_of_date"), F.desc("version_id")]
    pointers = versions.initial_baseline(vals, keys, recent).select(F.col("document_id").alias("case_id"), "field_code", "value_id")
    newest = versions.latest_by_source(vals, keys, recent).withColumnRenamed("document_id", "case_id").drop("value_id")
    found = versions.diff_adopted(newest, pointers, vals)
    return found.select("case_id", "field_code", F.col("old_version_id").cast("string").alias("old_version"),
                        F.col("version_id").alias("new_version"), "old_json", F.col("value_json").alias("new_json"))


QUERIES = {
    "review_queue": (review_queue, QUEUE_SQL + "SELECT * FROM groups"),
    "initial_baseline": (initial_baseline, f"""WITH {VALUES_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, field_code ORDER BY approved DESC, as_of_date DESC, version_id DESC) AS rn FROM v WHERE is_trusted)
SELECT document_id, field_code, version_id, value_json, approved FROM r WHERE rn = 1"""),
    "latest_by_source": (latest_by_source, f"""WITH {VALUES_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, field_code ORDER BY as_of_date DESC, version_id DESC) AS rn FROM v
  WHERE value_json IS NOT NULL AND value_json <> 'null' AND document_type = CASE field_code WHEN 'current_owner_name' THEN 'registry'
    WHEN 'pet_restrictions' THEN 'management_rules' ELSE 'important_report' END)
SELECT document_id, field_code, document_type, version_id, value_json FROM r WHERE rn = 1"""),
    "approved_only_diffs": (approved_only_diffs, f"""WITH {VALUES_SQL}, seen AS (
  SELECT *, last_value(CASE WHEN approved THEN version_id END IGNORE NULLS) OVER (PARTITION BY document_id, field_code
    ORDER BY as_of_date, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS appr FROM v)
SELECT n.document_id, n.field_code, n.version_id, o.version_id AS old_version, o.value_json AS old_value, n.value_json AS new_value,
  n.value_json <> 'null' AS adoptable
FROM seen n JOIN v o ON o.version_id = n.appr AND o.field_code = n.field_code WHERE o.value_json IS DISTINCT FROM n.value_json"""),
    "master_diffs": (master_diffs, f"WITH {VALUES_SQL}, {MASTER_SQL} SELECT document_id, field_code, version_id, old_json, new_json FROM d"),
    "adoption_decisions": (adoption_decisions, ADOPT_SQL),
    "confirm_batch": (confirm_batch, QUEUE_SQL + """SELECT s.document_id, s.field_code, s.new_version,
  CASE WHEN CAST(s.new_version AS VARCHAR) = g.recommended THEN 'adopt' ELSE 'hold' END AS action
FROM sides s JOIN groups g ON s.document_id = g.document_id AND s.field_code = g.field_code AND s.old_value = g.old_value AND s.old_version = g.old_version"""),
    "reused_vs_new": (reused_vs_new, r"""WITH h AS (
  SELECT doc_id, sha256('["' || replace(replace(text, '\', '\\'), '"', '\"') || '"]') AS content_hash FROM documents)
SELECT doc_id, content_hash, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY content_hash) THEN 'new' ELSE 'reused' END AS status,
  min(doc_id) OVER (PARTITION BY content_hash) AS first_id FROM h"""),
    "version_numbers": (version_numbers, """WITH n AS (
  SELECT o_custkey AS document_id, o_orderkey AS version_id, o_orderstatus = 'F' AS cur,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + coalesce(c_nationkey % 4, 0) AS version_no
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
SELECT document_id, version_id, version_no, row_number() OVER (PARTITION BY document_id ORDER BY cur DESC, version_no DESC) = 1 AS is_latest FROM n"""),
    "stale_pointers": (stale_pointers, f"""WITH {VALUES_SQL}, b AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, field_code ORDER BY approved DESC, as_of_date DESC, version_id DESC) AS rn FROM v WHERE is_trusted) WHERE rn = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, field_code ORDER BY as_of_date DESC, version_id DESC) AS rn FROM v
  WHERE value_json <> 'null' AND document_type = CASE field_code WHEN 'current_owner_name' THEN 'registry' WHEN 'pet_restrictions' THEN 'management_rules' ELSE 'important_report' END) WHERE rn = 1)
SELECT n.document_id AS case_id, n.field_code, CAST(b.version_id AS VARCHAR) AS old_version, n.version_id AS new_version, b.value_json AS old_json, n.value_json AS new_json
FROM n LEFT JOIN b ON n.document_id = b.document_id AND n.field_code = b.field_code
WHERE n.value_json IS DISTINCT FROM b.value_json AND NOT coalesce(n.as_of_date < b.as_of_date, false)"""),
}
