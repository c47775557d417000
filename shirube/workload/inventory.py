"""Set, filter, guard and reporting operators over the supplied tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, resolve, segment, versions, views
from .adapter import VALUES_SQL, order_values, table


def unordered_nations(spark, sf_dir):
    """SET-3: nations without a supplier of positive balance."""
    supplier = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return aggregates.missing(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), supplier, ["n_nationkey"])


def parts_not_stocked(spark, sf_dir):
    """SET-2: orders that ask for a part and supplier pair beyond the first three lines' pairs, with how many."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    listed = lines.filter("l_linenumber <= 3").select("l_partkey", "l_suppkey")
    return aggregates.not_subset(lines, listed, ["l_partkey", "l_suppkey"], "l_orderkey")


def allowed_segments(spark, sf_dir):
    """FLT-2: customers per segment, on the list or off it."""
    on, off = aggregates.allowed(table(spark, sf_dir, "customer"), "c_mktsegment", ("BUILDING", "MACHINERY"))
    count = lambda df, mark: df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers")).withColumn("on_list", F.lit(mark))
    return count(on, True).unionByName(count(off, False))


def upload_order(spark, sf_dir):
    """SET-5: batches of a mixed upload; an order is a job, its lines are files."""
    kind = F.when(F.col("l_returnflag") == "R", "purchase").when(F.col("l_returnflag") == "A", "registry")
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_partkey", "l_suppkey", kind.alias("kind"))
    return resolve.upload_batches(files, False).groupBy("job_id", "batch").agg(F.count(F.lit(1)).alias("files"))


def file_routes(spark, sf_dir):
    """FLT-6: where each document goes, by its kind and what was chosen for it."""
    docs = table(spark, sf_dir, "documents")
    kinds = docs.select(F.col("doc_id").cast("string").alias("file_hash"), F.when(F.col("lang") == "en", "registry").when(F.col("lang") == "fr", "rules").alias("kind"))
    choices = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").cast("string").alias("file_hash"), F.lit("skip").alias("chosen"))
    return resolve.route_kinds(kinds, choices, ("registry",)).select("file_hash", "route")


def current_versions(spark, sf_dir):
    """AGG-20, AGG-16: versions that are current, with how many approved fields they hold."""
    values = order_values(spark, sf_dir).withColumn("value_as_of_date", F.col("as_of_date"))
    held = versions.approved_fields(values).groupBy("version_id").agg(F.count(F.lit(1)).alias("approved"))
    return versions.current_versions(values).join(held, "version_id", "left").na.fill(0, ["approved"])


def master_free_values(spark, sf_dir):
    """FLT-10: values that may feed masters, per field."""
    return views.never_master(order_values(spark, sf_dir)).groupBy("field_code").agg(F.count(F.lit(1)).alias("rows"))


def case_papers(spark, sf_dir):
    """JN-11, JN-25: documents per case, own ones and building rules, and those that belong to nobody."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    cases = customer.select(F.col("c_custkey").alias("case_id"), F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("building_id"))
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit("registry").alias("document_type"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("unit_id"), F.lit(None).cast("bigint").alias("building_id"))
    rules = nation.select((-1 - F.col("n_nationkey")).alias("document_id"), F.lit("management_rules").alias("document_type"), F.lit(None).cast("bigint").alias("unit_id"), F.col("n_nationkey").alias("building_id"))
    documents = own.unionByName(rules)
    linked = views.case_documents(cases, documents).groupBy("case_id", "document_type").agg(F.count(F.lit(1)).alias("documents"))
    loose = views.unlinked_documents(documents).groupBy("document_type").agg(F.count(F.lit(1)).alias("documents")).select(F.lit(-1).cast("bigint").alias("case_id"), "document_type", "documents")
    return linked.unionByName(loose)


def seeded_zoning(spark, sf_dir):
    """JN-26: readings that may start a building's zoning, where it has none."""
    part = table(spark, sf_dir, "part")
    values = part.select((F.col("p_partkey") % 25).alias("building_id"), "p_partkey", F.when(F.col("p_size") > 25, "zoning_type").otherwise("management_fee").alias("field_code"), F.when(F.col("p_size") % 7 == 0, "null").otherwise(F.col("p_type")).alias("value_json"))
    have = table(spark, sf_dir, "nation").filter("n_regionkey <= 1").select(F.col("n_nationkey").alias("building_id"))
    return views.seed_zoning(values, have, ("zoning_type", "floor_area_ratio")).select("building_id", "p_partkey", "needs_review")


def foreign_evidence(spark, sf_dir):
    """JN-28: customers whose values cite an order of somebody else (every 50th does)."""
    orders = table(spark, sf_dir, "orders")
    cited = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey"))
    values = orders.select("o_custkey", F.array(F.struct(cited.cast("string").alias("file_hash"))).alias("sources"))
    return views.provenance_guard(values, orders.select("o_custkey", F.col("o_orderkey").cast("string").alias("file_hash")), "o_custkey")


def overlays(spark, sf_dir):
    """WIN-18, WIN-19: the newest check per customer and priority, and each customer's first order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_hash"), F.col("o_orderpriority").alias("field_code"), (F.col("o_orderkey") * 100000 + F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01"))).alias("id"), "o_orderkey", F.to_date("o_orderdate").alias("d"))
    stamp = F.datediff("d", F.lit("1990-01-01")).cast("bigint") * 10**9 + F.col("o_orderkey")
    newest = versions.latest_overlay(orders.withColumn("verified_at", stamp), "field").select("file_hash", "field_code", "o_orderkey")
    first = versions.first_import(orders.withColumn("created_at", F.col("d")).withColumn("content_hash", F.col("o_orderkey")), ["file_hash"]).select("file_hash", F.lit("first").alias("field_code"), "o_orderkey")
    return newest.unionByName(first)


def last_entries(spark, sf_dir):
    """WIN-9: per user the last purchase and the last error, each on its own."""
    events = table(spark, sf_dir, "events")
    pick = {"purchase": F.when(F.col("event_type") == "purchase", F.col("event_id")), "error": F.when(F.col("event_type") == "error", F.col("event_id"))}
    return segment.last_filled(events, ["user_id"], "event_id", pick)


def group_quality(spark, sf_dir):
    """AGG-8: good, pending and missing readings, corrections, papers and liens per customer."""
    orders, flag = table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    fields = orders.select("o_custkey", F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("value"), (flag == "P").alias("needs_review"))
    corrections = orders.select("o_custkey", F.when(flag == "F", "kept").otherwise("changed").alias("category"))
    documents = orders.select("o_custkey", (F.col("o_orderkey") % 2 == 0).alias("all_text"))
    liens = orders.select("o_custkey", F.when(flag == "O", True).when(flag == "F", False).alias("active"))
    return aggregates.quality_summary(fields, corrections, documents, liens, "o_custkey", ["kept", "changed"])


def zone_versions(spark, sf_dir):
    """AGG-23: date and approval of a nation's merged supplier zones."""
    zones = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("building_id"), F.col("s_suppkey").alias("position"), F.when(F.col("s_suppkey") % 3 == 0, F.to_date(F.lit("2024-01-01")) + (F.col("s_suppkey") % 300).cast("int")).alias("reference_date"), (F.col("s_acctbal") < 0).alias("needs_review"), F.col("s_name").alias("source_filename"))
    previous = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("building_id"), F.to_date(F.lit("2020-02-02")).alias("as_of_date"))
    got = aggregates.zoning_version(zones, previous)
    return got.select("building_id", "zones", F.length("filenames").alias("name_length"), F.col("as_of_date").cast("string").alias("as_of_date"), "approved")


def folded_keys(spark, sf_dir):
    """SC-2, SC-14: match texts and room keys of customers."""
    room = F.concat(F.col("c_custkey").cast("string"), F.lit("号室"))
    cust = table(spark, sf_dir, "customer")
    return cust.select("c_custkey", text.match_text(F.concat(F.col("c_name"), F.lit(" ・　"), F.col("c_mktsegment"))).alias("match_text"), F.coalesce(text.room_key(room), F.lit("")).alias("room"))


QUERIES = {
    "unordered_nations": (unordered_nations, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)"),
    "parts_not_stocked": (parts_not_stocked, """WITH k AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3)
SELECT l_orderkey, count(*) AS outside FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.l_partkey = l.l_partkey AND k.l_suppkey = l.l_suppkey) GROUP BY 1"""),
    "allowed_segments": (allowed_segments, "SELECT c_mktsegment, count(*) AS customers, c_mktsegment IN ('BUILDING', 'MACHINERY') AS on_list FROM customer GROUP BY 1"),
    "upload_order": (upload_order, """WITH f AS (SELECT l_orderkey AS job_id, CASE l_returnflag WHEN 'R' THEN 'purchase' WHEN 'A' THEN 'registry' ELSE '' END AS kind FROM lineitem),
m AS (SELECT job_id, bool_or(kind = 'purchase') AND bool_or(kind <> 'purchase') AS mixed FROM f GROUP BY 1)
SELECT job_id, CASE WHEN mixed AND kind <> 'purchase' THEN 2 ELSE 1 END AS batch, count(*) AS files FROM f JOIN m USING (job_id) GROUP BY 1, 2"""),
    "file_routes": (file_routes, """SELECT CAST(d.doc_id AS VARCHAR) AS file_hash, CASE WHEN quality = 0 THEN 'skipped' WHEN lang = 'en' THEN 'selected' WHEN lang = 'fr' THEN 'excluded' ELSE 'unknown' END AS route
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND quality = 0"""),
    "current_versions": (current_versions, f"WITH {VALUES_SQL} SELECT version_id, bool_or(approved) AS is_current, count(*) FILTER (WHERE approved) AS approved FROM v GROUP BY 1"),
    "master_free_values": (master_free_values, f"WITH {VALUES_SQL} SELECT field_code, count(*) AS rows FROM v WHERE field_code <> 'current_owner_name' GROUP BY 1"),
    "case_papers": (case_papers, """SELECT o_custkey AS case_id, 'registry' AS document_type, count(*) AS documents FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 <> 0 GROUP BY 1
UNION ALL SELECT c_custkey, 'management_rules', 1 FROM customer UNION ALL SELECT -1, 'registry', count(*) FROM orders WHERE o_orderkey % 5 = 0"""),
    "seeded_zoning": (seeded_zoning, """SELECT p_partkey % 25 AS building_id, p_partkey, true AS needs_review FROM part WHERE p_size > 25 AND p_size % 7 <> 0
AND p_partkey % 25 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <= 1)"""),
    "foreign_evidence": (foreign_evidence, """SELECT DISTINCT o_custkey FROM orders o WHERE o_orderkey % 50 = 0 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey = o.o_orderkey + 1)"""),
    "overlays": (overlays, """SELECT o_custkey AS file_hash, o_orderpriority AS field_code, arg_max(o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS BIGINT) * 1000000000 + o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2
UNION ALL SELECT o_custkey, 'first', arg_min(o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS BIGINT) * 1000000000 + o_orderkey) FROM orders GROUP BY 1"""),
    "last_entries": (last_entries, """SELECT user_id, max(event_id) FILTER (WHERE event_type = 'purchase') AS purchase, max(event_id) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1"""),
    "group_quality": (group_quality, """SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS text_documents, count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS scan_documents,
  count(*) FILTER (WHERE o_orderpriority <> '4-NOT SPECIFIED' AND o_orderstatus <> 'P') AS good, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS unavailable,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS corrected_kept, count(*) FILTER (WHERE o_orderstatus <> 'F') AS corrected_changed,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS active_liens, count(*) FILTER (WHERE o_orderstatus = 'F') AS inactive_liens, count(*) FILTER (WHERE o_orderstatus = 'P') AS unknown_liens FROM orders GROUP BY 1"""),
    "zone_versions": (zone_versions, """SELECT s_nationkey AS building_id, count(*) AS zones, sum(length(s_name)) + count(*) - 1 AS name_length,
  CAST(coalesce(max(CASE WHEN s_suppkey % 3 = 0 THEN DATE '2024-01-01' + CAST(s_suppkey % 300 AS INT) END), DATE '2020-02-02') AS VARCHAR) AS as_of_date, NOT bool_or(s_acctbal < 0) AS approved FROM supplier GROUP BY 1"""),
    "folded_keys": (folded_keys, """SELECT c_custkey, replace(c_name, ' ', '') || replace(c_mktsegment, ' ', '') AS match_text, CAST(c_custkey AS VARCHAR) AS room FROM customer"""),
}
