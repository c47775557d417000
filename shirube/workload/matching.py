"""Entity resolution and integration."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.evidence import content_key
from ..operators import lands, resolve, views
from .adapter import table


def match_two_of_three(spark, sf_dir):
    """Every part against the distinct (name, brand, type) entities: two agreeing keys make a candidate."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    masters = part.groupBy("name", "brand", "type").agg(F.min("p_partkey").alias("building_id"))
    found = resolve.two_of_three(part, masters, ("name", "brand", "type"), "building_id")
    return found.select("p_partkey", F.col("building_matches").alias("candidates"), F.col("building_id").cast("string").alias("building_id"),
                        resolve.match_status(F.col("building_matches")).alias("status"))


def match_cascade(spark, sf_dir):
    """Customers as reports, suppliers as units: explicit id, then house number, then a composite key."""
    cust, supp = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    reports = cust.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey")).alias("explicit_id"),
                          F.when(F.col("c_mktsegment") == "MACHINERY", F.floor("c_acctbal").cast("string")).alias("house_number"),
                          F.col("c_nationkey").alias("building"), F.floor(F.col("c_acctbal") / 1000).alias("room"))
    units = supp.select(F.col("s_suppkey").alias("unit_id"), F.col("s_suppkey").alias("explicit_id"),
                        F.floor("s_acctbal").cast("string").alias("house_number"), F.col("s_nationkey").alias("building"),
                        F.floor(F.col("s_acctbal") / 1000).alias("room"))
    found = resolve.identity_cascade(reports, units, [("explicit", ["explicit_id"]), ("house", ["house_number"]), ("composite", ["building", "room"])])
    return found.select("c_custkey", F.col("resolved_id").cast("string").alias("resolved_id"), "resolved_by")


def find_or_create(spark, sf_dir):
    """Case requests from customers against nations, suppliers and their open orders."""
    cust, supp = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    requests = cust.select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey") + F.floor(F.col("c_acctbal") / 4000)).alias("registry_location"),
                           F.concat(F.lit("Supplier#"), F.lpad(F.floor(F.abs(F.col("c_acctbal")) / 50).cast("string"), 9, "0")).alias("house_number"),
                           F.col("c_name").alias("building_name"), F.col("c_mktsegment").alias("unit_name"))
    buildings = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("building_id"), F.col("n_name").alias("registry_location"))
    units = supp.select(F.col("s_suppkey").alias("unit_id"), F.col("s_name").alias("house_number"), F.col("s_nationkey").alias("building_id"))
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("unit_id"),
                                                  F.when(F.col("o_orderstatus") == "F", "completed").otherwise("draft").alias("case_status"), F.col("o_orderdate").alias("updated_at"))
    found = resolve.find_or_create(requests, buildings, units, cases)
    ids = [F.col(c).cast("string").alias(c) for c in ("building_id", "unit_id", "case_id")]
    return found.select("c_custkey", "outcome", *ids)


def known_files_conflict(spark, sf_dir):
    """Contents of each source against the sources that hold the same content."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", content_key(F.col("text")).alias("file_hash"))
    files = docs.select(F.col("file_hash").alias("request_id"), "file_hash")
    found = resolve.known_files(files, docs.select("file_hash", F.col("source").alias("unit_id")))
    return found.select(F.col("request_id").alias("file_hash"), "units", "unit_id", "status")


def case_refs(spark, sf_dir):
    """Mixed references (order or unit) resolved to unit and building; unknown ones are counted."""
    orders, cust = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    refs = orders.select(F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("unit-"), F.col("o_custkey") * 2)).otherwise(F.col("o_orderkey").cast("string")).alias("ref")).distinct()
    cases = orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("unit_id"))
    units = cust.select(F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("building_id"))
    resolved, rejects = resolve.resolve_case_refs(refs, cases, units)
    good = resolved.select("ref", "unit_id", F.col("building_id").cast("string").alias("building_id"), F.lit("resolved").alias("status"))
    return good.unionByName(rejects.select("ref", F.lit(None).cast("string").alias("unit_id"), F.lit(None).cast("string").alias("building_id"), F.lit("unknown").alias("status")))


def cases_or_units(spark, sf_dir):
    orders, cust = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cases = orders.select(F.concat(F.lit("case-"), "o_orderkey").alias("case_id"), F.col("o_custkey").cast("string").alias("unit_id"), F.col("o_orderstatus").alias("case_status"))
    return views.cases_or_units(cases, cust.select(F.col("c_custkey").cast("string").alias("unit_id")))


def integrate_outer(spark, sf_dir):
    """Line totals against order headers: fill what is missing, flag what differs."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        F.sum(F.col("l_quantity").cast("long")).cast("string").alias("amount"), F.max(F.year("l_shipdate")).cast("string").alias("year"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.floor(F.col("o_totalprice") / 3000).cast("string").alias("amount"),
                                                   F.year("o_orderdate").cast("string").alias("year"))
    found = lands.integrate_outer(lines, orders, ["key"], ["amount", "year"], fold=lambda c: c)
    return found.select("key", "side", "amount", "year", F.array_join("mismatches", ",").alias("mismatches"))


def outside_site(spark, sf_dir):
    """Lots (sizes) sold per brand and type that the brand's site list does not name."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    sites = part.select("p_brand", "p_type", "p_size").distinct().groupBy("p_brand", "p_type").agg(
        F.concat(F.lit("港区架空"), F.array_join(F.transform(F.array_sort(F.collect_list("p_size")), lambda s: F.concat(s.cast("string"), F.lit("番1"))), "、")).alias("location_text"))
    parcels = line.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey").select(
        "p_brand", "p_type", F.lit("港区架空").alias("location"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("番1")).alias("lot_number")).distinct()
    found = lands.outside_site(parcels, sites, ["p_brand", "p_type"])
    return found.filter("outside").select("p_brand", "p_type", "lot_number")


def exact_shares(spark, sf_dir):
    """Fractions quantity / (50 * line number) added exactly per order."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("n"), (F.col("l_linenumber") * 50).cast("long").alias("d"))
    return lands.sum_shares(line, ["l_orderkey"])


def common_share(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_suppkey", F.col("l_quantity").cast("long").alias("n"), F.lit(50).cast("long").alias("d"),
                                                   (F.col("l_returnflag") == "R").alias("needs_review"))
    one = lands.common_share(line, ["order_id", "l_suppkey"])
    return one.select("order_id", "l_suppkey", F.col("n").cast("string").alias("n"), F.col("d").cast("string").alias("d"))


def cancel_join(spark, sf_dir):
    """Order lines as lien entries: returns cancel, adjustments amend, the rest are set-ups."""
    line = table(spark, sf_dir, "lineitem")
    target = (F.col("l_partkey") % 7 + 1).cast("string")
    other = (F.col("l_suppkey") % 7 + 1).cast("string")
    entries = line.select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("string").alias("rank"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("ord"),
        F.when(F.col("l_returnflag") == "R", F.concat(target, F.lit("番、"), other, F.lit("番抵当権抹消")))
        .when(F.col("l_returnflag") == "A", F.concat(target, F.lit("番抵当権変更"))).otherwise("抵当権設定").alias("purpose"),
        F.concat(F.lit("債権額金"), F.col("l_quantity").cast("int").cast("string"), F.lit("円債務者甲抵当権者乙")).alias("body"))
    state = lands.mortgage_state(entries, ["file_id"])
    return state.select("file_id", "rank", "ord", "amount", "active", F.col("cancelled_by").cast("string").alias("cancelled_by"), "needs_review")


QUERIES = {
    "match_two_of_three": (match_two_of_three, """WITH m AS (SELECT p_name, p_brand, p_type, min(p_partkey) AS building_id FROM part GROUP BY 1, 2, 3),
c AS (SELECT p.p_partkey, m.building_id FROM part p JOIN m ON (p.p_name = m.p_name AND p.p_brand = m.p_brand) OR (p.p_name = m.p_name AND p.p_type = m.p_type) OR (p.p_brand = m.p_brand AND p.p_type = m.p_type)),
g AS (SELECT p_partkey, count(DISTINCT building_id) AS n, min(building_id) AS b FROM c GROUP BY 1)
SELECT p_partkey, n AS candidates, CASE WHEN n = 1 THEN CAST(b AS VARCHAR) END AS building_id, CASE WHEN n = 0 THEN 'new' WHEN n = 1 THEN 'existing' ELSE 'ambiguous' END AS status FROM g"""),
    "match_cascade": (match_cascade, """WITH r AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END AS e, CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS h,
  c_nationkey AS b, CAST(floor(c_acctbal / 1000) AS BIGINT) AS room FROM customer),
u AS (SELECT s_suppkey AS id, CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS h, s_nationkey AS b, CAST(floor(s_acctbal / 1000) AS BIGINT) AS room FROM supplier),
hu AS (SELECT h, count(*) AS n, min(id) AS id FROM u GROUP BY 1), cu AS (SELECT b, room, count(*) AS n, min(id) AS id FROM u GROUP BY 1, 2),
j AS (SELECT r.*, u.id AS e_id, hu.n AS h_n, hu.id AS h_id, cu.n AS c_n, cu.id AS c_id FROM r LEFT JOIN u ON u.id = r.e LEFT JOIN hu ON hu.h = r.h LEFT JOIN cu ON cu.b = r.b AND cu.room = r.room)
SELECT c_custkey, CAST(CASE WHEN e IS NOT NULL THEN e_id WHEN h_n = 1 THEN h_id WHEN h_n > 1 THEN NULL WHEN c_n = 1 THEN c_id END AS VARCHAR) AS resolved_id,
  CASE WHEN e IS NOT NULL THEN CASE WHEN e_id IS NOT NULL THEN 'explicit' END WHEN h_n = 1 THEN 'house' WHEN h_n > 1 THEN NULL WHEN c_n = 1 THEN 'composite' END AS resolved_by FROM j"""),
    "find_or_create": (find_or_create, """WITH r AS (SELECT c_custkey, 'NATION_' || (c_nationkey + CAST(floor(c_acctbal / 4000) AS BIGINT)) AS loc,
  'Supplier#' || lpad(CAST(CAST(floor(abs(c_acctbal) / 50) AS BIGINT) AS VARCHAR), 9, '0') AS house FROM customer),
o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'F'),
j AS (SELECT r.c_custkey, n.n_nationkey AS b, s.s_suppkey AS u, s.s_nationkey AS ub, o.o_orderkey AS c FROM r LEFT JOIN nation n ON n.n_name = r.loc LEFT JOIN supplier s ON s.s_name = r.house
  LEFT JOIN o ON o.o_custkey = s.s_suppkey AND o.rn = 1),
k AS (SELECT *, CASE WHEN u IS NOT NULL AND ub IS DISTINCT FROM b THEN 'ambiguous' WHEN b IS NULL THEN 'create_building' WHEN u IS NULL THEN 'create_unit' WHEN c IS NULL THEN 'create_case' ELSE 'reuse' END AS outcome FROM j)
SELECT c_custkey, outcome, CAST(CASE WHEN outcome <> 'ambiguous' THEN b END AS VARCHAR) AS building_id, CAST(CASE WHEN outcome <> 'ambiguous' THEN u END AS VARCHAR) AS unit_id,
  CAST(CASE WHEN outcome <> 'ambiguous' THEN c END AS VARCHAR) AS case_id FROM k"""),
    "known_files_conflict": (known_files_conflict, r"""SELECT sha256('["' || replace(replace(text, '\', '\\'), '"', '\"') || '"]') AS file_hash, count(DISTINCT source) AS units,
  CASE WHEN count(DISTINCT source) = 1 THEN min(source) END AS unit_id, CASE WHEN count(DISTINCT source) > 1 THEN 'conflict' ELSE 'cached' END AS status FROM documents GROUP BY 1"""),
    "case_refs": (case_refs, """WITH r AS (SELECT DISTINCT CASE WHEN o_orderpriority = '5-LOW' THEN 'unit-' || (o_custkey * 2) ELSE CAST(o_orderkey AS VARCHAR) END AS ref FROM orders),
k AS (SELECT ref, CASE WHEN ref LIKE 'unit-%' THEN substr(ref, 6) ELSE CAST(o_custkey AS VARCHAR) END AS uid FROM r LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = ref)
SELECT ref, CASE WHEN c_custkey IS NOT NULL THEN uid END AS unit_id, CAST(c_nationkey AS VARCHAR) AS building_id, CASE WHEN c_custkey IS NULL THEN 'unknown' ELSE 'resolved' END AS status
FROM k LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = uid"""),
    "cases_or_units": (cases_or_units, """SELECT 'case-' || o_orderkey AS case_id, CAST(o_custkey AS VARCHAR) AS unit_id, o_orderstatus AS case_status FROM orders
UNION ALL SELECT 'unit-' || c_custkey, CAST(c_custkey AS VARCHAR), '案件未登録' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"""),
    "integrate_outer": (integrate_outer, """WITH l AS (SELECT l_orderkey AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS VARCHAR) AS amount, CAST(max(year(l_shipdate)) AS VARCHAR) AS year FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS key, CAST(CAST(floor(o_totalprice / 3000) AS BIGINT) AS VARCHAR) AS amount, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders)
SELECT coalesce(l.key, o.key) AS key, CASE WHEN l.key IS NULL THEN 'right' WHEN o.key IS NULL THEN 'left' ELSE 'both' END AS side, coalesce(l.amount, o.amount) AS amount, coalesce(l.year, o.year) AS year,
  concat_ws(',', CASE WHEN l.amount <> o.amount THEN 'amount' END, CASE WHEN l.year <> o.year THEN 'year' END) AS mismatches FROM l FULL JOIN o ON l.key = o.key"""),
    "outside_site": (outside_site, """SELECT DISTINCT p_brand, p_type, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '番1' AS lot_number FROM lineitem JOIN part p ON p_partkey = l_partkey
WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_type = p.p_type AND q.p_size = CAST(l_quantity AS INT))"""),
    "exact_shares": (exact_shares, """WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT) * (420 // l_linenumber)) AS BIGINT) AS num FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(num // gcd(num, 21000) AS VARCHAR) AS n, CAST(21000 // gcd(num, 21000) AS VARCHAR) AS d, num = 21000 AS is_whole FROM s"""),
    "common_share": (common_share, """SELECT l_orderkey AS order_id, l_suppkey,
  CASE WHEN bool_and(l_returnflag <> 'R') AND count(DISTINCT CAST(l_quantity AS BIGINT)) = 1 THEN CAST(min(CAST(l_quantity AS BIGINT)) AS VARCHAR) END AS n,
  CASE WHEN bool_and(l_returnflag <> 'R') AND count(DISTINCT CAST(l_quantity AS BIGINT)) = 1 THEN '50' END AS d FROM lineitem GROUP BY 1, 2"""),
    "cancel_join": (cancel_join, """WITH e AS (SELECT l_orderkey AS file_id, CAST(l_linenumber AS VARCHAR) AS rank, l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS ord, l_returnflag AS f,
  CAST(l_partkey % 7 + 1 AS VARCHAR) AS t1, CAST(l_suppkey % 7 + 1 AS VARCHAR) AS t2, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem),
c AS (SELECT file_id, t AS rank, max(ord) AS by_ FROM (SELECT file_id, t1 AS t, ord FROM e WHERE f = 'R' UNION ALL SELECT file_id, t2, ord FROM e WHERE f = 'R') GROUP BY 1, 2),
a AS (SELECT file_id, t1 AS rank, max_by(q, ord) AS q FROM e WHERE f = 'A' GROUP BY 1, 2)
SELECT e.file_id, e.rank, e.ord, '金' || coalesce(a.q, e.q) || '円' AS amount, CASE WHEN c.by_ IS NOT NULL THEN false WHEN a.q IS NULL THEN true END AS active,
  CAST(c.by_ AS VARCHAR) AS cancelled_by, a.q IS NOT NULL AND c.by_ IS NULL AS needs_review
FROM e LEFT JOIN c ON e.file_id = c.file_id AND e.rank = c.rank LEFT JOIN a ON e.file_id = a.file_id AND e.rank = a.rank WHERE e.f = 'N'"""),
}
