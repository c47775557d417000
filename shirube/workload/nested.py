"""Nested documents, older forms, checks and grants over the supplied tables: an order is a document, its lines are a list in it."""
from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import nested
from ..plans import convert, renest as R, sanity
from ..plans.flatten import flatten_fields
from ..streaming import grants
from .adapter import table

FIELD = "struct<value:string,sources:array<struct<page:int,text:string>>,needs_review:boolean,confidence:double>"
DOCUMENT = f"o_orderkey long, head struct<status:{FIELD},place:struct<clerk:{FIELD}>>, lines array<struct<part:{FIELD},qty:{FIELD}>>"


def _field(value, review=None, confidence=None, page=None):
    source = F.array(F.struct((F.lit(1) if page is None else page).cast("int").alias("page"), value.cast("string").alias("text")))
    return F.struct(value.cast("string").alias("value"), source.alias("sources"), (F.lit(False) if review is None else review).alias("needs_review"), (F.lit(1.0) if confidence is None else confidence).cast("double").alias("confidence"))


def _documents(spark, sf_dir):
    """Orders with their lines as typed documents; a line number counts once, whichever line of an order bears it."""
    part, qty = F.col("l_partkey"), F.col("l_quantity").cast("int")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity")).alias("l")).select("l_orderkey", "l_linenumber", "l.*")
    lines = lines.withColumn("line", F.struct(_field(part, page=F.col("l_linenumber")).alias("part"), _field(qty, part % 50 == 0, F.when(part % 40 == 1, 0.5).otherwise(0.9)).alias("qty")))
    lines = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]).alias("lines"))
    orders = table(spark, sf_dir, "orders")
    head = F.struct(_field(F.col("o_orderstatus"), F.col("o_orderkey") % 90 == 0).alias("status"), F.struct(_field(F.col("o_custkey")).alias("clerk")).alias("place"))
    joined = orders.select("o_orderkey", head.alias("head")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", "head", "lines")


LINES_SQL = """l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, p.l_partkey AS part, CAST(p.l_quantity AS INT) AS qty
  FROM (SELECT l_orderkey, l_linenumber, min((l_partkey, l_quantity)) AS q FROM lineitem GROUP BY 1, 2) JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) p USING (l_orderkey, l_linenumber)
  WHERE (p.l_partkey, p.l_quantity) = q)"""


def path_get(spark, sf_dir):
    """NST-1: one path per order, into its head, its list, past the list's end or nowhere."""
    docs = _documents(spark, sf_dir).select("o_orderkey", F.to_json(F.struct("head", "lines")).alias("j"))
    i = F.floor(F.col("o_orderkey") / 4) % 3
    path = (F.when(F.col("o_orderkey") % 4 == 0, "head.status").when(F.col("o_orderkey") % 4 == 1, "head.place.clerk")
            .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("lines."), i.cast("string"), F.lit(".part"))).otherwise("head.none.x"))
    return docs.select("o_orderkey", path.alias("path"), nested.value_at(F.parse_json("j"), path).alias("value"))


def stripped(spark, sf_dir):
    """NST-2: plain values, number of sources, last page and whether anything is uncertain, per order."""
    docs = _documents(spark, sf_dir).select("o_orderkey", F.struct("head", "lines").alias("d"))
    kind = docs.schema["d"].dataType
    got = docs.select("o_orderkey", nested.strip(F.col("d"), kind).alias("v"), nested.sources_of(F.col("d"), kind).alias("s"), nested.is_uncertain(F.col("d"), kind).alias("uncertain"))
    return got.select("o_orderkey", F.col("v.head.status").alias("status"), F.col("v.head.place.clerk").alias("clerk"), F.array_join(F.transform("v.lines", lambda x: x["qty"]), ",").alias("quantities"),
                      F.size("s").cast("long").alias("sources"), F.array_max(F.transform("s", lambda x: x["page"])).alias("last_page"), "uncertain")


def renested(spark, sf_dir):
    """NST-7: orders taken apart to field rows and put together again."""
    docs = _documents(spark, sf_dir)
    again = R.renest(flatten_fields(docs, "o_orderkey"), T.StructType.fromDDL(DOCUMENT), "o_orderkey")
    return again.select("o_orderkey", F.col("head.status.value").alias("status"), F.col("head.place.clerk.value").alias("clerk"), F.array_join(F.transform("lines", lambda x: F.concat(x["part"]["value"], F.lit(":"), x["qty"]["value"])), ",").alias("lines"),
                        F.coalesce(F.size(F.filter("lines", lambda x: x["qty"]["needs_review"])), F.lit(0)).cast("long").alias("reviews"), F.col("lines")[0]["part"]["sources"][0]["page"].alias("first_page"))


def closed_bundles(spark, sf_dir):
    """SRC-4: the first place where an order's bundle breaks the closed type; some orders have a key, a type or a number wrong."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    item = F.when(k % 7 == 1, '{"area":"x","ok":true}').when(k % 7 == 2, '{"area":1e400,"ok":true}').when(k % 7 == 3, '{"area":1}').otherwise('{"area":1.5,"ok":null}')
    name = F.when(k % 11 == 1, "true").otherwise(F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    extra = F.when(k % 13 == 1, ',"more":1').otherwise("")
    text = F.concat(F.lit('{"id":'), k, F.lit(',"name":'), name, F.lit(',"parts":[{"area":2,"ok":false},'), item, F.lit("]"), extra, F.lit("}"))
    kind = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("parts", T.ArrayType(T.StructType([T.StructField("area", T.DoubleType(), False), T.StructField("ok", T.BooleanType())]), False), False)])
    return o.select("o_orderkey", nested.first_fault(F.parse_json(text), kind).alias("f")).select("o_orderkey", F.col("f.path").alias("path"), F.col("f.reason").alias("reason"))


def zone_fields(spark, sf_dir):
    """NST-5: zones of a nation's building, one zone per supplier, as field rows."""
    cell = lambda v: F.struct(v.cast("string").alias("value"), F.lit(1).alias("page_no"), F.lit("q").alias("source_text"), (F.col("s_acctbal") < 0).alias("needs_review"))
    zone = F.struct(F.col("s_name").alias("zone_label"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 3 == 1).alias("needs_review"),
                    F.map_from_arrays(F.array(F.lit("zoning_type"), F.lit("ratio")), F.array(cell(F.col("s_nationkey")), F.when(F.col("s_suppkey") % 2 == 0, cell(F.col("s_suppkey"))))).alias("fields"))
    zones = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("building_id"), F.array(zone).alias("zones"))
    labels = table(spark, sf_dir, "region").select(F.lit("zoning_type").alias("field_code"), F.lit("Zone").alias("label")).distinct()
    return R.zone_rows(zones, "building_id", labels).select("building_id", "zone_label", "zone_review", "code", "label", "value", "needs_review")


def legacy_columns(spark, sf_dir):
    """PRJ-12: customers as documents of the older form, to field rows; wrong branches and areas are rejected."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    area = F.when(k % 9 == 0, "about").otherwise(F.concat((k % 90 + 10).cast("string"), F.lit(":"), F.lit("50")))
    document = F.to_json(F.struct(
        F.struct(F.col("c_name").alias("所在_市区町村町名"), F.when(k % 5 != 0, k).alias("所在_番"), F.lit("鉄骨").alias("構造")).alias("一棟の建物"),
        F.array(F.struct(F.lit("所有権").alias("権利の種類"), (k % 7 + 1).alias("持分_分子"), F.lit(100).alias("持分_分母")), F.struct(F.lit("所有権").alias("権利の種類"), F.when(k % 2 == 0, k % 7 + 1).otherwise(9).alias("持分_分子"), F.lit(100).alias("持分_分母"))).alias("土地"),
        F.struct(F.when(k % 8 == 0, k + 1).otherwise(k).alias("家屋番号_枝番"), (k % 20).alias("階部分"), area.alias("床面積"), F.struct(F.lit("平成").alias("元号"), (k % 20 + 1).alias("年"), F.lit(3).alias("月"), F.lit(4).alias("日")).alias("建築時期")).alias("専有部分"),
        (k % 3 == 0).alias("敷地権")))
    docs = c.select(k.alias("file_hash"), F.concat(F.lit("12の"), k).alias("house_number"), document.alias("document"))
    _, _, values, rejects = convert.convert_legacy(docs)
    kept = values.filter("field_code not in ('land_lots', 'floor_areas')").select("file_hash", "field_code", "value")
    return kept.unionByName(rejects.select("file_hash", F.lit("rejected").alias("field_code"), F.col("reason").alias("value")))


def sanity_checks(spark, sf_dir):
    """AGG-17: orders checked: their lines are parcels and floors, the customer's name the owner."""
    o, l, key = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), F.col("o_orderkey")
    total = l.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("t"))
    documents = o.join(total, key == F.col("l_orderkey"), "left").select(
        key.alias("file_hash"), F.when(key % 10 != 0, "1").alias("lot"), F.lit("AB").alias("town"), F.when(key % 6 == 0, "X").otherwise("A").alias("form_ward"), F.lit("B").alias("form_town"),
        F.when(key % 4 == 0, F.col("t") + 1).otherwise(F.col("t")).cast("string").alias("printed_total"))
    fields = o.select(key.alias("file_hash"), F.lit("current_owner_name").alias("field_code"), F.when(key % 15 == 0, F.concat_ws("、", "o_orderstatus", "o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("value"))
    parcels = l.select(F.col("l_orderkey").alias("file_hash"), F.col("l_linenumber").alias("parcel_no"), F.col("l_quantity").cast("int").cast("string").alias("numerator"), F.lit("49").alias("denominator"))
    floors = l.select(F.col("l_orderkey").alias("file_hash"), F.col("l_linenumber").cast("string").alias("floor"), F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("area"))
    return sanity.sanity_checks(documents, fields, parcels, floors).withColumn("file_hash", F.col("file_hash").cast("long"))


def grants_once(spark, sf_dir):
    """STR-6: views are plans and purchases their uses, of one user and kind; the price setting is that of the value's class."""
    events = table(spark, sf_dir, "events").filter("event_type in ('view', 'purchase')")
    rows = events.select((F.col("user_id") % 2).cast("string").alias("kind"), F.col("user_id").cast("string").alias("file_hash"), "event_id", "ts", (F.col("event_type") == "view").alias("is_plan"), (F.col("event_id") % 3 > 0).cast("string").alias("price_key"))
    return grants.grant_once(rows, F.to_date("ts"), 600).select("kind", F.col("file_hash").cast("long").alias("user_id"), "use_id", F.col("plan_id").cast("string").alias("plan_id"), "granted")


QUERIES = {
    "path_get": (path_get, f"""WITH {LINES_SQL}
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'head.status' WHEN 1 THEN 'head.place.clerk' WHEN 2 THEN 'lines.' || ((o_orderkey // 4) % 3) || '.part' ELSE 'head.none.x' END AS path,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN CAST(part AS VARCHAR) END AS value
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey AND o_orderkey % 4 = 2 AND i = (o_orderkey // 4) % 3"""),
    "stripped": (stripped, f"""WITH {LINES_SQL}, g AS (
  SELECT l_orderkey, string_agg(CAST(qty AS VARCHAR), ',' ORDER BY i) AS quantities, count(*) AS n, max(l_linenumber) AS last, bool_or(part % 50 = 0 OR part % 40 = 1) AS odd FROM l GROUP BY 1)
SELECT o_orderkey, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS clerk, quantities, 2 + 2 * coalesce(n, 0) AS sources, greatest(1, coalesce(last, 1)) AS last_page, o_orderkey % 90 = 0 OR coalesce(odd, false) AS uncertain
FROM orders LEFT JOIN g ON l_orderkey = o_orderkey"""),
    "renested": (renested, f"""WITH {LINES_SQL}, g AS (
  SELECT l_orderkey, string_agg(part || ':' || qty, ',' ORDER BY i) AS lines, count(*) FILTER (WHERE part % 50 = 0) AS reviews, min(l_linenumber) AS first_page FROM l GROUP BY 1)
SELECT o_orderkey, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS clerk, lines, coalesce(reviews, 0) AS reviews, first_page FROM orders LEFT JOIN g ON l_orderkey = o_orderkey"""),
    "closed_bundles": (closed_bundles, """WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 1 THEN 'root/keys' WHEN o_orderkey % 11 = 1 THEN 'root.name/type' WHEN o_orderkey % 7 = 1 THEN 'root.parts[1].area/type'
  WHEN o_orderkey % 7 = 2 THEN 'root.parts[1].area/not finite' WHEN o_orderkey % 7 = 3 THEN 'root.parts[1]/keys' END AS f FROM orders)
SELECT o_orderkey, split_part(f, '/', 1) AS path, split_part(f, '/', 2) AS reason FROM f WHERE f IS NOT NULL UNION ALL SELECT o_orderkey, NULL, NULL FROM f WHERE f IS NULL"""),
    "zone_fields": (zone_fields, """SELECT s_suppkey AS building_id, s_name AS zone_label, s_suppkey % 3 <> 2 AS zone_review, 'zoning_type' AS code, 'Zone' AS label, CAST(s_nationkey AS VARCHAR) AS value, s_acctbal < 0 AS needs_review FROM supplier
UNION ALL SELECT s_suppkey, s_name, s_suppkey % 3 <> 2, 'ratio', 'ratio', CAST(s_suppkey AS VARCHAR), s_acctbal < 0 FROM supplier WHERE s_suppkey % 2 = 0"""),
    "legacy_columns": (legacy_columns, """WITH g AS (SELECT *, c_custkey AS k FROM customer WHERE c_custkey % 8 <> 0 AND c_custkey % 9 <> 0)
SELECT c_custkey AS file_hash, 'rejected' AS field_code, CASE WHEN c_custkey % 8 = 0 THEN 'house number' ELSE 'registered_area: form' END AS value FROM customer WHERE c_custkey % 8 = 0 OR c_custkey % 9 = 0
UNION ALL SELECT k, 'house_number', '12の' || k FROM g UNION ALL SELECT k, 'registry_location', c_name || k || '番地' FROM g WHERE k % 5 <> 0
UNION ALL SELECT k, 'building_structure', '鉄骨' FROM g UNION ALL SELECT k, 'unit_floor', (k % 20) || '階部分' FROM g
UNION ALL SELECT k, 'registered_area', (k % 90 + 10) || '.5' FROM g UNION ALL SELECT k, 'built_date', (1989 + k % 20) || '-03-04' FROM g
UNION ALL SELECT k, 'has_land_right', CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END FROM g
UNION ALL SELECT k, 'land_right_type', '所有権' FROM g WHERE k % 3 = 0 UNION ALL SELECT k, 'land_right_denominator', '100' FROM g WHERE k % 3 = 0
UNION ALL SELECT k, 'land_right_numerator', CAST(k % 7 + 1 AS VARCHAR) FROM g WHERE k % 3 = 0 AND k % 2 = 0"""),
    "sanity_checks": (sanity_checks, """WITH t AS (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS t FROM lineitem GROUP BY 1)
SELECT o_orderkey AS file_hash, 'several_owners' AS rule, o_orderstatus || '、' || o_orderpriority AS detail FROM orders WHERE o_orderkey % 15 = 0
UNION ALL SELECT l_orderkey, 'share_above_one', 'parcel ' || l_linenumber || ': ' || CAST(l_quantity AS INT) || '/49' FROM lineitem WHERE CAST(l_quantity AS INT) > 49
UNION ALL SELECT o_orderkey, 'lot_missing', '' FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, 'place_differs', 'XB / AB' FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT o_orderkey, 'floor_total_differs', regexp_replace(CAST(t AS VARCHAR), '\\.?0+$', '') || ' / ' || CAST(t + 1 AS VARCHAR) FROM orders JOIN t ON l_orderkey = o_orderkey WHERE o_orderkey % 4 = 0"""),
    "grants_once": (grants_once, """WITH e AS (SELECT *, event_id % 3 > 0 AS price, lag(event_type) OVER w AS pt, lag(ts) OVER w AS pts, lag(event_id) OVER w AS pid FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, coalesce(pt = 'view' AND (pid % 3 > 0) = price AND ts <= pts + INTERVAL 600 MINUTE, false) AS granted FROM e WHERE event_type = 'purchase')
SELECT CAST(user_id % 2 AS VARCHAR) AS kind, user_id, event_id AS use_id, CASE WHEN granted THEN CAST(pid AS VARCHAR) END AS plan_id, granted FROM g"""),
}
