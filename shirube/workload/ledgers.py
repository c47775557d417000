"""Document text that Spark writes from the tables and the extraction jobs read back.

Each query turns whole tables into ruled ledgers, certificates, rules or leases, runs the job on them,
and is compared with the plain table values.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segment
from ..plans import extract, normalize
from .adapter import table


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def ruled_ledger(spark, sf_dir):
    """A ledger per customer: one record of two rows per order, pages by year, filled orders struck."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("file_hash"), F.year("o_orderdate").alias("page_no"), "o_orderkey", "o_orderstatus",
                                                   "o_orderpriority", F.floor("o_totalprice").alias("price"))
    first = _text("┃", F.col("o_orderkey"), "│", F.col("o_orderpriority"), "│", F.col("page_no"), "│", F.col("price"), "┃")
    second = _text("┃　│　│　│", F.col("o_orderstatus"), "┃")
    each = orders.withColumn("_l", F.explode(F.array(
        F.struct(F.lit(0).alias("n"), first.alias("text")), F.struct(F.lit(1).alias("n"), second.alias("text")), F.struct(F.lit(2).alias("n"), F.lit("┠─┼─┼─┼─┨").alias("text")))))
    body = each.select("file_hash", "page_no", (F.col("o_orderkey") * 3 + F.col("_l.n")).alias("line_no"), F.col("_l.text").alias("text"),
                       F.array_repeat(F.col("o_orderstatus") == "F", F.length("_l.text")).alias("flags"))
    head = orders.select("file_hash").distinct().select("file_hash", F.lit(0).alias("page_no"), F.lit(0).cast("long").alias("line_no"), F.lit("┃　権　利　部　（甲　区）┃").alias("text"),
                                                        F.array_repeat(F.lit(False), 13).alias("flags"))
    recs = segment.records(segment.segment_records(body.unionByName(head))).filter(~F.col("heading"))
    cell = lambda i: F.try_element_at("cells", F.lit(i))
    return recs.select("file_hash", "section", "width", cell(1)["text"].alias("rank"), cell(2)["current"].alias("purpose"), cell(2)["struck"].alias("struck"), cell(4)["text"].alias("detail"))


def zoning_pages(spark, sf_dir):
    """A certificate per part; big parts print a second, conflicting zone, so theirs stays empty."""
    part = table(spark, sf_dir, "part")
    text = _text("用途地域  ", F.col("p_type"), "地域\n", F.when(F.col("p_size") > 40, "用途地域  別地域\n").otherwise(""), "建ぺい率  ", F.col("p_size"), "%\n容積率  ", F.col("p_size") * 10,
                 "%\n種別：第", F.col("p_size") % 3 + 1, "種高度地区 最高限度：", F.col("p_size"), "ｍ\n令和", F.col("p_size") % 7 + 1, "年4月1日現在のものです")
    pages = part.select(F.col("p_partkey").cast("string").alias("file_hash"), F.lit(1).alias("page_no"), text.alias("text"))
    fields, status = extract.zoning_extract(pages)
    return fields.select("file_hash", "field_code", "value").unionByName(status.select("file_hash", F.lit("status").alias("field_code"), F.col("status").alias("value")))


TOPICS = {"1-URGENT": "ペット", "2-HIGH": "ピアノ", "3-MEDIUM": "駐車場", "4-NOT SPECIFIED": "議決権", "5-LOW": "模様替"}


def rules_topics(spark, sf_dir):
    """House rules per customer: an article per order on one topic; two articles on a topic give no value."""
    orders = table(spark, sf_dir, "orders")
    topic = F.lit(None).cast("string")
    for priority, word in TOPICS.items():
        topic = F.when(F.col("o_orderpriority") == priority, word).otherwise(topic)
    pages = orders.select(
        F.col("o_custkey").cast("string").alias("file_hash"), F.col("o_orderkey").alias("page_no"), F.lit("text").alias("mode"),
        _text("管理規約\n第", F.col("o_orderkey"), "条 ", topic, "について定める。").alias("text"))
    fields, _, _ = extract.rules_candidates(pages)
    return fields.select("file_hash", "field_code", "candidates", "source_article", "value")


def label_lines(spark, sf_dir):
    """Fee and manager lines per order; some fees are no whole amounts and some lines repeat."""
    orders = table(spark, sf_dir, "orders")
    fee = _text("月額管理費：", F.format_number(F.floor("o_totalprice"), 0), F.when(F.col("o_orderstatus") == "P", "ドル").otherwise("円／月"))
    text = F.concat(fee, F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("\n"), fee)).otherwise(""), _text("\n管理会社 : 会社", F.col("o_custkey"), "\n備考 管理会社：別"))
    pages = orders.select(F.col("o_orderkey").cast("string").alias("file_hash"), F.lit(1).alias("page_no"), text.alias("text"))
    return extract.label_candidates(pages).select("file_hash", "field_code", "value")


def lease_terms(spark, sf_dir):
    """A two-page land ledger per order: the title on one page, the lease on the next."""
    orders = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    title = _text("表題部 宅地 ", F.col("o_orderkey") % 900 + 100, "：25 ")
    right = F.when(F.col("o_orderstatus") == "F", "地上権設定").when(F.col("o_orderstatus") == "O", "賃借権設定").otherwise("所有権移転")
    lease = _text("権利部（甲区） ", right, " 原因昭和", F.year("d") - 1945, "年", F.month("d"), "月", F.day("d"), "日設定 存続期間", F.col("o_custkey") % 50 + 10, "年")
    pages = orders.withColumn("_p", F.explode(F.array(F.struct(F.lit(1).alias("n"), title.alias("t")), F.struct(F.lit(2).alias("n"), lease.alias("t"))))).select(
        F.col("o_orderkey").cast("string").alias("file_hash"), F.col("_p.n").alias("page_no"), F.col("_p.t").alias("text"))
    got = extract.leasehold_terms(pages)
    return got.select("file_hash", "status", "right_type", F.col("area").cast("string").alias("area"), "law_type", F.col("period_start").cast("string").alias("period_start"), F.col("period_years").cast("string").alias("period_years"))


def report_checks(spark, sf_dir):
    """Fee readings of every order checked against a page per order of the customer's report."""
    orders = table(spark, sf_dir, "orders")
    amount = F.format_number(F.floor("o_totalprice"), 0)
    pages = orders.select(F.col("o_orderkey").cast("string").alias("file_hash"), F.explode(F.array(
        F.struct(F.lit(1).alias("page_no"), _text("表紙 ", F.col("o_custkey")).alias("text")), F.struct(F.lit(2).alias("page_no"), _text("管理費 ", amount, "円").alias("text")))).alias("_p")).select(
        "file_hash", "_p.page_no", F.lit("text").alias("mode"), "_p.text")
    confidence = F.when(F.col("o_orderpriority") == "5-LOW", 0.5).otherwise(0.9)
    items = orders.select(F.col("o_orderkey").cast("string").alias("file_hash"), F.lit("management_fee").alias("field_code"), _text(amount, "円").alias("value"),
                          F.when(F.col("o_orderstatus") == "P", "管理費 なし").otherwise(_text("管理費 ", amount, "円")).alias("source_text"),
                          F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderkey") % 9 == 0, 7).otherwise(2).alias("page_no"), confidence.alias("confidence"), F.lit("2026-01").alias("value_as_of_date"))
    catalog = spark.createDataFrame([("management_fee", "number")], "field_code string, data_type string")
    got = normalize.normalize_report(items, pages, catalog)
    return got.select("file_hash", "value", F.coalesce(F.col("page_no").cast("string"), F.lit("")).alias("page_no"), F.array_join("review_reasons", ";").alias("reasons"))


_TOPIC_SQL = " ".join(f"WHEN '{p}' THEN '{w}'" for p, w in TOPICS.items())
_CODE_SQL = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'pet_restrictions' WHEN '2-HIGH' THEN 'instrument_restrictions' WHEN '3-MEDIUM' THEN 'parking_rules' "
             "WHEN '4-NOT SPECIFIED' THEN 'voting_rights_rule' ELSE 'renovation_restrictions' END")
QUERIES = {
    "ruled_ledger": (ruled_ledger, """SELECT CAST(o_custkey AS VARCHAR) AS file_hash, 'A' AS section, 4 AS width, CAST(o_orderkey AS VARCHAR) AS rank,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE replace(o_orderpriority, ' ', '') END AS purpose, o_orderstatus = 'F' AS struck, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || o_orderstatus AS detail FROM orders"""),
    "zoning_pages": (zoning_pages, """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS file_hash, * FROM part)
SELECT file_hash, 'zoning_type' AS field_code, p_type || '地域' AS value FROM p WHERE p_size <= 40 UNION ALL SELECT file_hash, 'building_coverage_ratio', p_size || '%' FROM p
UNION ALL SELECT file_hash, 'floor_area_ratio', (p_size * 10) || '%' FROM p UNION ALL SELECT file_hash, 'height_district', p_size || 'm第' || (p_size % 3 + 1) || '種' FROM p
UNION ALL SELECT file_hash, 'reference_date', (2019 + p_size % 7) || '-04-01' FROM p UNION ALL SELECT file_hash, 'status', CASE WHEN p_size <= 40 THEN 'parsed' ELSE 'needs_review' END FROM p"""),
    "rules_topics": (rules_topics, f"""WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS file_hash, {_CODE_SQL} AS field_code, '第' || o_orderkey || '条' AS article, CASE o_orderpriority {_TOPIC_SQL} END AS w FROM orders)
SELECT file_hash, field_code, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(article) END AS source_article, CASE WHEN count(*) = 1 THEN min(article || ' ' || w || 'について定める。') END AS value FROM r GROUP BY 1, 2"""),
    "label_lines": (label_lines, """SELECT CAST(o_orderkey AS VARCHAR) AS file_hash, 'management_fee' AS field_code, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS value FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'management_company', '会社' || o_custkey FROM orders"""),
    "lease_terms": (lease_terms, """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d FROM orders),
e AS (SELECT *, CASE WHEN month(d) = 2 AND day(d) = 29 THEN CASE WHEN (year(d) - 20) % 4 = 0 THEN strftime(d - INTERVAL 20 YEAR, '%Y-%m-%d') END ELSE strftime(d - INTERVAL 20 YEAR, '%Y-%m-%d') END AS st FROM o)
SELECT CAST(o_orderkey AS VARCHAR) AS file_hash, CASE WHEN s = 'P' THEN 'not_leasehold' WHEN st IS NULL THEN 'needs_review' ELSE 'parsed' END AS status, CASE s WHEN 'F' THEN '地上権' WHEN 'O' THEN '賃借権' END AS right_type,
  CASE WHEN s <> 'P' THEN (o_orderkey % 900 + 100) || '.25' END AS area, CASE WHEN s <> 'P' AND st IS NOT NULL THEN '旧法' END AS law_type, CASE WHEN s <> 'P' THEN st END AS period_start,
  CASE WHEN s <> 'P' THEN CAST(o_custkey % 50 + 10 AS VARCHAR) END AS period_years FROM e"""),
    "report_checks": (report_checks, """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS file_hash, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS value, o_orderpriority = '5-LOW' AS low, o_orderstatus AS s,
  CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderkey % 9 = 0 THEN 7 ELSE 2 END AS p FROM orders)
SELECT file_hash, value, CASE WHEN p = 7 THEN '' WHEN s = 'P' THEN CAST(p AS VARCHAR) ELSE '2' END AS page_no,
  concat_ws(';', CASE WHEN low THEN '読取内容の確認が必要' END, CASE WHEN p = 7 THEN '根拠ページ不明' END, CASE WHEN s = 'P' AND p <> 7 THEN '原文との照合が必要' END, CASE WHEN s = 'P' THEN '数値と原文の照合が必要' END) AS reasons FROM o"""),
}
