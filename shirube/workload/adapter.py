"""The supplied tables seen as an evidence store.

A customer is a unit, a nation its building, an order one dated version of the customer's document
with three readings, and an order's key decides page, quote, document type and approval.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_values(spark: SparkSession, sf_dir: str, deal: Column | None = None) -> DataFrame:
    """EAV readings: three fields per order.

    ``deal``: a key, added as ``_dealt``, by which orders are dealt out before they become three rows each; steps by that key do not
    move them again.
    """
    orders = table(spark, sf_dir, "orders")
    if deal is not None:
        orders = spread(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", deal.alias("_dealt")), "_dealt")
    priority = F.col("o_orderpriority")
    confidence = (F.when(priority == "1-URGENT", 0.99).when(priority == "2-HIGH", 0.95)
                  .when(priority == "3-MEDIUM", 0.90).when(priority == "5-LOW", 0.50))
    kind = (F.when(F.col("o_orderkey") % 3 == 0, "registry").when(F.col("o_orderkey") % 3 == 1, "management_rules")
            .otherwise("important_report"))
    wide = orders.select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"),
        F.to_date("o_orderdate").alias("as_of_date"), kind.alias("document_type"), confidence.alias("confidence"),
        (F.col("o_orderkey") % 7).cast("int").alias("page_no"),
        F.when(F.col("o_orderkey") % 11 == 0, "").otherwise("quote").alias("source_text"),
        F.lit(None).cast("boolean").alias("needs_review"), (F.col("o_orderstatus") == "F").alias("approved"),
        F.col("o_orderstatus").alias("current_owner_name"),
        F.when(priority == "4-NOT SPECIFIED", "null").otherwise(priority).alias("pet_restrictions"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("management_fee"), *([] if deal is None else ["_dealt"]))
    fields = ["current_owner_name", "pet_restrictions", "management_fee"]
    if deal is not None:  # unpivot forgets how its rows are dealt
        rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field_code"), F.col(f).alias("value_json")) for f in fields]))
        return wide.withColumn("_row", rows).select(*[c for c in wide.columns if c not in fields], "_row.*")
    return wide.unpivot([c for c in wide.columns if c not in fields], fields, "field_code", "value_json")


# The same readings for the SQL side.
VALUES_SQL = """
v0 AS (
  SELECT o_custkey AS document_id, o_orderkey AS version_id, CAST(o_orderdate AS DATE) AS as_of_date,
    CASE o_orderkey % 3 WHEN 0 THEN 'registry' WHEN 1 THEN 'management_rules' ELSE 'important_report' END AS document_type,
    CASE o_orderpriority WHEN '1-URGENT' THEN 0.99 WHEN '2-HIGH' THEN 0.95 WHEN '3-MEDIUM' THEN 0.90 WHEN '5-LOW' THEN 0.50 END AS confidence,
    o_orderkey % 7 AS page_no, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'quote' END AS source_text,
    o_orderstatus = 'F' AS approved, o_orderstatus, o_orderpriority, o_totalprice
  FROM orders),
v1 AS (
  SELECT v0.*, 'current_owner_name' AS field_code, o_orderstatus AS value_json FROM v0
  UNION ALL SELECT v0.*, 'pet_restrictions', CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'null' ELSE o_orderpriority END FROM v0
  UNION ALL SELECT v0.*, 'management_fee', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM v0),
v AS (
  SELECT document_id, version_id, as_of_date, document_type, confidence, page_no, source_text, approved, field_code, value_json,
    coalesce(value_json IS NOT NULL AND value_json <> 'null' AND confidence >= 0.85 AND page_no >= 1 AND trim(source_text) <> '', false) AS is_trusted
  FROM v1)
"""
