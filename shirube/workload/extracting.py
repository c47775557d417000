"""Scalar parsing, ledgers and field completion over the numeric tables."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import dates, evidence, shares, text
from ..plans import ledger
from .adapter import table


def share_parse(spark, sf_dir):
    """Shares printed with groups of ten thousand, parsed back to exact pairs."""
    line = table(spark, sf_dir, "lineitem")
    printed = F.concat(F.col("l_linenumber"), F.lit("万"), F.col("l_suppkey"), F.lit("分の"), F.format_number(F.col("l_partkey"), 0))
    pair = shares.parse_share(printed)
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pair["n"].cast("string").alias("n"), pair["d"].cast("string").alias("d"))


def era_dates(spark, sf_dir):
    """Order dates printed as era dates and read back strictly, and their era parts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    printed = orders.withColumn("printed", F.when(F.col("o_orderkey") % 10 == 0, F.replace(dates.era_text(F.col("day")), F.lit("平成"), F.lit("昭和"))).otherwise(dates.era_text(F.col("day"))))
    return printed.select("o_orderkey", "printed", dates.era_to_date(F.col("printed")).cast("string").alias("strict"),
                          dates.era_to_date(F.col("printed"), strict=False).cast("string").alias("lenient"))


def lease_ends(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("start"), F.col("l_quantity").cast("int").alias("years"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", dates.lease_end(F.col("start"), F.col("years")).cast("string").alias("lease_end"))


def number_checks(spark, sf_dir):
    """Amounts with separators and units read back and found in their quotes."""
    orders = table(spark, sf_dir, "orders")
    amount = F.format_number(F.floor("o_totalprice"), 0)
    quote = F.concat(F.lit("fee "), F.when(F.col("o_orderpriority") == "5-LOW", F.format_number(F.floor("o_totalprice") + 1, 0)).otherwise(amount), F.lit(" yen"))
    value = text.to_number(F.concat(amount, F.when(F.col("o_orderstatus") == "P", " pts").otherwise("円")))
    return orders.select("o_orderkey", evidence.canonical_number(value).alias("value"), F.coalesce(evidence.number_in_quote(value, quote), F.lit(False)).alias("in_quote"))


def ledger_fold(spark, sf_dir):
    """Ownership ledgers drawn from the events: each user's sign-ups take the whole, purchases take a printed part of it.

    The whole holder's remaining share is checked against plain arithmetic. A user without a sign-up has no known giver: the
    takers keep their printed shares, and the file is uncertain. Every file also has its row of certainty.
    """
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "purchase"))
    whole = F.col("event_type") == "signup"
    name = F.concat(F.lit("甲野"), F.col("event_id").cast("string"), F.lit("組合"))
    line = lambda t: F.struct(F.lit(1).alias("page"), t.alias("text"), t.alias("raw"))
    people = F.when(whole, F.array(line(F.lit("所有者港区")), line(name))).otherwise(
        F.array(line(F.lit("共有者港区")), line(F.concat(F.lit("持分1000分の"), (F.floor(F.col("value")) % 9 + 1).cast("string"))), line(name)))
    base = events.filter(whole).groupBy("user_id").agg(F.max("event_id").alias("_base"))
    entries = events.join(base, "user_id", "left").filter(F.col("_base").isNull() | (F.col("event_id") >= F.col("_base"))).select(
        F.col("user_id").cast("string").alias("file_hash"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("rank"),
        F.when(whole, "所有権移転").otherwise(F.concat(F.lit("甲野"), F.coalesce("_base", F.lit(-1)).cast("string"), F.lit("組合持分一部移転"))).alias("purpose"),
        F.lit(False).alias("struck"), people.alias("lines"))
    lots = ledger.current_lots(entries)
    return lots.select(F.col("file_hash").cast("long").alias("user_id"), F.coalesce(F.regexp_extract("name", r"(\d+)", 1).cast("long"), F.lit(-1)).alias("event_id"), "n", "d", "uncertain")


def ownership_splits(spark, sf_dir):
    """JOB-2: one ledger for all events: its first entry takes the whole, purchases take printed parts of it, refunds or errors all of a purchaser's.

    Holders in force with their shares, whether they need a look, and whether the ledger adds up.
    """
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    buys = F.col("event_type") == "purchase"
    earlier = F.last(F.when(buys, F.col("event_id")), ignorenulls=True)  # of one user; the whole ledger is never one window
    giver = earlier.over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("giver", giver).filter(buys | F.col("giver").isNotNull())
    line = lambda t: F.struct(F.lit(1).alias("page"), t.alias("text"), t.alias("raw"))
    name = F.concat(F.lit("甲野"), F.col("event_id").cast("string"), F.lit("組合"))
    people = F.array(line(F.lit("共有者港区")), line(F.concat(F.lit("持分10000000分の"), (F.col("event_id") % 9 + 1).cast("string"))), line(name))
    purpose = F.when(buys, "甲野組合持分一部移転").otherwise(F.concat(F.lit("甲野"), F.col("giver").cast("string"), F.lit("組合持分全部移転")))
    rows = rows.select(F.lit("ledger").alias("file_hash"), (F.col("event_id") + 1).alias("ord"), F.col("event_id").cast("string").alias("rank"), purpose.alias("purpose"), F.lit(False).alias("struck"), people.alias("lines"))
    first = rows.select("file_hash").distinct().select("file_hash", F.lit(-1).cast("long").alias("ord"), F.lit("0").alias("rank"), F.lit("所有権移転").alias("purpose"), F.lit(False).alias("struck"),
                                                           F.array(line(F.lit("所有者港区")), line(F.lit("甲野組合"))).alias("lines"))
    holders, reviews, _ = ledger.ownership_replay(rows.unionByName(first))
    kept = holders.select(F.coalesce(F.regexp_extract("name", r"(\d+)", 1).try_cast("long"), F.lit(-1)).alias("holder"), "share", "needs_review")
    return kept.unionByName(reviews.filter("path = 'owners'").select(F.lit(-2).cast("long").alias("holder"), F.col("path").alias("share"), F.lit(True).alias("needs_review")))


QUERIES = {
    "ownership_splits": (ownership_splits, """WITH e AS (
  SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS giver
  FROM events WHERE event_type IN ('purchase', 'error')),
m AS (SELECT * FROM e WHERE event_type = 'purchase' OR giver IS NOT NULL),
g AS (SELECT giver, min(event_id) AS first_at, count(*) AS times FROM m WHERE event_type = 'error' GROUP BY 1),
l AS (SELECT event_id, event_id % 9 + 1 AS k FROM m WHERE event_id NOT IN (SELECT giver FROM g)),
r AS (SELECT 10000000 - coalesce(sum(event_id % 9 + 1), 0) AS k FROM m WHERE event_type = 'purchase')
SELECT event_id AS holder, '10000000分の' || k AS share, false AS needs_review FROM l
UNION ALL SELECT -1, CAST(CAST(10000000 AS BIGINT) // gcd(CAST(k AS BIGINT), 10000000) AS VARCHAR) || '分の' || CAST(CAST(k AS BIGINT) // gcd(CAST(k AS BIGINT), 10000000) AS VARCHAR), true FROM r
UNION ALL SELECT -2, 'owners', true WHERE EXISTS (SELECT 1 FROM g WHERE times > 1) OR (SELECT sum(k) FROM l) + (SELECT k FROM r) <> 10000000"""),
    "share_parse": (share_parse, """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey > 0 AND l_partkey <= l_linenumber * 10000 + l_suppkey THEN CAST(l_partkey AS VARCHAR) END AS n,
  CASE WHEN l_partkey > 0 AND l_partkey <= l_linenumber * 10000 + l_suppkey THEN CAST(l_linenumber * 10000 + l_suppkey AS VARCHAR) END AS d FROM lineitem"""),
    "era_dates": (era_dates, """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 10 = 0 THEN '昭和' ELSE '平成' END AS era FROM orders)
SELECT o_orderkey, era || (year(d) - 1988) || '年' || month(d) || '月' || day(d) || '日' AS printed, CASE WHEN era = '平成' THEN CAST(d AS VARCHAR) WHEN d - INTERVAL 63 YEAR >= DATE '1926-12-25' AND NOT (month(d) = 2 AND day(d) = 29) THEN strftime(d - INTERVAL 63 YEAR, '%Y-%m-%d') END AS strict,
  CASE WHEN era = '平成' THEN CAST(d AS VARCHAR) WHEN NOT (month(d) = 2 AND day(d) = 29) THEN strftime(d - INTERVAL 63 YEAR, '%Y-%m-%d') END AS lenient FROM o"""),
    "lease_ends": (lease_ends, """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(CAST(l_shipdate AS DATE) + to_months(12 * CAST(l_quantity AS INT)) AS DATE) - 1 AS VARCHAR) AS lease_end FROM lineitem"""),
    "number_checks": (number_checks, """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS value, o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AS in_quote FROM orders"""),
    "ledger_fold": (ledger_fold, """WITH b AS (SELECT user_id, max(event_id) AS base FROM events WHERE event_type = 'signup' GROUP BY 1),
p AS (SELECT e.user_id, e.event_id, CAST(floor(value) AS BIGINT) % 9 + 1 AS k FROM events e JOIN b ON e.user_id = b.user_id AND e.event_id > b.base WHERE event_type = 'purchase'),
o AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 9 + 1 AS k FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM b)),
l AS (SELECT user_id, event_id, k, false AS uncertain FROM p UNION ALL SELECT b.user_id, base, 1000 - coalesce((SELECT sum(k) FROM p WHERE p.user_id = b.user_id), 0), false FROM b UNION ALL SELECT user_id, event_id, k, true FROM o)
SELECT user_id, event_id, CAST(CAST(k AS BIGINT) // gcd(CAST(k AS BIGINT), 1000) AS VARCHAR) AS n, CAST(1000 // gcd(CAST(k AS BIGINT), 1000) AS VARCHAR) AS d, uncertain FROM l WHERE k <> 0
UNION ALL SELECT DISTINCT user_id, -1, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), uncertain FROM l"""),
}
