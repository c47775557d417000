"""Parcels, shares and liens across documents (JN-18..23, AGG-4..6, AGG-9, JN-19, UDF-4)."""
from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import canonical_address

RATIO = T.StructType([T.StructField("n", T.StringType()), T.StructField("d", T.StringType())])


@F.pandas_udf(RATIO)
def _add_ratios(parts: pd.Series) -> pd.DataFrame:
    sums = [sum((Fraction(int(p["n"]), int(p["d"])) for p in row), Fraction(0)) for row in parts]
    return pd.DataFrame({"n": [str(s.numerator) for s in sums], "d": [str(s.denominator) for s in sums]})


def sum_shares(holders: DataFrame, keys: list[str], n: str = "n", d: str = "d", spread: int = 32) -> DataFrame:
    """AGG-5: exact sum of fractions per key, in lowest terms.

    Numerators with one denominator add up natively on the map side. What is left per key is one row
    per distinct denominator, added as fractions first within slices of denominators, then across them.
    """
    like = holders.groupBy(*keys, d).agg(F.sum(F.col(n).cast("decimal(38,0)")).cast("string").alias("n"))
    like = like.select(*keys, "n", F.col(d).cast("string").alias("d"), F.pmod(F.xxhash64(F.col(d).cast("string")), F.lit(spread)).alias("_slice"))
    for level in ([*keys, "_slice"], keys):
        like = like.groupBy(*level).agg(F.collect_list(F.struct("n", "d")).alias("_parts")).withColumn("_sum", _add_ratios("_parts"))
        like = like.select(*level, F.col("_sum.n").alias("n"), F.col("_sum.d").alias("d"))
    return like.withColumn("is_whole", (F.col("n") == "1") & (F.col("d") == "1"))


def printed_share(n: Column, d: Column, printed_d: Column) -> Column:
    """AGG-5: keep the printed denominator where the sum allows it (200/10000, not 1/50)."""
    big = lambda c: c.try_cast("decimal(38,0)")
    fits = F.coalesce(big(printed_d) % big(d) == 0, F.lit(False))
    scaled = F.try_multiply(big(n), F.when(fits, F.try_divide(big(printed_d), big(d))).try_cast("decimal(38,0)")).try_cast("decimal(38,0)")
    # sums of many denominators outgrow any decimal; they stay as the exact text they are
    return F.when(scaled.isNotNull(), F.concat(big(printed_d).cast("string"), F.lit("分の"), scaled.cast("string"))).otherwise(
        F.concat(d.cast("string"), F.lit("分の"), n.cast("string")))


def merge_holders(lots: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-6: one holder per folded name and address; shares add up, doubt is kept."""
    from ..functions.text import nfkc_compact
    folded = (lots.withColumn("name_key", nfkc_compact(F.coalesce("name", F.lit(""))))
              .withColumn("address_key", nfkc_compact(F.coalesce("address", F.lit("")))))
    by = [*keys, "name_key", "address_key"]
    total = sum_shares(folded.filter("n is not null"), by)
    rest = folded.groupBy(*by).agg(F.min("name").alias("name"), F.min("address").alias("address"), F.count(F.lit(1)).alias("lots"),
                                   F.bool_or(F.coalesce("doubt", F.lit(False)) | F.col("n").isNull()).alias("doubt"),
                                   F.bool_or(F.col("n").isNull()).alias("_open"))
    return (rest.join(total.drop("is_whole"), by, "left")
            .withColumn("n", F.when(~F.col("_open"), F.col("n"))).withColumn("d", F.when(~F.col("_open"), F.col("d"))).drop("_open"))


def common_share(lands: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-4: the one share all parcels have; a missing, doubtful or second share gives null."""
    ok = F.col("n").isNotNull() & F.col("d").isNotNull() & ~F.coalesce("needs_review", F.lit(False))
    one = lands.groupBy(*keys).agg(F.bool_and(ok).alias("_ok"), F.count_distinct(F.struct("n", "d")).alias("_n"),
                                   F.min("n").alias("_share_n"), F.min("d").alias("_share_d"))
    same = F.col("_ok") & (F.col("_n") == 1)
    return one.select(*keys, F.when(same, F.col("_share_n")).alias("n"), F.when(same, F.col("_share_d")).alias("d"))


def integrate_outer(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str],
                    fold=canonical_address) -> DataFrame:
    """JN-18 / AGG-9: full outer join on unique keys; nulls are filled, differing values flagged."""
    l = left.select(*keys, *[F.col(f).alias(f"_l_{f}") for f in fields], F.lit(True).alias("_l"))
    r = right.select(*keys, *[F.col(f).alias(f"_r_{f}") for f in fields], F.lit(True).alias("_r"))
    joined = l.join(r, keys, "full_outer")
    clash = [F.when(F.col(f"_l_{f}").isNotNull() & F.col(f"_r_{f}").isNotNull() & (fold(F.col(f"_l_{f}")) != fold(F.col(f"_r_{f}"))), F.lit(f)) for f in fields]
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return joined.select(*keys, side.alias("side"),
                         *[F.coalesce(F.col(f"_l_{f}"), F.col(f"_r_{f}")).alias(f) for f in fields],
                         F.array_compact(F.array(*clash)).alias("mismatches"))


def changed_values(before: DataFrame, after: DataFrame, keys: list[str], fold=canonical_address) -> DataFrame:
    """AGG-9: readings that were there and changed, and parcels that were dropped.

    Shares compare as fractions; formatting differences and newly filled values do not count.
    """
    from ..functions.shares import parse_share
    b = before.select(*keys, "path", F.col("value").alias("before"))
    a = after.select(*keys, "path", F.col("value").alias("after"), F.lit(True).alias("_after"))
    joined = b.join(a, [*keys, "path"], "left").filter("before is not null")
    same_share = F.contains(F.col("path"), F.lit("share")) & F.coalesce(
        (parse_share(F.col("before"))["n"] * parse_share(F.col("after"))["d"]) == (parse_share(F.col("after"))["n"] * parse_share(F.col("before"))["d"]), F.lit(False))
    differs = F.col("after").isNotNull() & (fold(F.col("before")) != fold(F.col("after"))) & ~same_share
    dropped = F.col("_after").isNull() & F.col("path").startswith("lands.")
    return joined.filter(differs | dropped).select(*keys, "path", "before", "after")


def site_lots(buildings: DataFrame, keys: list[str], location: str = "location_text") -> DataFrame:
    """JN-19: every lot a building's location lists, as place prefix plus lot; none listed gives the text itself."""
    folded = buildings.select(*keys, canonical_address(F.col(location)).alias("_text"))
    folded = folded.withColumn("_prefix", F.regexp_extract("_text", r"^(.*?)\d+番\d+", 1))
    tokens = F.regexp_extract_all(F.col("_text"), F.lit(r"(\d+番\d+(?:の\d+)?)"), 1)
    lots = F.when(F.size(tokens) > 0, F.transform(tokens, lambda t: F.concat(F.col("_prefix"), t))).otherwise(F.array("_text"))
    return folded.select(*keys, F.explode(F.array_distinct(lots)).alias("site_lot"))


def outside_site(parcels: DataFrame, buildings: DataFrame, keys: list[str]) -> DataFrame:
    """JN-19: parcels of a group that its building's location does not list. Kept and marked, never a block."""
    lots = site_lots(buildings, keys).withColumn("_listed", F.lit(True))
    keyed = parcels.withColumn("site_lot", F.concat(canonical_address(F.col("location")), canonical_address(F.col("lot_number"))))
    return keyed.join(lots, [*keys, "site_lot"], "left").withColumn("outside", F.col("_listed").isNull()).drop("_listed", "site_lot")


def seller_shares(parcels: DataFrame, owners: DataFrame, sellers: DataFrame, group: list[str]) -> DataFrame:
    """JN-20: a parcel's share is the sum over the sellers when each of them is exactly one owner.

    ``parcels``: group, parcel_id, outside, land_right_exists; ``owners``: group, parcel_id, name, n, d,
    printed_d, share_text, needs_review; ``sellers``: group, name. Names are folded by the caller.
    """
    wanted = sellers.groupBy(*group).agg(F.count(F.lit(1)).alias("_sellers"))
    by_name = owners.groupBy(*group, "parcel_id", "name").agg(
        F.count(F.lit(1)).alias("_same"), F.min("n").alias("n"), F.min("d").alias("d"), F.min("printed_d").alias("printed_d"),
        F.min("share_text").alias("share_text"), F.bool_or(F.coalesce("needs_review", F.lit(False))).alias("_doubt"))
    counts = owners.groupBy(*group, "parcel_id").agg(F.count(F.lit(1)).alias("_owners"))
    hits = by_name.filter("_same = 1").join(sellers, [*group, "name"]).join(counts, [*group, "parcel_id"])
    whole = F.col("n").isNull() & F.col("share_text").isNull() & (F.col("_owners") == 1)
    hits = (hits.withColumn("_whole", whole).withColumn("n", F.when(F.col("_whole"), F.lit(1)).otherwise(F.col("n")))
            .withColumn("d", F.when(F.col("_whole"), F.lit(1)).otherwise(F.col("d"))).drop("_whole"))
    found = hits.groupBy(*group, "parcel_id").agg(
        F.count(F.lit(1)).alias("_found"), F.bool_and(F.col("n").isNotNull()).alias("_readable"),
        F.bool_or("_doubt").alias("_doubt"), F.min("printed_d").alias("_printed"), F.min("share_text").alias("_text"))
    total = sum_shares(hits.filter("n is not null"), [*group, "parcel_id"])
    joined = (parcels.join(wanted, group, "left").join(counts, [*group, "parcel_id"], "left")
              .join(found, [*group, "parcel_id"], "left").join(total, [*group, "parcel_id"], "left"))
    relevant = F.coalesce("outside", F.lit(False)) | F.coalesce(F.col("land_right_exists") == F.lit(False), F.lit(False))
    n_found = F.coalesce("_found", F.lit(0))
    all_found = (F.coalesce("_sellers", F.lit(0)) > 0) & (n_found == F.col("_sellers"))
    settled = relevant & all_found & F.coalesce("_readable", F.lit(False))
    share = F.when(settled & ~F.col("is_whole"), F.when(n_found == 1, F.col("_text")).otherwise(
        printed_share(F.col("n"), F.col("d"), F.col("_printed"))))
    outside = F.coalesce("outside", F.lit(False))
    notes = F.array_compact(F.array(
        F.when(settled & (n_found > 1), "co-owned: seller shares added"),
        F.when(settled & F.col("_doubt"), "share computed from the ledger"),
        F.when(settled & outside, "parcel outside the site included"),
        F.when(relevant & all_found & ~settled, "share unreadable"),
        F.when(relevant & ~all_found & outside & (n_found == 0), "parcel outside the site, seller is no owner"),
        F.when(relevant & ~all_found & ~(outside & (n_found == 0)) & (F.coalesce("_owners", F.lit(0)) > 0), "seller not among the owners")))
    return joined.select(*parcels.columns, F.when(settled, "所有権").alias("right_type"), share.alias("right_share"), notes.alias("warnings"))


def symbol_rights(rights: DataFrame, parcels: DataFrame, keys: list[str]) -> DataFrame:
    """JN-21: a right row lists parcel symbols; the last row naming a symbol counts."""
    rows = rights.withColumn("symbol", F.explode(F.split("symbols", "[・、]")))
    last = rows.groupBy(*keys, "symbol").agg(F.max_by(F.struct("right_type", "right_share"), "ord").alias("_r"))
    return (parcels.join(last, [*keys, "symbol"], "left").withColumn("right_type", F.col("_r.right_type"))
            .withColumn("right_share", F.col("_r.right_share")).drop("_r"))


CANCELS = r"^([\d、・及び番]+)番(?:(?:根)?抵当権|仮登記)抹消$"


def cancel_entries(entries: DataFrame, keys: list[str]) -> DataFrame:
    """JN-22: ranks that a cancellation purpose lists, with the last such entry."""
    listed = F.regexp_extract_all(F.regexp_extract("purpose", CANCELS, 1), F.lit(r"(\d+)"), 1)
    return (entries.filter(F.col("purpose").rlike(CANCELS)).select(*keys, F.explode(listed).alias("rank"), "ord")
            .groupBy(*keys, "rank").agg(F.max("ord").alias("cancelled_by")))


AMOUNT = r"(?:債権額|極度額)(金.*?円)"


def mortgage_state(entries: DataFrame, keys: list[str]) -> DataFrame:
    """JN-22, JN-23 and the plain-text policy of JOB-3, one row per lien entry.

    ``entries``: keys, ord, rank, purpose, body (folded). A plain rank listed by a cancellation is
    inactive; a transfer or change addressed to it, or a nested rank, leaves the state unknown.
    """
    simple = F.col("rank").rlike(r"^\d+$")
    liens = entries.filter(F.contains(F.col("purpose"), F.lit("抵当権設定")))
    cancelled = cancel_entries(entries, keys)
    addressed = entries.withColumn("_to", F.regexp_extract("purpose", r"^(\d+)番", 1)).filter("_to <> ''")
    touched = (addressed.filter(F.col("purpose").rlike("変更|移転|更正|一部抹消")).groupBy(*keys, F.col("_to").alias("rank"))
               .agg(F.lit(True).alias("_touched")))
    # A change names its rank as printed: "1番", or "1番(あ)" for a nested one.
    target = F.regexp_replace("rank", r"^(\d+)", "$1番")
    amended = (entries.filter(F.contains(F.col("purpose"), F.lit("変更")))
               .withColumn("_amount", F.nullif(F.regexp_extract("body", AMOUNT, 1), F.lit("")))
               .withColumn("_target", F.regexp_extract("purpose", r"^(\d+番(?:[^番変抵根]*?))(?=(?:根)?抵当権|変更)", 1))
               .filter("_amount is not null and _target <> ''")
               .groupBy(*keys, "_target").agg(F.max_by("_amount", "ord").alias("_amended")))
    joined = (liens.withColumn("_target", target).join(cancelled, [*keys, "rank"], "left")
              .join(touched, [*keys, "rank"], "left").join(amended, [*keys, "_target"], "left"))
    hit = simple & F.col("cancelled_by").isNotNull()
    ambiguous = ~simple | F.coalesce("_touched", F.lit(False))
    body = F.col("body")
    part = lambda p: F.nullif(F.regexp_extract(body, p, 1), F.lit(""))
    return joined.select(
        *keys, "ord", "rank", F.col("purpose").alias("kind"), F.coalesce(F.col("_amended"), part(AMOUNT)).alias("amount"),
        part(r"債務者(.+?)(?=(?:根)?抵当権者)").alias("debtor"),
        part(r"(?:根)?抵当権者(.+?)(?=共同担保|順位|$)").alias("creditor"),
        F.when(hit, False).when(~ambiguous, True).alias("active"),
        F.when(hit, F.col("cancelled_by")).alias("cancelled_by"), (ambiguous & ~hit).alias("needs_review"))
