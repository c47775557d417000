"""JOB-8..11: type checks, evidence checks and human overlays on extracted items.

Items are rows: file_hash, field_code, value, source_text, page_no, confidence, value_as_of_date, ...
Every doubt adds a reason; nothing is guessed away.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import DISCLOSURE_NUMBERS
from ..functions.dates import iso_date
from ..functions.evidence import TRUST_LEVEL, canonical_number, clean_confidence, number_in_quote
from ..functions.text import NUMBER_UNITS, nfkc, nfkc_compact, to_number
from ..operators.aggregates import complete_fields, dedupe_fields
from ..operators.ordered import newest
from ..operators.quotes import check_quotes, correct_pages, page_forms
from ..session import cut_lineage

# ---- fixed values: review reasons --------------------------------------------------------------------
R_NUMBER, R_DATE, R_ASOF = "数値・月額の確認が必要", "年月日の確認が必要", "基準日の確認が必要"
R_READING, R_PAGE, R_QUOTE = "読取内容の確認が必要", "根拠ページ不明", "根拠テキスト不明"
R_SCAN, R_MATCH, R_NUMBER_MATCH = "画像の原文確認が必要", "原文との照合が必要", "数値と原文の照合が必要"
R_MISSING, R_TWICE, R_FORM, R_SHARE = "未取得", "候補が複数あります", "値の形式を確認してください", "土地持分を確認してください"
LOTS_JSON = "array<struct<location:string,lot_number:string,land_category:string,area:string,right_type:string,numerator:string,denominator:string>>"
LIENS_JSON = "array<map<string,string>>"
# -------------------------------------------------------------------------------------------------------


def _with_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Mode of the named page and the page count of the file."""
    count = pages.groupBy("file_hash").agg(F.max("page_no").alias("_pages"))
    mode = pages.select("file_hash", "page_no", F.col("mode").alias("_mode"))
    return items.join(count, "file_hash", "left").join(mode, ["file_hash", "page_no"], "left")


def _page_ok(strict: bool) -> Column:
    inside = F.col("page_no") <= F.col("_pages") if strict else F.col("_pages").isNull() | (F.col("page_no") <= F.col("_pages"))
    return F.coalesce((F.col("page_no") >= 1) & inside, F.lit(False))


def _folded_pages(pages: DataFrame) -> DataFrame:
    return pages.filter("mode = 'text'").select("file_hash", "page_no", nfkc_compact(F.coalesce("text", F.lit(""))).alias("folded"))


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in pairs]))


def _quote_key() -> Column:
    """One struct, so that the join back is an equality that null fields do not break."""
    return F.struct(F.col("file_hash").alias("file_hash"), F.col("page_no").cast("int").alias("page_no"), F.col("folded").alias("folded"))


def _asked_quotes(staged: DataFrame) -> DataFrame:
    """Each quote to look for once, however many items bear it, so that every item stays one row."""
    return staged.filter("_quote is not null").select("_quote").distinct().select("_quote.*")


def normalize_report(items: DataFrame, pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """JOB-8: report values typed and checked against their pages; as-of dates are per field, never filled in.

    A quote that stands on exactly one other text page corrects the page. ``review_reasons`` an item
    already carries are kept. ``catalog``: field_code, data_type; a small list of fixed size. Items and pages are folded and written once.
    """
    typed = items.join(F.broadcast(catalog.select("field_code", "data_type")), "field_code")  # a fixed list; items of one code would else meet it in a product that works them out again for each of its partitions
    text = F.nullif(F.trim(nfkc(F.col("value"))), F.lit(""))
    is_number, is_date = F.col("data_type") == "number", F.col("data_type") == "date"
    typed = (typed.withColumn("_text", text).withColumn("_number", F.when(is_number, to_number(F.col("_text"), folded=True)))
             .withColumn("_date", F.when(is_date, iso_date(F.col("_text")))))
    value = F.when(is_number & F.col("_number").isNotNull(), canonical_number(F.col("_number"))).when(is_date, F.col("_date").cast("string")).otherwise(F.col("_text"))
    asof = F.col("value_as_of_date")
    staged = (typed.withColumn("_value", value).withColumn("_asof", iso_date(asof)).withColumn("confidence", clean_confidence(F.col("confidence")))
              .withColumn("_asof_bad", (F.coalesce(asof, F.lit("")) != "") & F.col("_asof").isNull() & ~F.coalesce(asof.rlike(r"^\d{4}-(?:0[1-9]|1[0-2])$"), F.lit(False)))
              .withColumn("_early", _reasons((is_number & F.col("_text").isNotNull() & F.col("_number").isNull(), R_NUMBER),
                                             (is_date & F.col("_text").isNotNull() & F.col("_date").isNull(), R_DATE), (F.col("_asof_bad"), R_ASOF))))
    staged = _with_pages(staged, pages).withColumn("_page_ok", _page_ok(False)).withColumn("folded", nfkc_compact(F.coalesce("source_text", F.lit(""))))
    asked = (F.col("_mode") == "text") & (F.col("folded") != "") & F.col("_page_ok")
    staged = cut_lineage(staged.withColumn("_quote", F.when(asked, _quote_key())))  # folded once, as the quotes are asked for and come back to it
    placed = correct_pages(_asked_quotes(staged), cut_lineage(_folded_pages(pages)), ["file_hash"]).select(_quote_key().alias("_quote"), "corrected_page", F.col("needs_review").alias("_nowhere"))
    joined = staged.join(placed, "_quote", "left")
    has_value, has_quote = F.col("_value").isNotNull(), F.coalesce("source_text", F.lit("")) != ""
    quoted = number_in_quote(F.col("_number"), F.col("folded"), folded=True)
    late = _reasons((F.col("confidence").isNull() | (F.col("confidence") < TRUST_LEVEL), R_READING), (~F.col("_page_ok"), R_PAGE), (~has_quote, R_QUOTE),
                    (has_quote & F.col("_page_ok") & (F.col("_mode") == "scan"), R_SCAN), (F.col("_nowhere"), R_MATCH),
                    (F.col("_number").isNotNull() & has_quote & ~quoted, R_NUMBER_MATCH))
    prior = F.coalesce(F.col("review_reasons"), F.array().cast("array<string>")) if "review_reasons" in items.columns else F.array().cast("array<string>")
    reasons = F.concat(F.col("_early"), F.when(has_value, late).otherwise(F.array().cast("array<string>")), prior)
    page = F.when(has_value & ~F.col("_page_ok"), F.lit(None).cast("int")).otherwise(F.coalesce("corrected_page", "page_no"))
    return joined.select("file_hash", "field_code", F.col("_value").alias("value"), "source_text", page.alias("page_no"), "confidence",
                         F.col("_asof").alias("value_as_of_date"), reasons.alias("review_reasons"), (F.size(reasons) > 0).alias("needs_review"))


def normalize_rules(items: DataFrame, pages: DataFrame, topics: tuple[str, ...] = ()) -> DataFrame:
    """JOB-9, rules: a quote must stand on its page, a scanned page needs a look, reasons are sorted. Every item stays one row.

    ``topics``: codes that every file with pages has to show; one without an item gets a row that says so.
    """
    staged = _with_pages(items, pages).withColumn("_page_ok", _page_ok(False)).withColumn("folded", nfkc_compact(F.coalesce("source_text", F.lit(""))))
    staged = staged.withColumn("_quote", F.when(F.col("folded") != "", _quote_key()))
    checked = check_quotes(_asked_quotes(staged), pages.select("file_hash", "page_no", nfkc_compact(F.coalesce("text", F.lit(""))).alias("folded")), ["file_hash"])
    joined = staged.join(checked.select(_quote_key().alias("_quote"), "on_page"), "_quote", "left").withColumn("confidence", clean_confidence(F.col("confidence")))
    has_quote = F.col("folded") != ""
    found = _reasons((F.col("value").isNull(), R_MISSING), (F.col("confidence").isNull() | (F.col("confidence") < TRUST_LEVEL), R_READING), (~F.col("_page_ok"), R_PAGE),
                     (~has_quote, R_QUOTE), (has_quote & F.col("_page_ok") & (F.col("_mode") == "scan"), R_SCAN),
                     (has_quote & F.col("_page_ok") & (F.col("_mode") != "scan") & ~F.coalesce("on_page", F.lit(False)), R_MATCH))
    prior = F.coalesce(F.col("review_reasons"), F.array().cast("array<string>")) if "review_reasons" in items.columns else F.array().cast("array<string>")
    flagged = F.coalesce(F.col("needs_review"), F.lit(False)) if "needs_review" in items.columns else F.lit(False)
    reasons = F.array_sort(F.array_distinct(F.concat(prior, found)))
    done = joined.select("file_hash", "field_code", "value", F.when(has_quote, F.col("source_text")).alias("source_text"), F.when(F.col("_page_ok"), F.col("page_no")).alias("page_no"),
                         "confidence", reasons.alias("review_reasons"), ((F.size(reasons) > 0) | flagged).alias("needs_review"))
    if not topics:
        return done
    asked = pages.select("file_hash").distinct().withColumn("field_code", F.explode(F.array(*[F.lit(t) for t in topics])))
    absent = asked.join(done.select("file_hash", "field_code").distinct(), ["file_hash", "field_code"], "left_anti")
    blank = [F.lit(None).cast(done.schema[c].dataType).alias(c) for c in ("value", "source_text", "page_no", "confidence")]
    return done.unionByName(absent.select("file_hash", "field_code", *blank, F.array(F.lit(R_MISSING)).alias("review_reasons"), F.lit(True).alias("needs_review")))


def normalize_disclosure(items: DataFrame, pages: DataFrame, documents: DataFrame, codes: list[str]) -> DataFrame:
    """JOB-9, disclosures: duplicates give no value, parcels and liens are typed JSON, missing codes are listed."""
    known = items.filter(F.col("field_code").isin(*codes))
    single = dedupe_fields(known, ["file_hash", "field_code"])
    extra = known.groupBy("file_hash", "field_code").agg(F.first("value_as_of_date", ignorenulls=True).alias("_asof"))
    staged = single.join(extra, ["file_hash", "field_code"])
    code, raw = F.col("field_code"), F.col("value")
    number = to_number(raw, NUMBER_UNITS["disclosure"])
    lots = F.from_json(raw, LOTS_JSON)
    staged = staged.withColumn("_lots", F.when(code == "land_lots", lots)).withColumn("_liens", F.when(code == "active_mortgages", F.from_json(raw, LIENS_JSON)))
    staged = staged.withColumn("_number", F.when(code.isin(*DISCLOSURE_NUMBERS), number))
    cell_ok = lambda v: v.isNull() | F.regexp_replace(F.regexp_replace(v, "[,\\s]", ""), "(?:㎡|m2)$", "").rlike(r"^\d+(?:\.\d+)?$")
    lots_ok = F.col("_lots").isNotNull() & F.forall("_lots", lambda l: l.isNotNull() & cell_ok(l["area"]) & cell_ok(l["numerator"]) & cell_ok(l["denominator"]))
    share_bad = F.exists("_lots", lambda l: l["numerator"].isNotNull() & l["denominator"].isNotNull() & ~F.coalesce(
        (l["numerator"].try_cast("decimal(38,4)") > 0) & (l["numerator"].try_cast("decimal(38,4)") <= l["denominator"].try_cast("decimal(38,4)")), F.lit(False)))
    dated = code.isin("built_date", "handover_date")
    value = (F.when(code.isin(*DISCLOSURE_NUMBERS), canonical_number(F.col("_number"))).when(code == "has_land_right", F.when(raw.isin("true", "false"), raw))
             .when(code == "land_lots", F.when(lots_ok, raw)).when(code == "active_mortgages", F.when(F.col("_liens").isNotNull(), raw))
             .when(dated, iso_date(raw).cast("string")).otherwise(raw))
    staged = staged.withColumn("_value", value).withColumn("confidence", clean_confidence(F.col("confidence")))
    placed = _with_pages(staged, pages).withColumn("_page_ok", _page_ok(True)).withColumn("folded", nfkc_compact(F.coalesce("source_text", F.lit(""))))
    checked = check_quotes(placed.filter("folded <> ''").select("file_hash", "field_code", "page_no", "folded"), _folded_pages(pages), ["file_hash"])
    joined = placed.join(checked.select("file_hash", "field_code", "on_page"), ["file_hash", "field_code"], "left")
    has_quote, twice = F.col("folded") != "", F.col("is_duplicate")
    found = _reasons((raw.isNotNull() & F.col("_value").isNull(), R_FORM), (F.coalesce(share_bad, F.lit(False)), R_SHARE),
                     (F.col("confidence").isNull() | (F.col("confidence") < TRUST_LEVEL), R_READING), (~F.col("_page_ok"), R_PAGE), (~has_quote, R_QUOTE),
                     (has_quote & F.col("_page_ok") & (F.col("_mode") == "text") & ~F.coalesce("on_page", F.lit(False)), R_MATCH),
                     (F.col("_page_ok") & (F.col("_mode") == "scan"), R_SCAN))
    reasons = F.when(twice, F.array(F.lit(R_TWICE))).otherwise(found)
    done = joined.select("file_hash", "field_code", "_value", "source_text", F.when(F.col("_page_ok"), F.col("page_no")).alias("page_no"), "confidence",
                         iso_date(F.col("_asof")).alias("value_as_of_date"), reasons.alias("_reasons"))
    full = complete_fields(done, documents, codes, "file_hash")
    final = F.when(F.col("obtained"), F.col("_reasons")).otherwise(F.array(F.lit(R_MISSING)))
    return full.select("file_hash", "field_code", F.col("_value").alias("value"), "source_text", "page_no", "confidence", "value_as_of_date",
                       final.alias("review_reasons"), ((F.size(final) > 0) | F.col("_value").isNull()).alias("needs_review"))


def apply_overlay(items: DataFrame, overlays: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOB-10: (items, rejects). The newest complete human check replaces a reading; the reading's confidence is kept.

    ``overlays``: file_hash, field_code, value, page_no, source_text, verified, verified_at. An overlay needs
    its verified flag and time, a page of the file and a quote.
    """
    count = pages.groupBy("file_hash").agg(F.max("page_no").alias("_pages"))
    joined = overlays.join(count, "file_hash", "left")
    reason = (F.when(F.col("_pages").isNull(), "another file").when(~F.coalesce("verified", F.lit(False)) | F.col("verified_at").isNull(), "incomplete check")
              .when(~F.coalesce(F.col("page_no").between(1, F.col("_pages")), F.lit(False)) | (F.trim(F.coalesce("source_text", F.lit(""))) == ""), "page or quote missing"))
    tagged = joined.withColumn("reason", reason)
    good = newest(tagged.filter("reason is null"), ["file_hash", "field_code"], [F.desc("verified_at")]).select(
        "file_hash", "field_code", *[F.col(c).alias(f"_o_{c}") for c in ("value", "page_no", "source_text", "verified_at")])
    both = items.join(good, ["file_hash", "field_code"], "left")
    on = F.col("_o_verified_at").isNotNull()
    out = both.withColumn("ai_confidence", F.col("confidence"))
    for c in ("value", "page_no", "source_text"):
        out = out.withColumn(c, F.when(on, F.col(f"_o_{c}")).otherwise(F.col(c)))
    out = (out.withColumn("confidence", F.when(on, 1.0).otherwise(F.col("confidence"))).withColumn("needs_review", F.when(on, False).otherwise(F.col("needs_review")))
           .withColumn("verified_at", F.col("_o_verified_at")))
    return out.drop(*[f"_o_{c}" for c in ("value", "page_no", "source_text", "verified_at")]), tagged.filter("reason is not null").drop("_pages")


TYPE_PATHS = ("document_type", "property_type", "tenure_type")


def validate_evidence(fields: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JOB-11: (fields, warnings). A value without support in its quotes, or quotes not on their pages, becomes null.

    ``fields``: file_hash, path, value, sources, kind ("text" or "number"). Quotes of scanned pages cannot be
    checked against text; type fields need no match between value and quote.
    """
    quotes = fields.select("file_hash", "path", F.posexplode("sources").alias("_at", "_s")).select(
        "file_hash", "path", "_at", F.col("_s.page").alias("page_no"), nfkc_compact(F.coalesce("_s.text", F.lit(""))).alias("folded"))
    modes = pages.select("file_hash", "page_no", "mode")
    found = check_quotes(quotes, page_forms(pages), ["file_hash"]).join(modes, ["file_hash", "page_no"], "left")
    good = F.col("mode").isNotNull() & (F.col("folded") != "") & ((F.col("mode") != "text") | F.col("on_page"))
    support = found.groupBy("file_hash", "path").agg(F.bool_and(good).alias("_good"), F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "folded"))), lambda x: x["folded"]).alias("_quotes"))
    joined = fields.join(support, ["file_hash", "path"], "left")
    from ..functions.evidence import lines_in_quotes
    numbers = F.regexp_replace(F.array_join("_quotes", "\u0002"), ",", "")
    in_numbers = number_in_quote(F.col("value").try_cast("decimal(38,10)"), numbers)
    supported = (F.when(F.col("path").isin(*TYPE_PATHS), F.lit(True)).when(F.col("kind") == "number", in_numbers)
                 .when(F.col("kind") == "text", lines_in_quotes(F.col("value"), F.col("_quotes"))).otherwise(F.lit(True)))
    bad = F.col("value").isNotNull() & (~F.coalesce("_good", F.lit(False)) | ~F.coalesce(supported, F.lit(False)) | (F.col("value") == ""))
    tagged = joined.withColumn("_bad", bad)
    empty = F.array().cast(fields.schema["sources"].dataType)
    out = (tagged.withColumn("sources", F.when(F.col("_bad") | F.col("value").isNull(), empty).otherwise(F.col("sources")))
           .withColumn("value", F.when(F.col("_bad"), F.lit(None).cast("string")).otherwise(F.col("value"))).select(*fields.columns))
    return out, tagged.filter("_bad").select("file_hash", "path", F.lit("根拠不備のためnullに変更").alias("warning"))
