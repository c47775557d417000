"""Pages, quotes, segmentation and extraction over the text tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, quotes, resolve, segment, versions, views
from ..operators.ordered import Last, Running, scan
from ..session import spread
from .adapter import table

BLANKS = "[ \n\t\r]+"


def _dealt(spark, sf_dir):
    """Documents dealt over the shuffle partitions once; their pages and claims stay where they are."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _pages(spark, sf_dir):
    """Every line of a document is a page; text is folded once."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("_i", "text"))
    return lines.select("doc_id", "source", "lang", (F.col("_i") + 1).alias("page_no"), "text", F.regexp_replace("text", BLANKS, "").alias("folded"))


def _folded_lines(spark, sf_dir):
    lines = _dealt(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("_i", "text"))
    return lines.select("doc_id", (F.col("_i") + 1).alias("page_no"), F.regexp_replace("text", BLANKS, "").alias("folded"))


def _claims(spark, sf_dir):
    """Every sentence claims to stand on some page of its document."""
    docs = _dealt(spark, sf_dir)
    lines = docs.select("doc_id", F.size(F.split("text", "\n")).alias("_n"), F.posexplode(F.split("text", "\n")).alias("_i", "_line"))
    sentences = lines.select("doc_id", "_n", "_i", F.posexplode(F.split("_line", "\\. ")).alias("_s", "_quote"))
    return sentences.select("doc_id", (F.col("_i") + 1).alias("line_no"), F.col("_s").alias("sentence_no"),
                            (F.pmod(F.col("_i") + F.col("_i") * F.col("_s"), F.col("_n")) + 1).alias("page_no"),
                            F.regexp_replace("_quote", BLANKS, "").alias("folded"))


CLAIMS_SQL = r"""p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page_no, len(string_split(text, chr(10))) AS n FROM documents),
pages_ AS (SELECT doc_id, page_no, regexp_replace(line, '[ \n\t\r]+', '', 'g') AS folded FROM p),
s AS (SELECT doc_id, n, page_no AS line_no, unnest(string_split(line, '. ')) AS q, generate_subscripts(string_split(line, '. '), 1) - 1 AS sentence_no FROM p),
claims AS (SELECT doc_id, line_no, sentence_no, ((line_no - 1) + (line_no - 1) * sentence_no) % n + 1 AS page_no, regexp_replace(q, '[ \n\t\r]+', '', 'g') AS folded FROM s)"""


def quote_check(spark, sf_dir):
    """Does every sentence stand on the page it names?"""
    found = quotes.check_quotes(_claims(spark, sf_dir), _folded_lines(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "line_no", "sentence_no", "page_no", "on_page")


def page_correction(spark, sf_dir):
    """A sentence that is not on its page moves to the one other page that has it, else it needs review."""
    found = quotes.correct_pages(_claims(spark, sf_dir), _folded_lines(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "line_no", "sentence_no", "page_no", "on_page", F.coalesce("found_pages", F.lit(-1)).alias("found_pages"),
                        F.col("corrected_page").cast("string").alias("corrected_page"), "needs_review")


def locate_quotes(spark, sf_dir):
    """Documents that contain each benchmark passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", BLANKS, "").alias("folded"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", BLANKS, "").alias("folded"))
    return quotes.locate(items, docs, [], ["doc_id"]).join(items, "folded").select("item_id", "doc_id")


def single_hit_extract(spark, sf_dir):
    """Labelled patterns per document: a value counts only when it was found exactly once."""
    patterns = {"mail": r"([A-Za-z0-9._]+@[A-Za-z0-9.]+)", "address": r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", "license": r"(Released under the [A-Z][A-Za-z]* License)"}
    hits = None
    for code, pattern in patterns.items():
        one = _pages(spark, sf_dir).select("doc_id", "page_no", F.lit(code).alias("field_code"), F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("value"))
        hits = one if hits is None else hits.unionByName(one)
    found = aggregates.single_hit(hits.withColumn("source_text", F.col("value")), ["doc_id", "field_code"])
    return found.select("doc_id", "field_code", "hits", "value", F.col("page_no").cast("string").alias("page_no"), "needs_review")


def page_titles(spark, sf_dir):
    """Title and first heading of web pages as single-hit labels."""
    html = table(spark, sf_dir, "pages")
    hits = None
    for code, pattern in {"title": "(?s)<title>(.*?)</title>", "heading": "(?s)<h1>(.*?)</h1>", "paragraph": "(?s)<p>(.*?)</p>"}.items():
        one = html.select("page_id", F.lit(code).alias("field_code"), F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("value"))
        hits = one if hits is None else hits.unionByName(one)
    found = aggregates.single_hit(hits.withColumn("page_no", F.lit(1)).withColumn("source_text", F.col("value")), ["page_id", "field_code"])
    return found.select("page_id", "field_code", "hits", "value", "needs_review")


def complete_fields(spark, sf_dir):
    """Quality and toxicity of every document; unlabelled ones read "not obtained"."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    values = labels.unpivot(["doc_id"], ["quality", "toxic"], "field_code", "value")
    return aggregates.complete_fields(values, table(spark, sf_dir, "documents").select("doc_id"), ["quality", "toxic"], "doc_id")


def segment_records(spark, sf_dir):
    """Events of a user cut into records at each signup; the last error value is carried as label."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    found = scan(events, ["user_id"], F.to_date("ts"), ["ts", "event_id"], {
        "record_id": Running(F.when(kind == "signup", 1).otherwise(0)),
        "label": Last(F.when(kind == "error", (F.col("value") * 100).cast("decimal(20,0)").cast("string")))})
    return found.select("event_id", "user_id", "record_id", "label")


def continuation_merge(spark, sf_dir):
    """Assistant turns continue the record the turn before them started."""
    conv = table(spark, sf_dir, "conversations")
    rows = conv.select("conv_id", F.col("turn").alias("ord"), F.lit(0).alias("page_no"), (F.col("role") == "assistant").alias("is_continuation"), "text")
    merged = segment.merge_rows(rows, ["conv_id"], F.floor(F.col("ord") / 64), ["ord"], ["text"])
    return merged.select("conv_id", F.col("record_id").alias("record"), "rows", F.col("first_ord").alias("first_turn"), "text")


def ledger_cut(spark, sf_dir):
    """Events of a user from the last signup on."""
    events = table(spark, sf_dir, "events")
    return versions.since_last_reset(events, ["user_id"], "event_id", F.col("event_type") == "signup").select("user_id", "event_id", "event_type")


def classify_kind(spark, sf_dir):
    """Kind of each document from titles drawn on its pages and from its file name; a clash gives null.

    Every line of a document is a page; a source picks the title on the last of them, a language the name.
    """
    number = F.substring("source", 4, 9).cast("int")
    title = F.element_at(F.array(*map(F.lit, TITLES)), (number % len(TITLES) + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, FILE_NAMES)), (F.col("doc_id") % len(FILE_NAMES) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    lines = _pages(spark, sf_dir).select("doc_id", "page_no", "text")
    last = docs.select("doc_id", (F.size(F.split("text", "\n")) + 1).alias("page_no"), title.alias("text"))
    pages = lines.unionByName(last, allowMissingColumns=False).withColumnRenamed("doc_id", "file_hash")
    files = docs.select(F.col("doc_id").alias("file_hash"), name.alias("name"))
    return resolve.classify(files, pages).select(F.col("file_hash").alias("doc_id"), F.coalesce("kind", F.lit("unknown")).alias("kind"))


# fixed values: one title line for each kind that any page may show, and file names of each kind
TITLES = ("履歴事項全部証明書", "重要事項 調査報告書", "重要事項説明書", "表題部（土地の表示）", "管理に係る重要事項")
TITLE_KINDS = ("other", "report", "purchase", "registry", "report")
FILE_NAMES = ("scan.pdf", "会社謄本.pdf", "重調.pdf", "重説.pdf", "土地謄本.pdf", "細則.pdf", "都市計画.pdf")
NAME_KINDS = (None, "other", "report", "purchase", "registry", "rules", "zoning")


def case_search(spark, sf_dir):
    """Customers whose folded name, segment and nation contain every word."""
    cust, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    cards = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return views.search_cases(cards, "ＢＵＩＬＤ  nation_1", ["c_name", "c_mktsegment", "n_name"]).select("c_custkey", "c_name")


def _quoted(values) -> str:
    return ", ".join("NULL" if v is None else f"'{v}'" for v in values)


QUERIES = {
    "quote_check": (quote_check, f"""WITH {CLAIMS_SQL} SELECT c.doc_id, c.line_no, c.sentence_no, c.page_no, c.folded <> '' AND contains(g.folded, c.folded) AS on_page
FROM claims c JOIN pages_ g ON g.doc_id = c.doc_id AND g.page_no = c.page_no"""),
    "page_correction": (page_correction, f"""WITH {CLAIMS_SQL}, f AS (SELECT c.doc_id, c.line_no, c.sentence_no, c.page_no, count(g.page_no) AS found_pages, coalesce(bool_or(g.page_no = c.page_no), false) AS on_page, min(g.page_no) AS only_
FROM claims c LEFT JOIN pages_ g ON g.doc_id = c.doc_id AND c.folded <> '' AND contains(g.folded, c.folded) GROUP BY 1, 2, 3, 4)
SELECT doc_id, line_no, sentence_no, page_no, on_page, CASE WHEN on_page THEN -1 ELSE found_pages END AS found_pages, CAST(CASE WHEN on_page THEN page_no WHEN found_pages = 1 THEN only_ END AS VARCHAR) AS corrected_page,
  NOT on_page AND found_pages <> 1 AS needs_review FROM f"""),
    "locate_quotes": (locate_quotes, r"""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(regexp_replace(d.text, '[ \n\t\r]+', '', 'g'), regexp_replace(b.text, '[ \n\t\r]+', '', 'g'))"""),
    "single_hit_extract": (single_hit_extract, r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents),
h AS (SELECT doc_id, page_no, 'mail' AS field_code, unnest(regexp_extract_all(line, '([A-Za-z0-9._]+@[A-Za-z0-9.]+)', 1)) AS value FROM p
  UNION ALL SELECT doc_id, page_no, 'address', unnest(regexp_extract_all(line, '\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b', 1)) FROM p
  UNION ALL SELECT doc_id, page_no, 'license', unnest(regexp_extract_all(line, '(Released under the [A-Z][A-Za-z]* License)', 1)) FROM p)
SELECT doc_id, field_code, count(*) AS hits, CASE WHEN count(*) = 1 THEN min(value) END AS value, CASE WHEN count(*) = 1 THEN CAST(min(page_no) AS VARCHAR) END AS page_no, count(*) <> 1 AS needs_review FROM h GROUP BY 1, 2"""),
    "page_titles": (page_titles, r"""WITH h AS (SELECT page_id, 'title' AS field_code, unnest(regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1)) AS value FROM pages
  UNION ALL SELECT page_id, 'heading', unnest(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1)) FROM pages
  UNION ALL SELECT page_id, 'paragraph', unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) FROM pages)
SELECT page_id, field_code, count(*) AS hits, CASE WHEN count(*) = 1 THEN min(value) END AS value, count(*) <> 1 AS needs_review FROM h GROUP BY 1, 2"""),
    "complete_fields": (complete_fields, """WITH l AS (SELECT doc_id, 'quality' AS field_code, CAST(quality AS VARCHAR) AS value FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels),
e AS (SELECT doc_id, f.field_code FROM documents, (VALUES ('quality'), ('toxic')) f(field_code))
SELECT e.doc_id, e.field_code, l.value, l.doc_id IS NOT NULL AS obtained FROM e LEFT JOIN l ON e.doc_id = l.doc_id AND e.field_code = l.field_code"""),
    "segment_records": (segment_records, """SELECT event_id, user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS record_id,
  last_value(CASE WHEN event_type = 'error' THEN CAST(CAST(value * 100 AS DECIMAL(20,0)) AS VARCHAR) END IGNORE NULLS) OVER w AS label
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "continuation_merge": (continuation_merge, """WITH r AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS record FROM conversations)
SELECT conv_id, record, count(*) AS rows, min(turn) AS first_turn, string_agg(text, '' ORDER BY turn) AS text FROM r GROUP BY 1, 2"""),
    "ledger_cut": (ledger_cut, """WITH c AS (SELECT user_id, max(event_id) AS cut FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT e.user_id, e.event_id, e.event_type FROM events e LEFT JOIN c USING (user_id) WHERE c.cut IS NULL OR e.event_id >= c.cut"""),
    "classify_kind": (classify_kind, f"""WITH k AS (SELECT doc_id, list_extract([{_quoted(TITLE_KINDS)}], CAST(substr(source, 4) AS INT) % {len(TITLES)} + 1) AS bt,
  list_extract([{_quoted(NAME_KINDS)}], CAST(doc_id % {len(FILE_NAMES)} AS INT) + 1) AS bn FROM documents)
SELECT doc_id, CASE WHEN bn IS NOT NULL AND bt <> bn OR coalesce(bt, bn) NOT IN ({_quoted(resolve.DOCUMENT_KINDS)}) THEN 'unknown' ELSE bt END AS kind FROM k"""),
    "case_search": (case_search, """SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE contains(lower(c_name || c_mktsegment || n_name), 'build') AND contains(lower(c_name || c_mktsegment || n_name), 'nation_1')"""),
}
