"""Lines and glyphs to records, rows and article blocks (WIN-6..11, WIN-17)."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import current_text, is_rule_line, is_table_line, split_cells
from ..functions.text import let, nfkc_compact, strip_ideographic
from ..session import cut_lineage, spread
from .ordered import Last, Running, scan

# ---- fixed values: headings of a ledger and the section each one opens, in order -----------------
SECTION_HEADINGS = [
    ("表題部(一棟の建物の表示)", "building"),
    ("表題部(敷地権の目的である土地の表示)", "site"),
    ("表題部(専有部分の建物の表示)", "unit"),
    ("表題部(敷地権の表示)", "land_right"),
    ("表題部(土地の表示)", "land"),
    ("表題部(主である建物の表示)", "house"),
    ("表題部(附属建物の表示)", "annex"),
    ("権利部(甲区)", "A"),
    ("権利部(乙区)", "B"),
    ("共同担保目録", "collateral"),
    ("専有部分の家屋番号", "unit_list"),
]
ARTICLE_HEADING = r"第\s*[0-9０-９一二三四五六七八九十百]+\s*条"
# --------------------------------------------------------------------------------------------------

LINE_ORDER = ["page_no", "line_no"]


def lines_of(pages: DataFrame) -> DataFrame:
    """SRC-2: lines of plain page text, nothing struck."""
    return (pages.select("file_hash", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
            .withColumn("flags", F.array_repeat(F.lit(False), F.length("text"))))


def _heading_section(folded: Column) -> Column:
    section = F.lit(None).cast("string")
    for text, name in reversed(SECTION_HEADINGS):
        section = F.when(F.contains(folded, F.lit(text)), name).otherwise(section)
    return section


def segment_records(lines: DataFrame) -> DataFrame:
    """WIN-6: table lines with their record number and section.

    A rule line, a heading or another number of cells starts a record; the section is carried
    forward over page breaks. ``lines``: file_hash, page_no, line_no, text, flags. Lines are dealt out before they are cut into cells.
    """
    table = spread(lines, "file_hash", *LINE_ORDER).filter(is_table_line(F.col("text"))).withColumn("is_rule", is_rule_line(F.col("text")))
    table = table.withColumn("cells", F.when(~F.col("is_rule"), split_cells(F.col("text"), F.col("flags"))))
    # two bars hold a cell; a filter on the cells themselves would move below and cut each line again
    table = table.filter(F.col("is_rule") | F.col("text").rlike("(?s)[┃│].*[┃│]"))
    folded = nfkc_compact(F.array_join(F.transform(F.coalesce("cells", F.array().cast("array<struct<text:string,flags:array<boolean>>>")), lambda c: c["text"]), ""))
    table = table.withColumn("_opens", F.when(~F.col("is_rule"), let(folded, _heading_section))).withColumn("heading", F.col("_opens").isNotNull())
    shape = F.struct(F.col("is_rule").alias("rule"), F.col("heading").alias("heading"), F.coalesce(F.size("cells"), F.lit(0)).alias("width"))
    # Both written once, since each scan reads its rows twice and would cut and fold every line again.
    table = cut_lineage(table.withColumn("_shape", shape))
    before = cut_lineage(scan(table, ["file_hash"], F.col("page_no"), LINE_ORDER, {"_before": Last(F.col("_shape"), inclusive=False)}).drop("_shape"))
    starts = ~F.col("is_rule") & (F.col("heading") | F.col("_before").isNull() | F.col("_before.rule") | F.col("_before.heading")
                                  | (F.col("_before.width") != F.size("cells")))
    rows = before.withColumn("_start", F.when(starts, 1).otherwise(0)).filter(~F.col("is_rule"))
    found = scan(rows, ["file_hash"], F.col("page_no"), LINE_ORDER, {"record_id": Running(F.col("_start")), "section": Last(F.col("_opens"))})
    return found.select("file_hash", "page_no", "line_no", "record_id", "section", "heading", F.size("cells").alias("width"), "cells")


def record_cells(segments: DataFrame) -> DataFrame:
    """D7: one row per record and column with its fragments in order.

    ``text`` is all of the cell, ``current`` what is still in effect, ``struck`` whether nothing
    visible is. ``lines`` holds the effective fragments, ``all_lines`` every one.
    """
    pieces = segments.select("file_hash", "record_id", "section", "heading", "width", "page_no", "line_no", F.posexplode("cells").alias("col", "_c"))
    pieces = pieces.select("*", F.col("_c.text").alias("raw"), F.col("_c.flags").alias("flags")).drop("_c")
    visible = F.col("raw").rlike("[^　 ]")
    pieces = pieces.withColumn("_visible", visible).withColumn("_kept", current_text(F.col("raw"), F.col("flags")))
    pieces = (pieces.withColumn("_struck", F.col("_visible") & ~F.col("_kept").rlike("[^　 ]")).withColumn("_full", nfkc_compact(F.col("raw")))
              .withColumn("_current", F.when(F.col("_kept") == F.col("raw"), F.col("_full")).otherwise(nfkc_compact(F.col("_kept")))).withColumn("_raw", strip_ideographic(F.col("raw"))))
    at = F.struct("page_no", "line_no", F.col("_current").alias("current"), F.col("_full").alias("full"), F.col("_raw").alias("raw"), F.col("_visible").alias("visible"))
    grouped = pieces.groupBy("file_hash", "record_id", "col").agg(
        F.first("section").alias("section"), F.first("heading").alias("heading"), F.first("width").alias("width"),
        F.min("page_no").alias("page_no"), F.min(F.struct("page_no", "line_no")).alias("ord"),
        F.array_sort(F.collect_list(at)).alias("_f"),
        (F.bool_or("_visible") & F.bool_and(~F.col("_visible") | F.col("_struck"))).alias("struck"))
    shown = F.filter("_f", lambda f: f["visible"])
    line = lambda part: lambda f: F.struct(f["page_no"].alias("page"), f[part].alias("text"), f["raw"].alias("raw"))
    return grouped.select(
        "file_hash", "record_id", "ord", "page_no", "section", "heading", "width", "col", "struck",
        F.array_join(F.transform(shown, lambda f: f["full"]), "").alias("text"),
        F.array_join(F.transform(shown, lambda f: f["current"]), "").alias("current"),
        F.filter(F.transform(shown, line("current")), lambda l: l["text"] != "").alias("lines"),
        F.filter(F.transform(shown, line("full")), lambda l: l["text"] != "").alias("all_lines"))


def records(segments: DataFrame) -> DataFrame:
    """One row per record; ``cells`` is indexed by column."""
    cells = record_cells(segments)
    cell = F.struct("col", "text", "current", "struck", "lines", "all_lines")
    return cells.groupBy("file_hash", "record_id").agg(
        F.first("section").alias("section"), F.first("heading").alias("heading"), F.first("width").alias("width"),
        F.min("page_no").alias("page_no"), F.min("ord").alias("ord"), F.array_sort(F.collect_list(cell)).alias("cells")
    ).filter(F.exists("cells", lambda c: c["text"] != ""))


def merge_rows(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], texts: list[str]) -> DataFrame:
    """WIN-7: rows flagged ``is_continuation`` are appended to the row they continue."""
    numbered = scan(rows, keys, bucket, order, {"record_id": Running(F.when(F.col("is_continuation"), 0).otherwise(1))})
    at = F.struct(*order, *texts)
    grouped = numbered.groupBy(*keys, "record_id").agg(
        F.count(F.lit(1)).alias("rows"), *[F.min(o).alias(f"first_{o}") for o in order], F.array_sort(F.collect_list(at)).alias("_parts"))
    part = lambda name: lambda p: p[name]
    return grouped.select(*keys, "record_id", "rows", *[f"first_{o}" for o in order],
                          *[F.array_join(F.transform("_parts", part(t)), "").alias(t) for t in texts])


def carry_labels(recs: DataFrame) -> DataFrame:
    """WIN-8: a blank label column repeats the label above it; headings and other sections reset it."""
    first = F.try_element_at("cells", F.lit(1))["text"]
    seen = scan(recs, ["file_hash"], F.col("page_no"), ["record_id"], {"_before": Last(F.struct("section"), inclusive=False)})
    fresh = F.col("_before").isNull() | ~F.col("_before.section").eqNullSafe(F.col("section")) | F.col("heading") | (F.col("width") < 2)
    marked = seen.withColumn("_reset", fresh)
    # A reset stores an empty label, so nothing above it is carried past it.
    entry = F.when(F.col("heading") | (F.col("width") < 2), F.lit("")).when(first != "", first).when(F.col("_reset"), F.lit(""))
    return scan(marked, ["file_hash"], F.col("page_no"), ["record_id"], {"label": Last(entry)}).drop("_before", "_reset")


def labelled_values(labelled: DataFrame) -> DataFrame:
    """WIN-8: per section and label the last value still in effect."""
    value = F.try_element_at("cells", F.lit(2))
    rows = labelled.filter((F.col("label") != "") & ~F.col("heading") & (F.col("width") >= 2)).withColumn("_v", value).filter(F.col("_v.current") != "")
    best = rows.groupBy("file_hash", "section", "label").agg(F.max_by("_v", "record_id").alias("_v"))
    return best.select("file_hash", "section", "label", F.col("_v.current").alias("value"), F.col("_v.lines").alias("lines"))


def last_filled(rows: DataFrame, keys: list[str], order: str, columns: dict[str, Column]) -> DataFrame:
    """WIN-9: each column on its own keeps its last valid entry. ``columns``: name to value-or-null struct."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(n) for n, c in columns.items()])


def article_blocks(pages: DataFrame, text: str = "text") -> DataFrame:
    """WIN-17: text from one article heading up to the next on the same page; a page without one is one block."""
    has = F.col(text).rlike(ARTICLE_HEADING)
    parts = F.split(F.col(text), f"(?={ARTICLE_HEADING})")
    blocks = F.when(has, F.filter(parts, lambda b: b.rlike(f"^{ARTICLE_HEADING}"))).otherwise(F.array(text))
    found = pages.select(*[c for c in pages.columns if c != text], F.posexplode(blocks).alias("block_no", "block"))
    return (found.withColumn("article", F.nullif(F.regexp_extract("block", f"^({ARTICLE_HEADING})", 1), F.lit("")))
            .withColumn("block", F.when(F.col("article").isNotNull(), F.regexp_replace("block", r"(?U)^\s+|\s+$", "")).otherwise(F.col("block"))))


def underline_flags(chars: DataFrame, rules: DataFrame) -> DataFrame:
    """WIN-11: a short rule just under a character and covering it marks it as struck.

    ``chars``: file_hash, page_no, char_id, x0, x1, top, bottom, text; ``rules``: file_hash, page_no, x0, x1,
    top, bottom. The height range is cut into unit steps, which makes the range join an equi-join.
    """
    short = rules.filter((F.abs(F.col("top") - F.col("bottom")) < 1.5) & (F.col("x1") - F.col("x0") < 40)).select(
        "file_hash", "page_no", F.bround("top").cast("int").alias("y"), F.col("x0").alias("_r0"), F.col("x1").alias("_r1"))
    base = F.bround("bottom").cast("int")
    near = chars.withColumn("y", F.explode(F.sequence(base - 1, base + 3)))
    hit = near.join(short, ["file_hash", "page_no", "y"]).filter((F.col("_r0") <= F.col("x0") + 1.5) & (F.col("_r1") >= F.col("x1") - 1.5))
    struck = hit.select("file_hash", "page_no", "char_id").distinct().withColumn("_u", F.lit(True))
    return chars.join(struck, ["file_hash", "page_no", "char_id"], "left").withColumn("underlined", F.coalesce("_u", F.lit(False))).drop("_u")


def group_glyph_rows(chars: DataFrame) -> DataFrame:
    """WIN-10: characters within two units of a row's first character form one line of text.

    The row start depends on the row before it, so a page (a bounded sheet) is walked as one group.
    ``chars`` carries ``underlined``; returns lines with flags.
    """
    schema = "file_hash string, page_no int, line_no int, text string, flags array<boolean>"

    def rows(page: pd.DataFrame) -> pd.DataFrame:
        out, anchor, number = [], None, -1
        for top in page.sort_values(["top", "x0"])["top"]:
            if anchor is None or abs(anchor - top) >= 2:
                anchor, number = top, number + 1
            out.append(number)
        page = page.sort_values(["top", "x0"]).assign(line_no=out).sort_values(["line_no", "x0"], kind="stable")
        lines = page.groupby("line_no", sort=True).agg(text=("text", "".join), flags=("underlined", list)).reset_index()
        return lines.assign(file_hash=page["file_hash"].iloc[0], page_no=page["page_no"].iloc[0])[["file_hash", "page_no", "line_no", "text", "flags"]]

    from ..functions.text import blank_marks
    grouped = chars.groupBy("file_hash", "page_no").applyInPandas(rows, schema)
    return grouped.withColumn("text", blank_marks(F.col("text"))).filter(F.col("text").rlike("(?U)\\S"))
