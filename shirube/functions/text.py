"""Text folding, splitting and tests over string columns (SC-1..3, 9..15, 21..23, 26, 27, 29)."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# ---- fixed values -----------------------------------------------------------------------
KANJI_DIGITS = "〇一二三四五六七八九壱弐参"
KANJI_DIGIT_VALUES = "0123456789123"
# Radical look-alikes printed by some map exports, and the ideographs they stand for.
RADICALS = "⼀⼆⼟⼯⼼⽇⽌⽔⽕⽤⾏⾯⾼"
RADICAL_IDEOGRAPHS = "一二土工心日止水火用行面高"
WIDE_DIGITS = "０１２３４５６７８９"
SMALL_KANA = "ァィゥェォッャュョヮぁぃぅぇぉっゃゅょゎ"
FULL_KANA = "アイウエオツヤユヨワあいうえおつやゆよわ"
BLANK_MARKS = ("\ue042\ue043\ue044", "\ue045\ue046\ue047\ue048")
GAIJI_RANGES = "[\ue000-\ue041\ue049-\ue177\ue1b0-\uf8ff]"
CORPORATE_WORDS = ("株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "法人", "組合", "銀行",
                   "信用金庫", "公社", "財団", "社団")
ADDRESS_HEAD = r"^(?:東京都|北海道|京都府|大阪府|.{2,3}県|[^\s\d]{1,5}[市区郡])"
NOT_APPLICABLE = ("", "なし", "該当なし", "無", "不明", "-", "－", "ー")
NUMBER_UNITS = {
    "report": "円(?:/月|／月)?|戸",
    "disclosure": "円|㎡|m2|戸",
}
# ------------------------------------------------------------------------------------------

def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


SPACES = r"(?U)[\s\x{1c}-\x{1f}]+"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


# Anything but ASCII, ruling, kana and unified ideographs: characters of these ranges are their own NFKC form and compose with none of each other.
UNSETTLED = r"[^\x00-\x7F\x{2500}-\x{257F}\x{3001}-\x{3003}\x{3005}-\x{301B}\x{3041}-\x{3096}\x{30A1}-\x{30FE}\x{4E00}-\x{9FFF}]"


def nfkc(col: Column) -> Column:
    """NFKC form. Texts that are in that form already are passed to Python as null, so only the others are copied and folded."""
    settled = ~col.rlike(UNSETTLED)
    return F.coalesce(F.when(settled, col), _nfkc(F.when(~settled, col)))


def strip_spaces(col: Column) -> Column:
    return F.regexp_replace(col, SPACES, "")


def nfkc_compact(col: Column) -> Column:
    """SC-1: NFKC form with every whitespace character removed. Spaces of any width are dropped before Python is asked."""
    settled = let(strip_spaces(col), lambda dense: F.when(~dense.rlike(UNSETTLED), dense))
    return F.coalesce(settled, strip_spaces(_nfkc(F.when(settled.isNull(), col))))


def match_text(col: Column) -> Column:
    """SC-2: key text for matching; whitespace and the middle dot do not count, null is empty."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)[\s・]+", "")


def canonical_address(col: Column) -> Column:
    """SC-3: one spelling for lot numbers and no leading metropolis name."""
    folded = nfkc_compact(F.coalesce(col.cast("string"), F.lit("")))
    spelled = F.replace(F.replace(folded, F.lit("番地の"), F.lit("番")), F.lit("番地"), F.lit("番"))
    return F.regexp_replace(spelled, "^東京都", "")


def parse_area(col: Column) -> Column:
    """SC-9: printed areas use ":" as the decimal point and may omit the decimals."""
    whole = F.replace(F.regexp_extract(col, r"([\d,]+):(\d{2})?", 1), F.lit(","), F.lit(""))
    cents = F.regexp_extract(col, r"([\d,]+):(\d{2})?", 2)
    return F.concat(F.nullif(whole, F.lit("")), F.lit("."), F.when(cents == "", "0").otherwise(cents)).try_cast("decimal(18,4)")


def arabic_numerals(col: Column) -> Column:
    """SC-10: positional kanji digits to arabic ones, one character for one.

    A run counts as a number when a counter follows it or a lot word precedes it; a lone digit in
    a spaced personal name is left alone. Whole runs are marked, however long, then translated.
    """
    run = f"[{KANJI_DIGITS}]+"
    mark = "\u0001"
    in_number = f"(?<=[番の第地]){run}|{run}(?=番|号|年|月|日|階|の|分|$)"
    room_name = f"(建物の名称[　 ]*│[　 ]*)({run})(?=[　 ]*[│┃])"

    def convert(text: Column, pattern: str, marked: str) -> Column:
        parts = F.split(F.regexp_replace(text, pattern, marked), mark)
        return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.translate(x, KANJI_DIGITS, KANJI_DIGIT_VALUES)).otherwise(x)), "")

    return convert(convert(F.replace(col, F.lit(mark), F.lit("")), in_number, f"{mark}$0{mark}"), room_name, f"$1{mark}$2{mark}")


def old_numerals(col: Column) -> Column:
    """True for text printed with positional kanji dates or lot numbers."""
    run = f"[{KANJI_DIGITS}]+"
    return col.rlike(f"(?:昭和|平成){run}年|{run}番地?[壱弐参]")


def fix_glyphs(col: Column) -> Column:
    """SC-11: radical look-alikes back to ideographs."""
    return F.translate(col, RADICALS, RADICAL_IDEOGRAPHS)


def half_width(col: Column) -> Column:
    """SC-11: full-width digits and metre sign to half width."""
    return F.translate(col, WIDE_DIGITS + "ｍ", "0123456789m")


def split_place(col: Column) -> Column:
    """SC-12: place name and lot part of a location, split at the first lot number."""
    has_lot = col.rlike(r"\d+番")
    return F.struct(
        F.when(has_lot, F.regexp_extract(col, r"(?s)^(.*?)\d+番", 1)).otherwise(col).alias("place"),
        F.when(has_lot, F.regexp_extract(col, r"(?s)(\d+番.*)$", 1)).alias("lot"),
    )


def split_places(col: Column) -> Column:
    """SC-12: several lots in one location; a lot without a place takes the one before it."""
    parts = F.transform(F.split(col, "、"), split_place)
    filled = F.aggregate(
        parts,
        F.array().cast("array<struct<place:string,lot:string>>"),
        lambda acc, part: F.concat(acc, F.array(F.struct(
            F.when(part["place"] != "", part["place"])
            .otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1))["place"], F.lit(""))).alias("place"),
            part["lot"].alias("lot"),
        ))),
    )
    return filled


def split_lot(col: Column) -> Column:
    """SC-12: main and branch number of a lot ("12番3", "12番地の3", "12-3")."""
    pattern = r"^(\d+)(?:番地の?|番|[-−ー])(\d+)$"
    folded = nfkc_compact(col)
    return F.when(folded.rlike(pattern), F.struct(
        F.regexp_extract(folded, pattern, 1).alias("main"), F.regexp_extract(folded, pattern, 2).alias("branch")))


def split_house_number(col: Column) -> Column:
    """SC-12: place, main number, branch and room suffix of a house number."""
    pattern = r"^(.+?)(\d+)番(\d+)の(.+)$"
    folded = nfkc_compact(col)
    names = ("place", "main", "branch", "room")
    return F.when(folded.rlike(pattern), F.struct(
        *[F.regexp_extract(folded, pattern, i).alias(n) for i, n in enumerate(names, 1)]))


def split_floor(col: Column) -> Column:
    """SC-12: floor label for the form ("地下1階部分" -> "地下1"); anything else is null."""
    pattern = r"^(地下)?(\d+)階(?:部分)?$"
    folded = nfkc_compact(col)
    return F.when(folded.rlike(pattern),
                  F.concat(F.regexp_extract(folded, pattern, 1), F.regexp_extract(folded, pattern, 2)))


def clean_label(col: Column) -> Column:
    """Single spaces and no surrounding punctuation."""
    squeezed = F.regexp_replace(col, r"(?U)\s+", " ")
    return F.regexp_replace(squeezed, r"^[ ：:―\-]+|[ ：:―\-]+$", "")


def format_height(kind: Column, limit: Column) -> Column:
    """SC-13: height-district text: limit first, then the kind without its suffix."""
    short = F.coalesce(half_width(F.regexp_replace(clean_label(kind), "高度地区$", "")), F.lit(""))
    metres = let(half_width(clean_label(limit)), lambda m: F.when(m.rlike("(?i)m$"), m).otherwise(F.concat(m, F.lit("m"))))
    return let(short, lambda s: F.when(s.rlike(r"(?i)^\d+(?:\.\d+)?m$"), s)
               .when(F.coalesce(limit, F.lit("")) != "", F.concat(metres, s))
               .otherwise(F.nullif(s, F.lit(""))))


def room_key(col: Column) -> Column:
    """SC-14: room name without its suffix; leading zeros stay."""
    return F.trim(F.regexp_replace(col, r"(?U)\s*号室$", ""))


def to_number(col: Column, units: str = NUMBER_UNITS["report"], folded: bool = False) -> Column:
    """SC-15: amount with separators and an optional unit to DECIMAL; other text gives null. ``folded``: the text is in NFKC form already."""
    dense = strip_spaces(col) if folded else nfkc_compact(col)
    token = F.regexp_replace(F.regexp_replace(dense, "[,，]", ""), f"(?:{units})$", "")
    return F.when(token.rlike(r"^\d+(?:\.\d+)?$"), token).try_cast("decimal(38,10)")


def page_mode(text: Column) -> Column:
    """SC-21: a page is text when it is long enough and a tenth of it is Japanese."""
    dense = strip_spaces(F.coalesce(text, F.lit("")))
    japanese = F.length(F.regexp_replace(dense, "[^぀-ヿ㐀-鿿]", ""))
    readable = (F.length(dense) >= 80) & (japanese >= F.length(dense) * 0.1)
    return F.when(readable, "text").otherwise("scan")


def registry_page_mode(text: Column, image_area: Column) -> Column:
    """SC-21: variant for ledgers: enough letters, few replacement marks; sparse text on a large image is mixed."""
    dense = nfkc_compact(F.coalesce(text, F.lit("")))
    letters = F.length(F.regexp_replace(dense, "[^一-龯ぁ-んァ-ヶA-Za-z0-9]", ""))
    broken = F.length(dense) - F.length(F.replace(dense, F.lit("�"), F.lit("")))
    readable = (letters >= 40) & (broken < F.greatest(F.length(dense), F.lit(1)) * 0.02)
    struck = F.contains(text, F.lit("抹消"))
    return (F.when(~readable, "scan")
            .when(~struck & (letters < 250) & (F.coalesce(image_area, F.lit(0)) > 500000), "mixed")
            .otherwise("text"))


def has_gaiji(col: Column) -> Column:
    """SC-22: private-use characters that cannot be transcribed."""
    return col.rlike(GAIJI_RANGES)


def blank_marks(col: Column) -> Column:
    """SC-22: the printed "intentionally blank" glyphs become spaces of the same length."""
    for mark in BLANK_MARKS:
        col = F.replace(col, F.lit(mark), F.lit("　" * len(mark)))
    return col


def strip_ideographic(col: Column) -> Column:
    return F.regexp_replace(col, "^[　 ]+|[　 ]+$", "")


def is_spaced_name(col: Column) -> Column:
    """SC-23: a personal name is printed with a space between its characters."""
    bare = strip_ideographic(col)
    return (F.length(bare) >= 3) & bare.rlike(r"(?U)^\S(?:[　 ]\S)+$")


def is_corporate(col: Column) -> Column:
    return col.rlike("|".join(CORPORATE_WORDS))


def is_address(col: Column) -> Column:
    return col.rlike(ADDRESS_HEAD)


def search_fold(col: Column) -> Column:
    """SC-26: search text: width, case, spaces and small kana do not matter."""
    return F.translate(strip_spaces(F.lower(nfkc(F.coalesce(col, F.lit(""))))), SMALL_KANA, FULL_KANA)


def search_word(word: str) -> str:
    """A word of a query, folded as ``search_fold`` folds the texts, once and not for every row."""
    folded = unicodedata.normalize("NFKC", word).lower().translate(str.maketrans(SMALL_KANA, FULL_KANA))
    return "".join(c for c in folded if not c.isspace() and c not in "\x1c\x1d\x1e\x1f")


def zone_key(col: Column) -> Column:
    return strip_spaces(F.translate(F.coalesce(col.cast("string"), F.lit("")), WIDE_DIGITS, "0123456789"))


def is_applicable(col: Column) -> Column:
    """SC-27: null and the not-applicable vocabulary are no values."""
    return col.isNotNull() & ~zone_key(col).isin(*NOT_APPLICABLE)


def failure_reason(message: Column) -> Column:
    """SC-29: class of a reading failure."""
    text = F.lower(message)
    return (F.when(text.rlike("401|api_key|初期設定"), "credentials")
            .when(text.rlike("429|quota"), "quota")
            .when(text.rlike("timeout|timed out"), "timeout")
            .when(text.rlike("connection|getaddrinfo|urlopen|接続"), "connection")
            .otherwise("other"))
