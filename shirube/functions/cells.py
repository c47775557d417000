"""Text of ruled tables with per-character strike flags (SC-19, SC-20)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

RULE_CHARS = "┃┏┓┗┛┠┨├┤━─┯┷┬┴┼┳┻│┝┥┿"


def is_table_line(text: Column) -> Column:
    return text.rlike("^[　 ]*[┃┏┠┗]")


def is_rule_line(text: Column) -> Column:
    """SC-20: only ruling characters and spaces."""
    return is_table_line(text) & ~text.rlike(f"[^{RULE_CHARS}　 ]")


def split_cells(text: Column, flags: Column) -> Column:
    """SC-20: pieces between column bars, each with its slice of the flags."""
    def cells_of(pieces: Column) -> Column:
        inner = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))

        def cut(piece: Column, index: Column) -> Column:
            before = F.aggregate(F.slice(pieces, 1, index + 1), F.lit(0), lambda acc, p: acc + F.length(p) + 1)
            return F.struct(piece.alias("text"), F.slice(flags, before + 1, F.length(piece)).alias("flags"))

        return F.transform(inner, cut)

    return let(F.split(text, "[┃│]"), cells_of)


def _kept(text: Column, flags: Column, struck: bool) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    pairs = F.arrays_zip(chars.alias("c"), F.slice(flags, 1, F.size(chars)).alias("u"))
    return F.filter(pairs, lambda p: F.coalesce(p["u"], F.lit(False)) == F.lit(struck))


def current_text(text: Column, flags: Column) -> Column:
    """SC-19: characters that are still in effect."""
    plain = ~F.exists(flags, lambda u: u)
    gone = ~F.exists(flags, lambda u: ~u) & (F.size(flags) >= F.length(text))
    return F.when(plain, text).when(gone, F.lit("")).otherwise(F.array_join(F.transform(_kept(text, flags, False), lambda p: p["c"]), ""))


def is_struck(text: Column, flags: Column) -> Column:
    """SC-19: every visible character is struck, and there is one."""
    visible = text.rlike("[^　 ]")
    return visible & ~current_text(text, flags).rlike("[^　 ]")


def flags_from_marks(marked: Column) -> Column:
    """Strike flags from text whose struck runs are wrapped in "~" (fixtures and plain-text exports)."""
    parts = F.split(marked, "~")
    return F.flatten(F.transform(parts, lambda p, i: F.array_repeat(i % 2 == 1, F.length(p))))
