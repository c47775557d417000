"""Ownership shares as exact numerator/denominator pairs (SC-4)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, nfkc_compact

SHARE_TYPE = "struct<n:decimal(38,0),d:decimal(38,0)>"
GROUPED = r"(?:(\d+)億)?(?:(\d+)万)?(\d*)"
SHARE = f"^{GROUPED}分の{GROUPED}$"


def _grouped(parts: Column, first: int) -> Column:
    """Integer with 億 / 万 groups from three of the split parts: "32万7285" is 327285."""
    part = lambda i: F.coalesce(F.when(parts[first + i] != "", parts[first + i].try_cast("decimal(20,0)")), F.lit(0))
    return (part(0) * 100000000 + part(1) * 10000 + part(2)).cast("decimal(38,0)")


def _parts(text: Column, pattern: str, groups: int) -> Column:
    """All groups of a pattern for the whole text by one pass of it; a text without commas that does not match is one part."""
    return F.split(F.regexp_replace(text, pattern, ",".join(f"${i + 1}" for i in range(groups))), ",")


def grouped_number(col: Column) -> Column:
    whole = f"^{GROUPED}$"
    return let(col, lambda t: F.when(t.rlike(whole) & (t != ""), let(_parts(t, whole, 3), lambda p: _grouped(p, 0))))


def parse_share(col: Column) -> Column:
    """``d分のn`` or ``n/d`` with 0 < n <= d, else null."""
    text = F.replace(nfkc_compact(col.cast("string")), F.lit(","), F.lit(""))
    text = let(text, lambda t: F.when(F.contains(t, F.lit("/")), F.regexp_replace(t, r"^(\d+)/(\d+)$", "$2分の$1")).otherwise(t))
    pair = let(_parts(text, SHARE, 6), lambda p: F.when(F.size(p) == 6, F.struct(_grouped(p, 3).alias("n"), _grouped(p, 0).alias("d"))))
    return let(pair, lambda p: F.when((p["n"] > 0) & (p["n"] <= p["d"]), p))


def share_text(n: Column, d: Column) -> Column:
    return F.concat(d.cast("string"), F.lit("分の"), n.cast("string"))
