"""Era dates and lease periods (SC-5..8)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, nfkc_compact

# ---- fixed values: first day of each era ---------------------------------------------------
ERA_STARTS = {
    "明治": "1868-09-08",
    "大正": "1912-07-30",
    "昭和": "1926-12-25",
    "平成": "1989-01-08",
    "令和": "2019-05-01",
}
# ------------------------------------------------------------------------------------------
ERA_NAMES = "|".join(ERA_STARTS)
ERA_DATE = rf"(?:{ERA_NAMES})(?:元|\d+)年\d+月\d+日"


def civil_date(year: Column, month: Column, day: Column) -> Column:
    """DATE from parts; an impossible day gives null."""
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"),
                    F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def iso_date(col: Column) -> Column:
    """DATE from exactly YYYY-MM-DD text."""
    return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col, "yyyy-MM-dd"))


def _era_parts(text: Column, pattern: str, eras: dict[str, str]) -> Column:
    """Struct of era, year number and day by the era's offset."""
    names = F.create_map(*[F.lit(x) for name, start in eras.items() for x in (name, int(start[:4]))])
    get = lambda t, i: F.regexp_extract(t, pattern, i)
    parts = let(text, lambda t: F.struct(
        get(t, 1).alias("era"), F.when(get(t, 2) == "元", F.lit(1)).otherwise(get(t, 2).try_cast("int")).alias("year"),
        get(t, 3).try_cast("int").alias("month"), get(t, 4).try_cast("int").alias("day")))
    return let(parts, lambda p: F.struct(p["era"].alias("era"), p["year"].alias("year"),
                                         civil_date(F.try_element_at(names, p["era"]) + p["year"] - 1, p["month"], p["day"]).alias("actual")))


def era_to_date(col: Column, strict: bool = True) -> Column:
    """SC-5 (strict): a whole-string era or ISO date whose day lies inside the era.

    SC-6 (not strict): the first era date found in the text, by year offset only.
    """
    if not strict:
        pattern = rf"({ERA_NAMES})\s*(元|\d+)年\s*(\d+)月\s*(\d+)日"
        return _era_parts(col, pattern, ERA_STARTS)["actual"]
    starts = list(ERA_STARTS.items())
    first = F.create_map(*[F.lit(x) for x in sum(([n, d] for n, d in starts), [])])
    after = F.create_map(*[F.lit(x) for x in sum(([n, starts[i + 1][1] if i + 1 < len(starts) else "9999-12-31"] for i, (n, _) in enumerate(starts)), [])])
    pattern = rf"^({ERA_NAMES})(元|\d+)年(\d+)月(\d+)日$"

    def read(text: Column) -> Column:
        inside = lambda p: F.when((p["year"] > 0) & (p["actual"] >= F.try_element_at(first, p["era"]).cast("date"))
                                  & (p["actual"] < F.try_element_at(after, p["era"]).cast("date")), p["actual"])
        return F.coalesce(iso_date(text), let(_era_parts(text, pattern, ERA_STARTS), inside))

    return let(F.regexp_replace(nfkc_compact(col), "新築$", ""), read)


def printed_date(col: Column) -> Column:
    """SC-6: date after the printed-on label (era or western), else the first current-era date."""
    western = r"印刷日\s*[：:]\s*(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
    era_label = r"印刷日\s*[：:]\s*(令和\s*\d+年\s*\d+月\s*\d+日)"
    found = civil_date(*[F.regexp_extract(col, western, i).try_cast("int") for i in (1, 2, 3)])
    return F.coalesce(current_era_date(F.regexp_extract(col, era_label, 1)), found, current_era_date(col))


def current_era_date(col: Column) -> Column:
    """SC-6: first date of the current era in the text."""
    return _era_parts(col, r"(令和)\s*(\d+|元)年\s*(\d+)月\s*(\d+)日", {"令和": ERA_STARTS["令和"]})["actual"]


def date_to_era(col: Column) -> Column:
    """SC-7: era, year of the era, month and day; null before the first era."""
    base = era = None
    for name, start in ERA_STARTS.items():  # later eras override earlier ones
        hit = col >= F.lit(start).cast("date")
        era = F.when(hit, name) if era is None else F.when(hit, name).otherwise(era)
        base = F.when(hit, int(start[:4])) if base is None else F.when(hit, int(start[:4])).otherwise(base)
    return F.when(era.isNotNull(), F.struct(
        era.alias("era"), (F.year(col) - base + 1).alias("year"), F.month(col).alias("month"), F.day(col).alias("day")))


def era_text(col: Column) -> Column:
    """SC-7: printed era form of a date."""
    parts = date_to_era(col)
    return F.concat(parts["era"], parts["year"].cast("string"), F.lit("年"),
                    parts["month"].cast("string"), F.lit("月"), parts["day"].cast("string"), F.lit("日"))


def lease_end(start: Column, years: Column) -> Column:
    """SC-8: last day of a lease; a 29 February start ends a shorter year on the 27th."""
    return F.date_sub(F.add_months(start, years * 12), 1)
