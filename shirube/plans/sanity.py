"""AGG-17: what a person easily overlooks in a document, as rows of violations.

Rules are data: a name, the rows they look at, a test and a message. Every rule is one column over its rows, so all rules of one level are
evaluated in one pass, and a new rule is one more entry.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import nfkc

# ---- fixed values: signs between the names of several owners ---------------------------------------
OWNER_SIGNS = "、|,|及び|・"
# -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``level``: field, parcel, floor or document. ``broken`` and ``detail`` are columns over the rows of that level."""
    name: str
    level: str
    broken: Column
    detail: Column


def _value(code: str) -> Column:
    return F.when(F.col("field_code") == code, F.nullif(F.trim("value"), F.lit("")))


def _number(text: Column) -> Column:
    return F.replace(nfkc(text), F.lit(","), F.lit("")).try_cast("decimal(38,6)")


def _place(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit("　"), F.lit(""))


def rules() -> list[Rule]:
    """The five checks of a registry document."""
    owner, area = _value("current_owner_name"), _value("registered_area")
    n, d = _number(F.col("numerator")), _number(F.col("denominator"))
    total, printed = F.col("floor_total"), _number(F.col("printed_total"))
    return [
        Rule("several_owners", "field", owner.rlike(OWNER_SIGNS), owner),
        Rule("area_not_a_number", "field", area.isNotNull() & _number(area).isNull(), area),
        Rule("share_above_one", "parcel", n > d, F.concat(F.lit("parcel "), F.col("parcel_no"), F.lit(": "), F.col("numerator"), F.lit("/"), F.col("denominator"))),
        Rule("floor_not_a_number", "floor", F.col("area").isNotNull() & _number(F.col("area")).isNull(), F.concat_ws(": ", "floor", "area")),
        Rule("lot_missing", "document", F.nullif(F.trim("lot"), F.lit("")).isNull(), F.lit("")),
        Rule("place_differs", "document", (F.nullif(F.trim("town"), F.lit("")).isNotNull()) & ~_place(F.col("town")).eqNullSafe(F.coalesce(_place(F.concat(F.coalesce("form_ward", F.lit("")), F.coalesce("form_town", F.lit("")))), F.lit(""))),
             F.concat(F.coalesce("form_ward", F.lit("")), F.coalesce("form_town", F.lit("")), F.lit(" / "), F.col("town"))),
        Rule("floor_total_differs", "document", printed.isNotNull() & total.isNotNull() & (printed != total), F.concat(F.regexp_replace(total.cast("string"), r"\.?0+$", ""), F.lit(" / "), F.col("printed_total"))),
    ]


def floor_totals(floors: DataFrame, key: str = "file_hash") -> DataFrame:
    """Exact total of the floors of a document; rows that are no number do not count, and are counted apart."""
    number = _number(F.col("area"))
    return floors.groupBy(key).agg(F.sum(number).alias("floor_total"), F.count_if(F.col("area").isNotNull() & number.isNull()).alias("floors_left_out"), F.count(number).alias("floors"))


def sanity_checks(documents: DataFrame, fields: DataFrame, parcels: DataFrame, floors: DataFrame, key: str = "file_hash", table: list[Rule] | None = None) -> DataFrame:
    """Violations: key, rule, detail.

    ``documents``: key, lot, town, form_ward, form_town, printed_total; ``fields``: key, field_code, value; ``parcels``: key, parcel_no,
    numerator, denominator; ``floors``: key, floor, area. Null values break no rule, except a missing lot.
    """
    table = rules() if table is None else table
    totals = floor_totals(floors, key).select(F.col(key).alias("_key"), "floor_total")
    levels = {"field": fields, "parcel": parcels, "floor": floors, "document": documents.join(totals, F.col(key) == F.col("_key"), "left").drop("_key")}
    out = None
    for level, rows in levels.items():
        mine = [r for r in table if r.level == level]
        if not mine:
            continue
        found = F.array_compact(F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.coalesce(r.detail.cast("string"), F.lit("")).alias("detail"))) for r in mine]))
        broken = rows.select(key, F.explode(found).alias("_v")).select(key, "_v.rule", "_v.detail")
        out = broken if out is None else out.unionByName(broken)
    return out
