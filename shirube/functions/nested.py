"""Nested documents: values at paths, and expressions made from a type (NST-1, NST-2, SRC-4).

The generators walk a Spark type once, while the plan is built, and return one column. ``bound`` names a value inside an expression, so
a deep document is not taken apart again for every leaf.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from .evidence import TRUST_LEVEL

SOURCE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("source_pdf", T.StringType()), T.StructField("file_hash", T.StringType())])
SOURCES = T.ArrayType(SOURCE)
NOT_CONTENT = ("sources", "needs_review", "metadata")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` on a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


# ---- NST-1 ----------------------------------------------------------------------------------------

def _json_path(path: Column, indexes: bool) -> Column:
    def step(part: Column) -> Column:
        key = F.when(F.contains(part, F.lit('"')), F.concat(F.lit("['"), part, F.lit("']"))).otherwise(F.concat(F.lit('["'), part, F.lit('"]')))
        return F.when(part.rlike("^[0-9]+$"), F.concat(F.lit("["), part, F.lit("]"))).otherwise(key) if indexes else key
    return F.concat(F.lit("$"), F.array_join(F.transform(F.split(path, "\\."), step), ""))


def at_path(doc: Column, path: Column, kind: str = "variant") -> Column:
    """NST-1: what stands at a dotted path of a VARIANT, the path being a column; null where the path leads nowhere.

    A part of digits is an index where it meets a list, else a key.
    """
    plain = F.try_variant_get(doc, _json_path(path, False), kind)
    digits = path.rlike(r"(?:^|\.)[0-9]+(?:\.|$)")
    return F.when(path.isNull() | (path == ""), F.lit(None).cast(kind)).when(digits, F.coalesce(F.try_variant_get(doc, _json_path(path, True), kind), plain)).otherwise(plain)


def value_at(doc: Column, path: Column, kind: str = "string") -> Column:
    """NST-1: the value of the field node at a path."""
    return at_path(doc, F.concat(path, F.lit(".value")), kind)


# ---- NST-2 ----------------------------------------------------------------------------------------

def strip(node: Column, kind: T.DataType) -> Column:
    """The values of a document alone: field nodes become their value, evidence and flags go."""
    if isinstance(kind, T.StructType):
        if "value" in kind.names:
            return node["value"]
        parts = [strip(node[f.name], f.dataType).alias(f.name) for f in kind if f.name not in NOT_CONTENT]
        return F.when(node.isNotNull(), F.struct(*parts)) if parts else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(node, lambda x: strip(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(node, lambda k, _: ~k.isin(*NOT_CONTENT)), lambda _, v: strip(v, kind.valueType))
    return node


def _as_source(source: Column, kind: T.StructType) -> Column:
    return F.struct(*[(source[f.name] if f.name in kind.names else F.lit(None)).cast(f.dataType).alias(f.name) for f in SOURCE])


def sources_of(node: Column, kind: T.DataType) -> Column:
    """All sources of a document, a node's own before those below it."""
    none = F.array().cast(SOURCES)
    if isinstance(kind, T.StructType):
        parts = []
        for f in sorted(kind, key=lambda f: f.name != "sources"):
            if f.name == "sources" and isinstance(f.dataType, T.ArrayType):
                own = f.dataType.elementType
                parts.append(F.transform(node["sources"], lambda s: _as_source(s, own)))
            elif f.name not in ("sources", "metadata") and isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
                parts.append(sources_of(node[f.name], f.dataType))
        return F.concat(*[F.coalesce(p, none) for p in parts]) if parts else none
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.flatten(F.transform(node, lambda x: sources_of(x, kind.elementType))), none)
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)):
        inner = F.map_filter(node, lambda k, _: ~k.isin("sources", "metadata"))
        return F.coalesce(F.flatten(F.transform(F.map_values(inner), lambda x: sources_of(x, kind.valueType))), none)
    return none


def is_uncertain(node: Column, kind: T.DataType, level: float = TRUST_LEVEL) -> Column:
    """Whether anything in a document asks for a review or was read with too little confidence."""
    no = F.lit(False)
    if isinstance(kind, T.StructType):
        tests = []
        for f in kind:
            if f.name == "needs_review":
                tests.append(node[f.name].cast("boolean"))
            elif f.name == "confidence":
                tests.append(node[f.name] < level)
            elif f.name not in ("sources", "metadata") and isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
                tests.append(is_uncertain(node[f.name], f.dataType, level))
        out = no
        for t in tests:
            out = out | F.coalesce(t, no)
        return out
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(node, lambda x: is_uncertain(x, kind.elementType, level)), no)
    if isinstance(kind, T.MapType):
        inner = F.map_filter(node, lambda k, _: ~k.isin("sources", "metadata"))
        return F.coalesce(F.exists(F.map_values(inner), lambda x: is_uncertain(x, kind.valueType, level)), no)
    return no


# ---- SRC-4 ----------------------------------------------------------------------------------------

FAULT = "struct<path:string,reason:string>"
_INTEGERS, _NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType, T.DecimalType)


def first_fault(doc: Column, kind: T.DataType, nullable: bool = False, path: Column | None = None) -> Column:
    """SRC-4: (path, reason) of the first place where a VARIANT breaks a closed type; null where it fits.

    A struct has exactly its keys, a field is null only if its type says so, numbers are finite. Reasons: type, keys, not finite.
    Maps are objects with free keys. Fields are looked at in the order of the type, a struct's keys before what is below them.
    """
    path = F.lit("root") if path is None else path
    none, fault = F.lit(None).cast(FAULT), lambda reason: F.struct(path.alias("path"), F.lit(reason).alias("reason"))
    shape = F.coalesce(F.schema_of_variant(doc), F.lit("MISSING"))

    def body(shape: Column) -> Column:
        if isinstance(kind, T.StructType):
            def members(held: Column) -> Column:
                expected, keys = F.array(*[F.lit(n) for n in kind.names]), F.map_keys(held)
                wrong = (F.size(F.array_except(keys, expected)) > 0) | (F.size(F.array_except(expected, keys)) > 0)
                below = [first_fault(F.try_element_at(held, F.lit(f.name)), f.dataType, f.nullable, F.concat(path, F.lit("." + f.name))) for f in kind]
                return F.when(wrong, fault("keys")).otherwise(F.coalesce(*below, none))
            return F.when(F.startswith(shape, F.lit("OBJECT")), bound(F.try_variant_get(doc, F.lit("$"), "map<string,variant>"), members)).otherwise(fault("type"))
        if isinstance(kind, (T.ArrayType, T.MapType)):
            is_map = isinstance(kind, T.MapType)
            inner, loose = (kind.valueType, kind.valueContainsNull) if is_map else (kind.elementType, kind.containsNull)
            if is_map:
                items = F.map_entries(F.try_variant_get(doc, F.lit("$"), "map<string,variant>"))
                faults = F.transform(items, lambda e: first_fault(e["value"], inner, loose, F.concat(path, F.lit("."), e["key"])))
            else:
                items = F.try_variant_get(doc, F.lit("$"), "array<variant>")
                faults = F.transform(items, lambda x, i: first_fault(x, inner, loose, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            first = F.try_element_at(F.filter(faults, lambda f: f.isNotNull()), F.lit(1))
            return F.when(F.startswith(shape, F.lit("OBJECT" if is_map else "ARRAY")), first).otherwise(fault("type"))
        if isinstance(kind, (*_INTEGERS, *_NUMBERS)):
            whole = (shape == "BIGINT") | shape.rlike(r"^DECIMAL\(\d+,0\)$")
            fits = whole if isinstance(kind, _INTEGERS) else whole | shape.rlike("^(?:DECIMAL|DOUBLE|FLOAT)")
            number = F.try_variant_get(doc, F.lit("$"), "double")
            return F.when(~fits, fault("type")).when(F.isnan(number) | (F.abs(number) == float("inf")), fault("not finite"))
        name = "BOOLEAN" if isinstance(kind, T.BooleanType) else "STRING"
        return F.when(shape != name, fault("type"))

    checked = bound(shape, body)
    return F.when(shape == "VOID", none if nullable else fault("type")).otherwise(checked)
