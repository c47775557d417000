"""NST-7, NST-5: field rows put together again to typed documents, and zones taken apart to field rows."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .flatten import SKIPPED

#: Elements of one list that are gathered together before the list is put in order.
SLICE = 1024


def _is_field(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and "value" in kind.names


def _parts(kind: T.StructType, prefix: str = "") -> Iterator[tuple[str, T.DataType]]:
    """Paths of the fields and of the lists of structs below a struct, not going into lists."""
    for f in kind:
        path = f"{prefix}{f.name}"
        if f.name in SKIPPED and not prefix:
            continue
        if _is_field(f.dataType) or isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            yield path, f.dataType
        elif isinstance(f.dataType, T.StructType):
            yield from _parts(f.dataType, path + ".")


def _typed(field: T.StructType) -> Column:
    """A field node of the wanted type from a row; what a row does not have is null."""
    have = {"value", "sources", "needs_review", "confidence"}
    def one(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        col = F.col(f"_f.{f.name}")
        if f.name == "sources" and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            known = ("page", "text")
            return F.transform(col, lambda s: F.struct(*[(s[g.name] if g.name in known else F.lit(None)).cast(g.dataType).alias(g.name) for g in f.dataType.elementType])).alias(f.name)
        return col.try_cast(f.dataType).alias(f.name) if f.name == "value" else col.cast(f.dataType).alias(f.name)
    return F.struct(*[one(f) for f in field])


def _assembled(kind: T.StructType, columns: dict[str, str], prefix: str = "") -> Column:
    """The struct from its parts' columns."""
    out = []
    for f in kind:
        path = f"{prefix}{f.name}"
        if path in columns:
            out.append(F.col(columns[path]).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StructType) and not (f.name in SKIPPED and not prefix):
            out.append(_assembled(f.dataType, columns, path + ".").alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return F.struct(*out)


def _build(rows: DataFrame, kind: T.StructType, by: list[str], depth: int) -> DataFrame:
    """rows(by, _rest, _f) to (by, _node): one struct for each combination of ``by``."""
    parts = list(_parts(kind))
    fields = [(p, t) for p, t in parts if _is_field(t)]
    lists = [(p, t) for p, t in parts if not _is_field(t)]
    columns = {p: f"_p{depth}_{i}" for i, (p, _) in enumerate(parts)}
    pieces = []
    if fields:
        named = rows.filter(F.col("_rest").isin(*[p for p, _ in fields]))
        pieces.append(named.groupBy(*by).agg(*[F.first(F.when(F.col("_rest") == p, _typed(t)), ignorenulls=True).alias(columns[p]) for p, t in fields]))
    at, cut = f"_at{depth}", f"_cut{depth}"
    for path, list_type in lists:
        head = f"{path}."
        rest = F.substring(F.col("_rest"), len(head) + 1, 2**31 - 1)
        inside = rows.filter(F.startswith("_rest", F.lit(head))).withColumn("_tail", rest)
        inside = inside.withColumn(at, F.regexp_extract("_tail", r"^(\d+)\.", 1).try_cast("long")).filter(F.col(at).isNotNull())
        inside = inside.withColumn("_rest", F.regexp_replace("_tail", r"^\d+\.", "")).drop("_tail")
        nodes = _build(inside, list_type.elementType, [*by, at], depth + 1)
        # a long list is gathered slice by slice; only its slices meet in the row of the parent
        sliced = nodes.groupBy(*by, F.floor(F.col(at) / SLICE).alias(cut)).agg(F.array_sort(F.collect_list(F.struct(F.col(at), F.col("_node")))).alias("_slice"))
        whole = sliced.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(cut), F.col("_slice"))), lambda a, b: (a[cut] - b[cut]).cast("int")).alias("_slices"))
        pieces.append(whole.select(*by, F.flatten(F.transform("_slices", lambda s: F.transform(s["_slice"], lambda x: x["_node"]))).alias(columns[path])))
    joined = reduce(lambda a, b: a.join(b, by, "full"), pieces)
    return joined.select(*by, _assembled(kind, columns).alias("_node"))


def renest(rows: DataFrame, kind: T.StructType, key: str = "file_hash") -> DataFrame:
    """NST-7: field rows (key, path, value, sources, needs_review, maybe confidence) to one document per key, of the given type.

    The inverse of ``flatten_fields``: ``flatten_fields(renest(rows, type)) = rows`` for rows that came from documents of that type.
    Lists are put together from the deepest up, in the order of their indexes (gaps close). Values that do not fit their type are
    null; paths that the type does not know are left out, as are rows without a key. Of several rows with one path any one counts.
    """
    extra = [c for c in ("confidence",) if c in rows.columns]
    missing = [F.lit(None).cast("double").alias("confidence")] if not extra else []
    node = F.struct("value", "sources", "needs_review", *extra, *missing)
    held = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col("path").alias("_rest"), node.alias("_f"))
    content = T.StructType([f for f in kind if f.name != key])
    return _build(held, content, ["_key"], 0).select(F.col("_key").alias(key), *[F.col("_node")[f.name].alias(f.name) for f in content])


def zone_rows(zones: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """NST-5: zones(key, zones array<struct<zone_label, needs_review, fields map<code, struct<value, page_no, source_text, needs_review>>>>) to field rows.

    key, zone_no (from 0), zone_label, zone_review (a missing flag asks for a review), code, label (the code where there is none), value, page_no,
    source_text, needs_review. ``labels``: field_code, label. Null zones and fields give no rows.
    """
    each = zones.select(key, F.posexplode("zones").alias("zone_no", "_z")).filter("_z is not null")
    fields = F.filter(F.map_entries("_z.fields"), lambda e: e["value"].isNotNull())
    rows = each.select(key, "zone_no", F.col("_z.zone_label").alias("zone_label"), F.coalesce("_z.needs_review", F.lit(True)).alias("zone_review"), F.explode(fields).alias("_e"))
    rows = rows.select(key, "zone_no", "zone_label", "zone_review", F.col("_e.key").alias("code"), "_e.value.*")
    named = labels.select(F.col("field_code").alias("code"), "label")
    return rows.join(named, "code", "left").withColumn("label", F.coalesce("label", "code"))
