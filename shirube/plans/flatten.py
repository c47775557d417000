"""PRJ-1: nested documents to field rows, driven by their schema."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SKIPPED = ("history", "metadata", "corrections", "warnings", "review_fields")
ROWS = "array<struct<path:string,value:string,sources:array<struct<page:int,text:string>>,needs_review:boolean>>"


def _leaves(node: Column, kind: T.DataType, path: Column) -> Column | None:
    """Array of field rows below a node; a struct with ``value`` is a field, lists add their index."""
    if isinstance(kind, T.StructType) and "value" in kind.names:
        review = F.coalesce(node["needs_review"], F.lit(False)) if "needs_review" in kind.names else F.lit(False)
        sources = F.transform(node["sources"], lambda s: F.struct(s["page"].cast("int").alias("page"), s["text"].alias("text")))
        return F.array(F.struct(path.alias("path"), node["value"].cast("string").alias("value"), sources.alias("sources"), review.alias("needs_review"))).cast(ROWS)
    if isinstance(kind, T.StructType):
        parts = [_leaves(node[f.name], f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind if f.name not in SKIPPED]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        each = F.transform(node, lambda x, i: _leaves(x, kind.elementType, F.concat(path, F.lit("."), i.cast("string"))))
        return F.coalesce(F.flatten(each), F.array().cast(ROWS))
    return None


def flatten_fields(docs: DataFrame, key: str = "file_hash") -> DataFrame:
    """One row per field: key, path, value, sources, needs_review. Each document is read once."""
    parts = [_leaves(F.col(f.name), f.dataType, F.lit(f.name)) for f in docs.schema if f.name not in (key, *SKIPPED)]
    found = F.concat(*[p for p in parts if p is not None])
    return docs.select(key, F.explode(found).alias("_f")).select(key, "_f.*")
