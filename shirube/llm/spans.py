"""Spans found in texts: their order, their digest, and the columns the span queries return."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Span = tuple[str, int, int]


def printed(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, then end; comma-joined."""
    rank = {kind: i for i, kind in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(set(spans), key=lambda x: (x[1], rank[x[0]], x[2])))


def digest(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(printed(spans, kinds).encode()).hexdigest()


def scan_texts(docs: DataFrame, find: Callable[[str], tuple[list[Span], list[Span]]], base: tuple[str, ...], kinds: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, n_<kind> for each base kind, base_sha256, spans.

    ``find`` gives a text's base spans and its further spans. Rows go through in Arrow batches and nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans")}
            out["doc_id"] = batch.column(0)
            for text in batch.column(1):
                own, more = find(text.as_py() or "")
                for kind in base:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in own))
                out["base_sha256"].append(digest(own, base))
                out["spans"].append(printed([*own, *more], kinds))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([pa.field("doc_id", batch.column(0).type), *(pa.field(f"n_{k}", pa.int64()) for k in base), pa.field("base_sha256", pa.string()), pa.field("spans", pa.string())]))

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in base) + ", base_sha256 string, spans string"
    return rows.mapInArrow(run, schema)
