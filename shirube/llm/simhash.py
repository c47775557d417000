"""SimHash fingerprints linked by covering locality-sensitive hashing.

Masks. Give bit i of a fingerprint the vector p(i) = 1 + i mod (2^(r+1) - 1) in GF(2)^(r+1), never zero, and let the mask of a
non-zero v keep the bits with <p(i), v> = 1. If two fingerprints differ in at most r bits, their r vectors span less than the
whole space, so some v is orthogonal to all of them, and the mask of that v keeps none of the bits that differ: the pair shares
a bucket in the table of v. With 2^(r+1) - 1 tables no pair within the radius is missed.

Buckets. Pairs in a bucket are not listed. Two fingerprints at most 2 bits apart meet in a value that each turns into by at
most one flip, and whatever turns into one value by at most one flip is at most 2 bits apart. So each member of a bucket that
is not alone there lists itself and its flips of the bits outside the mask, and members with a common value are linked to the
smallest of them: a fixed number of rows for each member, however many there are.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

BITS = 64
SEED = 42


def masks(radius: int) -> list[int]:
    """The covering masks of a radius, as signed 64-bit integers."""
    top = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, top + 1):
        mask = sum(1 << i for i in range(BITS) if ((1 + i % top) & v).bit_count() & 1)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit the majority of the hashes (uint64), strictly more than half; signed 64-bit."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at:at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def shingle_hashes(text: str, shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included; of the whole sequence where there are fewer words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[b:e], seed) for b, e in zip(begins[:len(words) - n + 1].tolist(), ends[n - 1:].tolist())), np.uint64, len(words) - n + 1)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) of every row; null text counts as empty, and a text without words has fingerprint zero."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py() or "", shingle, seed)) for t in batch.column(1)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def links(values: DataFrame, radius: int = 2) -> DataFrame:
    """values(fp long, distinct) to edges (u, v) whose components are those of all pairs at most ``radius`` bits apart.

    Every edge is itself such a pair. The radius is 2; see the module's text.
    """
    if radius != 2:
        raise ValueError("a common flip proves a distance of 2")
    cover = masks(radius)
    tables = values.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(cover)])).alias("b")).select("fp", "b.t", "b.key")
    shared = tables.groupBy("t", "key").count().where("count > 1").drop("count")
    members = tables.join(shared, ["t", "key"]).select("fp", "t")
    outside = F.array(*[F.array(*[F.lit(b).cast("int") for b in range(BITS) if not m >> b & 1]) for m in cover])
    flips = F.concat(F.array(F.col("fp")), F.transform(F.element_at(outside, F.col("t") + 1), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    meeting = members.select("fp", F.explode(flips).alias("z")).distinct()
    stars = meeting.groupBy("z").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").select(F.col("z").alias("at"), "low")
    return meeting.join(stars, F.col("z") == F.col("at")).where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()


def near_copies(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Texts without words share fingerprint zero, which links like any other. Rows that repeat an id or a text get rows of their
    own. Null ids stay null and never become a component's id, unless a component has no other. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = stored(fingerprints(docs, shingle, seed, id_col, text_col))
    values = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    stars = components(links(values.select("fp"), radius))
    rooted = values.join(stars, values["fp"] == stars["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select(F.col("fp").alias("_fp"), "root").join(lowest, "root").select("_fp", "component_id")
    return rows.join(named, rows["fp"] == named["_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
