"""Whitening of embeddings that are fitted on distinct vectors.

Equal vectors are grouped first, so a vector that a third of all rows hold is one row with a count from there on. The fit weighs every
distinct vector by one, or by its count. Its sums are exact integers; the covariance is a sum of products of centred blocks, one
small matrix for each task, added up by Spark. The eigenvectors of that matrix, whose size depends on the dimensions alone, are found
by the driver. Each distinct vector is then projected once and joined back to the rows that hold it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

#: Entries of at most this size keep the grid exact in 64 bits.
LARGEST = float(1 << 50)


def grid(vector: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * c) + offset of every entry c, exact."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(offset).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor empty, and no entry is null, not finite or beyond ``LARGEST``."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST)), F.lit(False))


def _matrix(column: pa.ListArray, dtype: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: dimension and exact weighted sum; dimension -1 carries the sum of the weights."""
    total, weight = None, 0
    for batch in batches:
        if batch.num_rows:
            x, w = _matrix(batch.column(0), np.int64), batch.column(1).to_numpy()
            safe = int(np.abs(x).max()) * int(w.sum()) < 1 << 62
            part = (x * w[:, None]).sum(axis=0) if safe else (x.astype(object) * w[:, None].astype(object)).sum(axis=0)
            total = part.astype(object) if total is None else total + part
            weight += int(w.sum())
    if total is not None:
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, len(total)), pa.int32()), "s": pa.array([str(weight), *map(str, total)])})


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n*x - S, exact (int64, or Python integers where those would overflow), and the same over n in double precision."""
    safe = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums)) < 1 << 62
    exact = x * np.int64(n) - np.array(sums, np.int64) if safe else x.astype(object) * n - np.array(sums, object)
    return exact, (exact / n).astype(np.float64)


def _deviation(exact: np.ndarray) -> pa.Array:
    """Sums of squares, exact."""
    if exact.dtype != object and int(np.abs(exact).max(initial=0)) ** 2 * exact.shape[1] < 1 << 62:
        return pa.array(np.einsum("ij,ij->i", exact, exact)).cast(pa.decimal128(38, 0))
    from decimal import Decimal
    return pa.array([Decimal(sum(int(v) ** 2 for v in row)) for row in exact.tolist()], pa.decimal128(38, 0))


def _scatter(rows: DataFrame, centre: np.ndarray | None, n: int, sums: list[int] | None) -> np.ndarray:
    """Sum over rows(v, w) of w * (v - centre)(v - centre)', for integer vectors by n and S, for doubles by their means."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0), np.float64) - centre if sums is None else centred(_matrix(batch.column(0), np.int64), n, sums)[1]
                part = (v * batch.column(1).to_numpy()[:, None]).T @ v
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    cells = rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # dimensions squared, at most
    size = 1 + max(c.j for c in cells)
    out = np.zeros((size, size))
    for c in cells:
        out[c.i, c.j] = out[c.j, c.i] = c.s
    return out


def _project(distinct: DataFrame, n: int, sums: list[int], weights: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                exact, v = centred(_matrix(batch.column(2), np.int64), n, sums)
                white = v @ weights
                ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), _deviation(exact), pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], names=["a", "b", "n_rows", "deviation", "white"])

    return distinct.select("a", "b", "x", "n_rows").mapInArrow(run, "a long, b long, n_rows long, deviation decimal(38,0), white array<double>")


SCHEMA = "vec_id %s, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, by_count: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row and component: vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    Vectors are taken on an integer grid (``grid``). The fit weighs every distinct one by one, or by its rows with ``by_count``; n is
    the sum of the weights. Components beyond the rank of the vectors (eigenvalue at most 1e-12 of the trace) are left out, as
    nothing can be divided by their spread: with one distinct vector there are no rows. Rows whose vector is null or empty, or holds
    entries that are null, not finite or beyond 2^50, are dropped, as are vectors whose length is not the most frequent one
    (the longer of two). Repeated ids and equal vectors give rows of their own; ids may be null. Other columns are ignored, whatever
    their names. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v")).where(usable(F.col("v")))
    found = rows.select(F.size("v").alias("d")).groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], SCHEMA % rows.schema["id"].dataType.simpleString())
    if found is None:
        return empty
    keyed = rows.where(F.size("v") == found.d).select("id", grid(F.col("v")).alias("x")).select("id", "x", F.xxhash64("x").alias("a"), F.xxhash64(F.reverse("x"), F.lit(1)).alias("b"))
    distinct = stored(keyed.groupBy("a", "b", "x").agg(F.count("*").alias("n_rows")))
    weight = F.col("n_rows") if by_count else F.lit(1).cast("long")
    fit = distinct.select(F.col("x").alias("v"), weight.alias("w"))
    parts = fit.mapInArrow(_sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # one row a dimension
    n, *sums = (int(p.s) for p in parts)
    covariance = _scatter(fit, None, n, sums) / n
    values, axes = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = [int(k) for k in np.argsort(-values, kind="stable")[:components] if values[k] > max(trace, 0) * 1e-12]
    if not order:
        return empty
    white = stored(_project(distinct, n, sums, axes[:, order] / np.sqrt(values[order])))
    fitted = white.select(F.col("white").alias("v"), (F.col("n_rows") if by_count else F.lit(1).cast("long")).alias("w"))
    means = {r.i: r.s / n for r in fitted.select(F.posexplode("v").alias("i", "c"), "w").groupBy("i").agg(F.sum(F.col("c") * F.col("w")).alias("s")).collect()}
    spread = _scatter(fitted, np.array([means[i] for i in range(len(order))]), n, None) / n
    error = float(np.abs(spread - np.eye(len(order))).max())
    explained = F.array(*[F.lit(float(values[k] / trace)) for k in order])
    held = spread_join(keyed.select("id", "a", "b"), white.select("a", "b", "n_rows", "deviation", "white"), ["a", "b"], "n_rows")
    return held.select("id", "deviation", F.posexplode("white").alias("k", "whitened")).select(
        F.col("id").alias("vec_id"), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"))
