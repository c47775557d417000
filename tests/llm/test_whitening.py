"""Whitening against NumPy on the whole list of distinct vectors."""
from __future__ import annotations

import math
import random

import numpy as np
import pytest

from shirube.llm import common, whitening
from shirube.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, a long, b long, x string, v string, id string, n_rows int, white string"


def plain(vectors, components=16, by_count=False):
    """vec_id, vector pairs to (id, component) -> whitened up to its sign, n, explained, deviation of each id."""
    grid = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in vectors}
    distinct = sorted(set(grid.values()))
    counts = [sum(g == d for g in grid.values()) if by_count else 1 for d in distinct]
    n, x = sum(counts), np.array(distinct, np.int64)
    sums = (x * np.array(counts)[:, None]).sum(axis=0)
    c = (x * n - sums) / n
    cov = (c * np.array(counts)[:, None]).T @ c / n
    e, axes = np.linalg.eigh(cov)
    order = [k for k in np.argsort(-e)[:components] if e[k] > e.sum() * 1e-12]
    white = {i: ((np.array(g) * n - sums) / n) @ (axes[:, order] / np.sqrt(e[order])) for i, g in grid.items()}
    deviation = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(g, sums)) for i, g in grid.items()}
    return n, white, [e[k] / e.sum() for k in order], deviation


def check(got, vectors, **options):
    n, white, explained, deviation = plain(vectors, **options)
    rows = got.collect()
    assert len(rows) == len(vectors) * len(explained)
    for k in range(len(explained)):
        mine = [r for r in rows if r.component == k + 1]
        a = np.array([r.whitened for r in mine])
        b = np.array([white[r.vec_id][k] for r in mine])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert {(r.n, r.identity_error < 1e-9, abs(r.explained / explained[k] - 1) < 1e-9) for r in mine} == {(n, True, True)}
    assert all(int(r.deviation) == deviation[r.vec_id] for r in rows)


def frame(spark, pairs):
    return spark.createDataFrame([(i, v, 1, 2, "clash", "clash", "clash", 3, "clash") for i, v in pairs], SCHEMA)


def test_query(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = QUERIES["op12_whitening"][0](spark, "/root/testdata/sf0.01")
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    check(got, vectors)


@pytest.mark.parametrize("by_count", [False, True])
def test_copies_of_one_vector(spark, by_count, monkeypatch):
    monkeypatch.setattr(common, "FREQUENT", 3)
    rng = random.Random(3)
    some = [[rng.gauss(0, s) for s in (3, 2, 1.5, 1, 0.5)] for _ in range(40)]
    vectors = [(i, some[i % 40] if i % 3 else some[0]) for i in range(300)]
    check(whitening.whiten(frame(spark, vectors), by_count=by_count), vectors, by_count=by_count)


def test_odd_vectors(spark):
    rng = random.Random(5)
    good = [(i, [rng.gauss(0, 2), rng.gauss(4, 1), 0.0]) for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0])]
    got = whitening.whiten(frame(spark, good + bad)).collect()
    assert {r.vec_id for r in got} == {i for i, _ in good} and {r.component for r in got} == {1, 2}
    check(whitening.whiten(frame(spark, good + bad)), good)
    repeated = whitening.whiten(frame(spark, good + [good[0], (None, good[1][1])])).collect()
    assert len([r for r in repeated if r.vec_id == 0]) == 4 and len([r for r in repeated if r.vec_id is None]) == 2


def test_nothing_to_fit(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_exact_beyond_64_bits():
    x = np.array([[1 << 55, -(1 << 55)], [3, 4]], np.int64)
    sums = [int(v) for v in x.astype(object).sum(axis=0)]
    exact, _ = whitening.centred(x, 2, sums)
    got = whitening._deviation(exact).to_pylist()
    assert [int(v) for v in got] == [sum((2 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    exact, double = whitening.centred(x * 4, 1 << 9, [int(v) * 4 for v in sums])
    assert exact.dtype == object and double.dtype == np.float64
