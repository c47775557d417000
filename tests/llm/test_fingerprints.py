"""Fingerprints: what the tables give back is what sets of pieces give."""
from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from shirube.llm import fingerprints
from shirube.llm.queries import QUERIES

from .conftest import BASE, LONG, SCHEMA, rows


def piece_set(text):
    return {(p, i) for p, n in Counter(fingerprints.PIECE.findall(text)).items() for i in range(n)}


def alike(a, b):
    a, b = piece_set(a), piece_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(got, docs):
    """docs: (id, text) in the order of the walk."""
    assert len(got) == len(docs)
    left = list(got)
    for i, (doc_id, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1] or ""
        text = text or ""
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        want = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), pytest.approx(alike(text, edited)), pytest.approx(alike(text, following)))
        fits = [r for r in left if (r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == want]
        assert fits, want
        left.remove(fits[0])
        assert (fits[0].fingerprint == fits[0].edited_fingerprint) == (piece_set(text) == piece_set(edited))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = QUERIES["op13_fingerprints"][0](spark, "/root/testdata/sf0.001").collect()
    check(got, sorted(docs, reverse=True))
    prints = {}
    for r in got:
        prints.setdefault(dict(docs)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_documents(spark, n):
    docs = [(9 - i, f"line {i}\n" * (i + 1) + "end") for i in range(n)]
    check(fingerprints.edited_by_next(spark.createDataFrame(rows(*docs), SCHEMA)).collect(), docs)


def test_odd_rows(spark, odd):
    pairs = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id not in (7, None)]
    check(fingerprints.edited_by_next(odd.where("doc_id <> 7")).collect(), sorted(pairs, key=lambda p: -p[0]))
    assert fingerprints.edited_by_next(odd).count() == odd.count()


def test_one_document_a_range(spark):
    docs = [(i, f"text {i} of one range. and more") for i in range(40, 0, -1)]
    made = spark.createDataFrame(rows(*docs), SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        check(fingerprints.edited_by_next(made).collect(), docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pieces_are_the_text():
    for text in ("", "\n\n..", BASE, LONG, "a. b! c?\n d", "x" * 1000 + ".", "é ſ. K\r\n\t"):
        assert "".join(fingerprints.PIECE.findall(text)) == text


def test_differing_digests_come_back(spark):
    rng = random.Random(1)
    pairs = []
    for i in range(60):
        left = [f"piece {rng.randrange(300)}." for _ in range(rng.randrange(0, 400))]
        right = [p if rng.random() > i / 60 else f"other {rng.randrange(10**6)}." for p in left] + ["tail\n"] * (i % 3)
        pairs.append((i, "".join(left), "".join(right), "clash"))
    pairs += [(None, None, None, None), (61, None, "only right", None), (61, None, "only right", None), (62, LONG, LONG + ".", "x")]
    got = fingerprints.compare_versions(spark.createDataFrame(pairs, "doc_id long, text string, edited string, cells string")).collect()
    assert len(got) == len(pairs)
    by_id = {r.id: r for r in got}
    for i, left, right, _ in pairs:
        l, r = (set(fingerprints.digests([t or ""])[0].view(np.int64).tolist()) for t in (left, right))
        row = by_id[i]
        assert set(row.only_left) == l - r and set(row.only_right) == r - l and row.only_left == sorted(row.only_left)
        assert row.likeness == pytest.approx(alike(left or "", right or ""))
        alone = fingerprints.difference_of(row.fingerprint, row.other_fingerprint)
        if row.cells == fingerprints.CELLS:
            assert alone is not None
        if alone is not None:
            assert {k - (1 << 64) if k >> 63 else k for k in alone[0]} == l - r
    assert {r.cells for r in got} >= {24, 96, 384}
    empty = spark.createDataFrame([], "doc_id string, text string, edited string")
    assert fingerprints.compare_versions(empty).count() == 0


def test_set_difference_where_tables_never_peel(monkeypatch):
    monkeypatch.setattr(fingerprints, "peel", lambda t, n, cells: (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n, bool)))
    left, right = fingerprints.digests(["a. b. c.", "same"]), fingerprints.digests(["a. x. c.", "same"])
    pair, keys, side, cells = fingerprints.differences(left, np.arange(2), right, np.arange(2))
    assert sorted(side.tolist()) == [-1, 1] and pair.tolist() == [0, 0] and not cells.any()
