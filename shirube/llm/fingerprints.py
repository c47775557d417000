"""Fingerprints of documents that can be subtracted: invertible Bloom lookup sketches of hashed paragraphs.

Pieces. A text is cut at line feeds and sentence ends, and after 256 characters without either; the pieces joined are the text. The
digest of a piece also counts its occurrence in the text, so that a text is a set of digests and repeated pieces do not cancel.

Sketch. Every digest is added to one cell in each of three parts of a table: a count, a sum of digests and a sum of their check
values, all modulo 2^64. Subtracting two tables removes what both texts have. A cell that is left with one digest (count of one
either way, check value right) gives it away; taking it out of its other cells frees further ones, until all differing digests
are known. Where that stops early the pair is sketched again in a table four times as large, from the whole texts; a table with
room for all digests of both that still does not peel gives way to an exact set difference. All pairs of a batch are peeled together.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Cells of the published fingerprint; a multiple of 3.
CELLS = 24
PIECE = re.compile(r"[^\n.!?]{1,256}[.!?\s]*|[.!?\n][.!?\s]*")
#: Characters that a task looks at together, at least one text. It bounds the arrays, not the texts.
_TOGETHER = 4_000_000
_CELLS_AT_ONCE = 1 << 20
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The digests of all pieces, and the text (0, 1, ...) of each, in the order of the texts."""
    hashed = [[xxhash.xxh3_64_intdigest(p) for p in PIECE.findall(t)] for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(h) for h in hashed])
    plain = np.fromiter((d for h in hashed for d in h), np.uint64, len(owner))
    order = np.lexsort((plain, owner))
    plain, owner = plain[order], owner[order]
    first = np.ones(len(owner), bool)
    first[1:] = (plain[1:] != plain[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(owner))
    occurrence = place - np.maximum.accumulate(np.where(first, place, 0))
    return _mix(plain + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), owner


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys + np.uint64(0xD1B54A32D192ED03))


def _places(keys: np.ndarray, owner: np.ndarray, cells: int) -> list[np.ndarray]:
    part = cells // 3
    return [owner * cells + j * part + (_mix(keys ^ np.uint64(0xA0761D6478BD642F * (j + 1) + cells & 0xFFFFFFFFFFFFFFFF)) % np.uint64(part)).astype(np.int64) for j in range(3)]


def sketches(keys: np.ndarray, owner: np.ndarray, n: int, cells: int = CELLS) -> np.ndarray:
    """Tables of n texts: (3, n x cells) of counts, sums of digests, sums of check values."""
    out = np.zeros((3, n * cells), np.uint64)
    check = _check(keys)
    for place in _places(keys, owner, cells):
        np.add.at(out[0], place, np.uint64(1))
        np.add.at(out[1], place, keys)
        np.add.at(out[2], place, check)
    return out


def peel(table: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Takes the digests out of n subtracted tables: owner, digest and side (1 left, -1 right) of each, and which tables are empty now."""
    count, sums, checks = table.copy()
    owners, keys, sides = [], [], []
    watch = np.flatnonzero(count)
    for _ in range(cells):  # every round that goes on takes out at least one digest
        c = count[watch]
        negative = c == _ALL
        watch, negative = watch[(c == 1) | negative], negative[(c == 1) | negative]
        k = np.where(negative, np.uint64(0) - sums[watch], sums[watch])
        right = np.where(negative, np.uint64(0) - checks[watch], checks[watch]) == _check(k)
        k, own, negative = k[right], watch[right] // cells, negative[right]
        if not len(k):
            break
        order = np.lexsort((k, own))
        k, own, negative = k[order], own[order], negative[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (own[1:] != own[:-1])
        k, own, negative = k[new], own[new], negative[new]
        one = np.where(negative, _ALL, np.uint64(1))
        places = _places(k, own, cells)
        for place in places:
            np.subtract.at(count, place, one)
            np.subtract.at(sums, place, k * one)
            np.subtract.at(checks, place, _check(k) * one)
        watch = np.concatenate(places)  # a cell may stand there twice, which the order above undoes
        owners.append(own)
        keys.append(k)
        sides.append(np.where(negative, -1, 1))
    left = count.reshape(n, cells).any(axis=1) | sums.reshape(n, cells).any(axis=1)
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), ~left
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(sides), ~left


def _begins(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


def _rows(begins: np.ndarray, wanted: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the wanted texts, owned by their place in ``wanted``."""
    sizes = begins[wanted + 1] - begins[wanted]
    ends = np.cumsum(sizes)
    at = np.repeat(begins[wanted] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return keys[at], np.repeat(np.arange(len(wanted)), sizes)


def differences(left: tuple[np.ndarray, np.ndarray], a: np.ndarray, right: tuple[np.ndarray, np.ndarray], b: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Differing digests of the pairs (text a[i] of the left, text b[i] of the right): pair, digest and side of each, and the cells that each pair needed (0: set difference)."""
    (lk, lo), (rk, ro) = left, right
    lb, rb = _begins(lo, int(a.max(initial=-1)) + 1), _begins(ro, int(b.max(initial=-1)) + 1)
    total = (lb[a + 1] - lb[a]) + (rb[b + 1] - rb[b])
    pairs, keys, sides, needed = [], [], [], np.zeros(len(a), np.int64)
    pending = np.arange(len(a))
    while len(pending):
        failed = []
        step = max(1, _CELLS_AT_ONCE // cells)
        for at in range(0, len(pending), step):
            these = pending[at:at + step]
            n = len(these)
            table = sketches(*_rows(lb, a[these], lk), n, cells) - sketches(*_rows(rb, b[these], rk), n, cells)
            own, k, side, ok = peel(table, n, cells)
            good = ok[own]
            pairs.append(these[own[good]])
            keys.append(k[good])
            sides.append(side[good])
            needed[these[ok]] = cells
            failed.append(these[~ok])
        pending = np.concatenate(failed)
        full = cells > 16 * total[pending]
        for i in pending[full]:
            l, r = lk[lb[a[i]]:lb[a[i] + 1]], rk[rb[b[i]]:rb[b[i] + 1]]
            for some, side in ((np.setdiff1d(l, r), 1), (np.setdiff1d(r, l), -1)):
                pairs.append(np.full(len(some), i))
                keys.append(some)
                sides.append(np.full(len(some), side))
        pending = pending[~full]
        cells *= 4
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *pairs]), np.concatenate([none.astype(np.uint64), *keys]), np.concatenate([none, *sides]), needed


def likeness(left: np.ndarray, right: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Shared digests over all digests, from the sizes of both sets and the number of differing digests; two empty sets are alike."""
    both = left + right
    return np.where(both == 0, 1.0, (both - differing) / np.maximum(both + differing, 1))


def packed(table: np.ndarray, n: int, cells: int = CELLS) -> list[bytes]:
    """Tables as bytes: the little-endian counts (32 bits), sums (64) and check values (32). Fingerprints are these in base64."""
    count, sums, checks = (t.reshape(n, cells) for t in table)
    parts = [count.astype("<u4").view(np.uint8), sums.astype("<u8").view(np.uint8), checks.astype("<u4").view(np.uint8)]
    return [row.tobytes() for row in np.concatenate([p.reshape(n, p.size // max(n, 1)) for p in parts], axis=1)]


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.base64(f.name) for f in df.schema if f.dataType.simpleString() == "binary"})


@np.errstate(over="ignore")
def difference_of(left: str, right: str, cells: int = CELLS) -> tuple[set[int], set[int]] | None:
    """The digests that only the left and only the right text has, from two fingerprints alone; None where they hold too many."""
    tables = []
    for text in (left, right):
        raw = base64.b64decode(text)
        tables.append((np.frombuffer(raw, "<i4", cells).astype(np.int64), np.frombuffer(raw, "<u8", cells, 4 * cells), np.frombuffer(raw, "<u4", cells, 12 * cells)))
    (lc, ls, lh), (rc, rs, rh) = tables
    count, sums, checks = lc - rc, ls - rs, lh - rh
    found: dict[int, set[int]] = {1: set(), -1: set()}
    low = np.uint64(0xFFFFFFFF)
    while True:  # one digest a round
        for at in np.flatnonzero(np.abs(count) == 1):
            side = int(count[at])
            key = np.array([sums[at] if side > 0 else -sums[at]], np.uint64)
            check = (_check(key)[0] & low).astype(np.uint32)
            if check == (checks[at] if side > 0 else -checks[at]) and int(key[0]) not in found[side]:
                found[side].add(int(key[0]))
                for place in _places(key, np.zeros(1, np.int64), cells):
                    count[place] -= side
                    sums[place] -= key * np.uint64(side & 0xFFFFFFFFFFFFFFFF)
                    checks[place] -= check if side > 0 else -check
                break
        else:
            return (found[1], found[-1]) if not count.any() and not sums.any() else None


def _slices(lengths: list[int]) -> Iterator[slice]:
    at = held = 0
    for i, n in enumerate(lengths):
        if i > at and held + n > _TOGETHER:
            yield slice(at, i)
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield slice(at, len(lengths))


_SIGNED = np.int64


def compare_versions(versions: DataFrame, id_col: str = "doc_id", left_col: str = "text", right_col: str = "edited", cells: int = CELLS) -> DataFrame:
    """One row per row: id, fingerprint and other_fingerprint, only_left and only_right (arrays of digests, signed and ascending),
    likeness (0 to 1) and cells (size of the table that told the digests, 0 for a set difference).

    Null texts are empty; two empty texts are alike. Null and repeated ids give rows of their own. Other columns are ignored,
    whatever their names; an empty table gives no rows. Memory grows with the longest text, not with the table.
    """
    rows = versions.select(versions[id_col].alias("id"), versions[left_col].alias("l"), versions[right_col].alias("r"))
    schema = "id %s, fingerprint binary, other_fingerprint binary, only_left array<long>, only_right array<long>, likeness double, cells long" % rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lefts, rights = ([t or "" for t in batch.column(i).to_pylist()] for i in (1, 2))
            for part in _slices([len(x) + len(y) for x, y in zip(lefts, rights)]):
                left, right = digests(lefts[part]), digests(rights[part])
                n = part.stop - part.start
                every = np.arange(n)
                pair, key, side, needed = differences(left, every, right, every, cells)
                order = np.lexsort((key.view(_SIGNED), pair))
                pair, key, side = pair[order], key[order].view(_SIGNED), side[order]
                sides = []
                for s in (1, -1):
                    ends = np.searchsorted(pair[side == s], np.arange(n + 1)).astype(np.int32)
                    sides.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(key[side == s])))
                near = likeness(np.bincount(left[1], minlength=n), np.bincount(right[1], minlength=n), np.bincount(pair, minlength=n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), pa.array(packed(sketches(*left, n, cells), n, cells)), pa.array(packed(sketches(*right, n, cells), n, cells)), *sides, pa.array(near), pa.array(needed)], names=["id", "fingerprint", "other_fingerprint", "only_left", "only_right", "likeness", "cells"])

    return _as_text(rows.mapInArrow(run, schema))


NEXT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_END_SCHEMA = pa.schema([("part", pa.int64()), ("end", pa.int64()), ("id", pa.int64()), ("t", pa.string())])
_DDL = {"int64": "long", "string": "string", "double": "double", "binary": "binary"}


def _ddl(schema: pa.Schema, prefix: str = "") -> str:
    return ", ".join(f"{prefix}{f.name} {_DDL[str(f.type)]}" for f in schema)


def with_next(docs: DataFrame, work: Callable[[list, list[str], list[str]], list[list]], schema: pa.Schema, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``work`` on each document and the next one by descending id (nulls last; equal ids by a hash of their texts); the first follows the last.

    Documents move once, by ranges of ids, and are walked in order; only the first and last of each range wait to be paired with their
    neighbours, by a join on the number of the range. ``work`` takes ids, texts and next texts and gives the columns of ``schema``.
    """
    order = [F.desc_nulls_last("id"), F.col("h")]
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    both = pa.schema([*_END_SCHEMA, *(pa.field(f"r_{f.name}", f.type) for f in schema)])

    def filled(n: int, columns: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in both], schema=both)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            first = first or (ids[0], texts[0])
            if held:
                ids, texts = [held[0], *ids], [held[1], *texts]
            for some in _slices([len(t) for t in texts[:-1]]):
                yield filled(some.stop - some.start, {f"r_{f.name}": c for f, c in zip(schema, work(ids[some], texts[some], texts[some.start + 1:some.stop + 1]))})
            held = ids[-1], texts[-1]
        if held:
            part = TaskContext.get().partitionId()
            yield filled(2, {"part": [part, part], "end": [0, 1], "id": [first[0], held[0]], "t": [first[1], held[1]]})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (c.to_pylist() for c in batch.columns)
            for some in _slices([len(t) for t in texts]):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, work(ids[some], texts[some], following[some]))], schema=schema)

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "t")
    walked = stored(ranged.mapInArrow(walk, _ddl(both)))
    heads = walked.where("end = 0").select(F.col("part").alias("head_part"), F.col("t").alias("next"))
    tails = walked.where("end = 1").select("part", "id", "t")
    parts = walked.where("end = 0").select(F.col("part").alias("own"), F.lead("part").over(Window.orderBy("part")).alias("after"), F.min("part").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lowest"))  # one row for each range
    met = tails.join(parts, F.col("part") == F.col("own")).join(heads, F.coalesce("after", "lowest") == F.col("head_part")).select("id", "t", "next")
    return walked.where("end is null").select(*[F.col(f"r_{f.name}").alias(f.name) for f in schema]).union(met.mapInArrow(pairs, _ddl(schema)))


def half_replaced(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _measure(ids: list, texts: list[str], following: list[str]) -> list[list]:
    n = len(ids)
    shifted = all(a is b for a, b in zip(texts[1:], following))  # neighbours share their texts
    own = digests(texts + following[-1:] if shifted and n else texts)
    behind, b = (own, np.arange(1, n + 1)) if shifted else (digests(following), np.arange(n))
    edited = [half_replaced(t, f) for t, f in zip(texts, following)]
    changed = digests(edited)
    every = np.arange(n)
    size = lambda d: np.bincount(d[1], minlength=n + 1)
    near = []
    for other, at in ((changed, every), (behind, b)):
        pair, *_ = differences(own, every, other, at)
        near.append(likeness(size(own)[:n], size(other)[at], np.bincount(pair, minlength=n)))
    mine = own[1] < n
    prints = [packed(sketches(*some, n), n) for some in ((own[0][mine], own[1][mine]), changed)]
    return [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], *prints, *near]


def edited_by_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its text with the last half taken from the next document, and against that document (rows of ``NEXT_SCHEMA``).

    The next document is the one with the next lower id; the first follows the last, and a single document follows itself. Null
    texts are empty. Null ids come last; rows with equal ids follow each other by a hash of their texts; repeated rows give rows of
    their own. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    return _as_text(with_next(docs, _measure, NEXT_SCHEMA, id_col, text_col))  # bytes until the end, as the walk writes them
