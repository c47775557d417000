"""Exact, line, fingerprint and near dedup against brute force."""
from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from shirube.llm import exact_dedup, line_dedup, near_dedup, resampling, simhash
from shirube.llm.components import components
from shirube.llm.queries import QUERIES

from .conftest import BASE, SCHEMA, rows


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_copies(odd, none):
    want = defaultdict(list)
    for r in odd.collect():
        want[folded(r.text)].append(r.doc_id)
    got = exact_dedup.mark_copies(odd, hash_all=True).collect()
    groups = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    assert len(got) == odd.count()
    for r in got:
        ids = groups[r.full_hash]
        named = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (max(named) if named else None, len(ids))
        assert r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup.mark_copies(none).count() == 0
    lazy = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_copies(odd).collect()}
    assert lazy == {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got}


def test_exact_copies_with_a_full_bit_table(documents):
    plain = {tuple(r) for r in exact_dedup.mark_copies(documents, hash_all=True).collect()}
    assert plain == {tuple(r) for r in exact_dedup.mark_copies(documents, hash_all=True, words=1).collect()}
    assert exact_dedup.drop_copies(documents).count() == len({folded(r.text) for r in documents.collect()})


def brute_lines(pairs, similar=(4, 5), least=5):
    """doc_id to (kept text, n_exact, n_near)."""
    seen, out = [], {}
    for doc_id, text in sorted(pairs):
        kept, exact, near = [], 0, 0
        for line in text.split("\n"):
            parts = [w for w in line.lower().translate(str.maketrans("\t\r\f\v", "    ")).split(" ") if w]
            words = {tuple(parts[i:i + least]) for i in range(max(1, len(parts) - least + 1))} if parts else set()
            if not words:
                kept.append(line)
                continue
            if words in seen:
                exact += 1
            elif any(len(words & o) * sum(similar) >= (len(words) + len(o)) * similar[0] for o in seen):
                near += 1
            else:
                kept.append(line)
            if words not in seen:
                seen.append(words)
        out[doc_id] = ("\n".join(kept), exact, near)
    return out


@pytest.mark.parametrize("at_once", [2, 32])
def test_lines(spark, at_once, monkeypatch):
    monkeypatch.setattr(line_dedup.matched_lines, "__defaults__", (at_once,))
    rng = random.Random(at_once)
    words = [f"t{i}" for i in range(60)] + ["the", "of", "and"] * 3
    base = [" ".join(rng.sample(words, rng.randrange(5, 40))) for _ in range(20)]

    def line():
        kind = rng.random()
        if kind < 0.3:
            return rng.choice(base)
        if kind < 0.8:
            parts = rng.choice(base).split()
            parts[rng.randrange(len(parts))] = rng.choice(words)
            return " ".join(parts)
        return " ".join(rng.choices(words, k=rng.randrange(0, 12)))

    pairs = [(i, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    got = {r.doc_id: (r.text, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(spark.createDataFrame(rows(*pairs), SCHEMA)).collect()}
    assert got == brute_lines(pairs)


def test_lines_of_rows_that_repeat_an_id(spark):
    unique = "a line that nobody else has written down"
    first, copy = "the first line of the first row here\nand the second line of it as well", "the first line of the first row here\nthird"
    pairs = [(1, first), (2, f"{unique}\nsecond"), (2, copy), (2, copy)]
    got = sorted(r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows(*pairs), SCHEMA).repartition(3)).collect())
    assert got == sorted([first, f"{unique}\nsecond", "third", "third"])
    rng = random.Random(3)
    made = [(i // 4, "\n".join(f"text {i} line {k} " + " ".join(rng.choices("abcdefgh", k=9)) for k in range(5)) + f"\nshared by all of group {i // 8} and no other") for i in range(40)]
    got = [r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows(*made), SCHEMA)).collect()]
    kept = sorted(line for text in got for line in text.split("\n"))
    assert kept == sorted({line for _, text in made for line in text.split("\n")})


CLASH = ("_word", "_bits", "_doc", "_gone", "_at", "_row", "_good", "_log_weight", "_tie", "_key", "_id", "_exact", "row", "doc_no", "line_no", "codes", "node", "root", "offset", "sequence_id")


def test_other_columns_keep_their_names_and_values(spark):
    docs = spark.createDataFrame(rows(*((i, f"{BASE} {i}\nown line {i} with {i * i} words") for i in range(6))), SCHEMA)
    for name in CLASH:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), "doc_id"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    for step in (line_dedup.dedup_lines, near_dedup.drop_near_copies, lambda d: resampling.keep_sampled(d, labels)):
        got = step(docs)
        assert got.columns[:len(docs.columns)] == docs.columns and got.count() > 0
        for r in got.collect():
            assert all(r[name] == f"{name} of {r.doc_id}" for name in CLASH)


def test_lines_of_odd_rows(odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[2].text == "" and by_id[2].n_exact == 1 and by_id[4].text is None and by_id[None] is not None
    assert by_id[3].n_near == 1
    assert line_dedup.dedup_lines(none).count() == 0


def brute_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    n = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    rng = random.Random(radius)
    for _ in range(2000):
        turned = sum({1 << rng.randrange(64) for _ in range(radius)})
        assert any(turned & (m % (1 << 64)) == 0 for m in simhash.masks(radius))


def test_fingerprint_components(spark):
    docs = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = least_reachable(docs, [(a, b) for a in docs for b in docs if a < b and (docs[a] ^ docs[b]).bit_count() <= 2])
    got = QUERIES["op6_simhash"][0](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in docs.items()}


def test_crowded_buckets(spark):
    rng = random.Random(4)
    values = set()
    for _ in range(4):
        base = rng.randrange(1 << 64)
        values |= {base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for _ in range(60)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = least_reachable(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2])
    roots = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    assert {v: roots.get(v, v) for v in signed} == want


def test_fingerprints_of_odd_rows(odd, none):
    got = simhash.near_copies(odd)
    assert got.count() == odd.count() and simhash.near_copies(none).count() == 0
    assert {r.fingerprint for r in got.where("doc_id in (4, 5, 6)").collect()} == {"0" * 16}
    assert {r.component_id for r in got.where("doc_id in (4, 5, 6)").collect()} == {4}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


def jaccard(a, b):
    def grams(t):
        w = folded(t).split()
        n = min(5, len(w))
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_stay_once(spark):
    rng = random.Random(9)
    texts = {}
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(60, 200))]
        for c in range(12):
            words = list(base)
            for _ in range(0 if c == 0 else rng.randrange(1, max(2, len(words) // 90))):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts[g * 100 + c] = " ".join(words)
    docs = spark.createDataFrame(rows(*texts.items()), SCHEMA)
    want = least_reachable(texts, [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8])
    got = sorted(r.doc_id for r in near_dedup.drop_near_copies(docs, at_once=4).collect())
    assert got == sorted(set(want.values()))


def test_near_copies_of_odd_rows(odd, none):
    got = near_dedup.drop_near_copies(odd)
    assert got.columns == odd.columns
    ids = sorted(r.doc_id for r in got.where("doc_id is not null").collect())
    assert ids == [1, 4, 7, 8, 10] and got.where("doc_id is null").count() == 1
    assert near_dedup.drop_near_copies(none).count() == 0
    assert len(BASE.split()) > 50


def edited(rng, words, share, kind):
    """A text with a passage added, cut or replaced, or with scattered words replaced."""
    n = max(1, round(len(words) * share))
    at = rng.choice([0, rng.randrange(len(words) - n), len(words) - n])
    new = [f"n{rng.randrange(10**6)}" for _ in range(n)]
    if kind == "scattered":
        out = list(words)
        for i in rng.sample(range(len(words)), max(1, n // 6)):
            out[i] = new[0] + str(i)
        return out
    return words[:at] + ([] if kind == "cut" else new) + words[at + n * (kind != "added"):]


@pytest.mark.parametrize("kind", ["added", "cut", "replaced", "scattered"])
def test_candidates_of_changed_passages(kind):
    rng, families = random.Random(kind), near_dedup._families(near_dedup.BANDS, near_dedup.ROWS)
    found = of = 0
    while of < 200:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        a, b = " ".join(words), " ".join(edited(rng, words, rng.uniform(0.02, 0.2), kind))
        if 0.8 <= jaccard(a, b) < 0.9:
            x, y = (near_dedup.min_prints(simhash.shingle_hashes(t, near_dedup.SHINGLE), families) for t in (a, b))
            found, of = found + bool((x == y).any()), of + 1
    assert found >= 0.98 * of


def test_copies_with_a_passage_more_or_less_go(spark):
    rng, texts = random.Random(4), {}
    for g in range(20):
        words = [f"g{g}w{rng.randrange(900)}" for _ in range(200)]
        for c, kind in enumerate(["added", "cut", "replaced"]):
            texts[g * 10 + 1 + c] = " ".join(edited(rng, words, 0.06, kind))
        texts[g * 10] = " ".join(words)
        assert all(jaccard(texts[g * 10], texts[g * 10 + c]) >= 0.8 for c in (1, 2, 3))
    kept = near_dedup.drop_near_copies(spark.createDataFrame(rows(*texts.items()), SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == [g * 10 for g in range(20)]


@pytest.mark.parametrize("at_once", [8, 1])
def test_simhash_finds_candidates_by_itself(spark, at_once):
    """Without min-wise fingerprints the pairs within two bits of SimHash are still found and verified, and no others."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**9)}" for _ in range(3000)]
    fp = lambda ws: simhash.fingerprint(simhash.shingle_hashes(" ".join(ws), near_dedup.SHINGLE))
    apart = lambda ws: bin((fp(ws) ^ fp(words)) & (1 << 64) - 1).count("1")
    changed = [words[:i] + ["changed"] + words[i + 1:] for i in range(100, 2900, 200)]
    near = next(ws for ws in changed if 1 <= apart(ws) <= 2)
    far = words[:2500]  # Jaccard 0.83, more than two bits
    assert apart(far) > 2
    texts = {0: words, 1: near, 2: far}
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in texts.items()], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(docs, bands=0, at_once=at_once).collect()) == [0, 2]
    assert [r.doc_id for r in near_dedup.drop_near_copies(docs, at_once=at_once).collect()] == [0]
