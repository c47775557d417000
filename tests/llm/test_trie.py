"""The trie of conversation prefixes against brute force."""
from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from shirube.llm import prefix_trie
from shirube.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, key string, path string, depth int, conv long, _salt int, own string"


def brute(rows, family=100, most=6):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        full[c] = own.get(c - c % family, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, leaves, saved = defaultdict(set), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1, 2, 3, "clash") for r in rows], SCHEMA)


def tree(got):
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert tree(QUERIES["op11_conversation_trie"][0](spark, "/root/testdata/sf0.01")) == brute([tuple(r) for r in rows])


@pytest.mark.parametrize("height", [1, 2, 3, 8])
def test_bands_of_any_height(spark, height):
    rng, rows = random.Random(height), []
    for c in range(0, 330, 3):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 9, 16, 23])):
            rows.append((c, t, rng.choice(["user", "tool"]), "same" if t < 12 else rng.choice("ab")))
    assert tree(prefix_trie.conversation_trie(frame(spark, rows), height=height)) == brute(rows)


def test_long_and_odd_conversations(spark):
    rows = [(7, t, "user", f"t{t}") for t in range(700)] + [(8, t, "user", f"t{t}") for t in range(650)]
    rows += [(9, None, None, None), (9, None, None, None), (9, None, "a", "x"), (9, 1, "", ""), (9, 1, "b", ""), (None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(210, 0, "user", "é" * 40), (-250, 0, "user", "minus"), (-201, 3, "user", "minus"), (300, 1, "u", "w " * 60_000), (301, 1, "u", "w " * 60_000)]
    plain = [r for r in rows if r[0] is None or r[0] >= 0]
    assert tree(prefix_trie.conversation_trie(frame(spark, plain))) == brute(plain)
    assert prefix_trie.conversation_trie(frame(spark, rows)).where("conv_id < 0 and depth = 0").count() == 1


def test_no_turns(spark):
    assert prefix_trie.conversation_trie(frame(spark, [])).count() == 0
    assert prefix_trie.conversation_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_blocks_of_keys(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = [(c, t, "user", f"{t}") for c in (100, 101, 102) for t in range(30 - c % 7)]
    assert tree(prefix_trie.conversation_trie(frame(spark, rows))) == brute(rows)
