"""Token ids, the packed word format, token files and packing."""
from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shirube.llm import packing, simple8b, token_files, tokens
from shirube.llm.queries import QUERIES

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = ["", " ", "  ", "\n", "a  b", "a \n b ", " lead", "trail ", "trail\n", "a\tb", "x <|endoftext|> y", "it's we'll  they'Re", "é áb", "ΑΣ ΣΑΣ", "日本 語", "1234 56", "a b", "x́ ́y", "İstanbul",
       "a\x1cb .\x1c,", "<|EndOfText|>", "foo...bar!!! $$$", "ſ K", "a.b,c d.,e f .g ,h é.é", "word.\nNext, word\nnext.", "a\n\n\nb", "a\n\n"]


def plain_ids(name, text, end_id):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + [end_id]


@pytest.mark.parametrize("name", NAMES)
def test_word_encoder_is_the_tokenizer(name, documents):
    texts = ODD + [r.text for r in documents.limit(60).collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    for most in (1_000_000, 50):  # 50: forgets all the time
        got = list(tokens.WordEncoder(public_tokenizers.path(name), most).encode_texts(pa.array([*texts, None])))
        assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_word_encoder_keeps_the_words_that_come_again():
    encoder = tokens.WordEncoder(public_tokenizers.path(NAMES[1]), 60)
    texts = [" often.", " often. once", " " + " ".join(f"new{i}" for i in range(57)), " often. then"]
    for text in texts:
        (got,) = encoder.encode_texts(pa.array([text]))
        assert got.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.index) <= 62 and " often." in encoder.index
    assert " once" not in encoder.index


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "a", "Word", "'s", "'", ".", ",", "\t", "é", "12", " ", "<|endoftext|>", "_", "ß"]), max_size=12))
def test_word_encoder_on_odd_mixes(parts):
    for name in NAMES:
        encoder = tokens.encoder(public_tokenizers.path(name))
        (got,) = encoder.encode_texts(pa.array(["".join(parts)]))
        assert got.tolist() == encoder.tokenizer.encode("".join(parts), add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=8), st.integers(0, 3000), st.integers(0, 2**32))
def test_simple8b_round_trip(widths, n, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([np.zeros(0, np.uint64), *(rng.integers(0, 2**w, n, dtype=np.uint64, endpoint=True) if 0 < w < 64 else rng.integers(0, 2**64 - 1, n // 100, dtype=np.uint64, endpoint=True) if w else np.zeros(n, np.uint64) for w in widths)])
    assert (simple8b.decode(*simple8b.encode(values), len(values)) == values).all()


def test_simple8b_is_word_aligned_and_small():
    words, offsets, escapes = simple8b.encode(np.arange(4000, dtype=np.uint64) % 7)
    assert len(words) * 8 < 4000 and list(offsets)[0] == 0 and len(offsets) == 5 and not len(escapes)


def check_files(docs, rows, name, end_id):
    start = 0
    want = []
    for doc_id, text in docs:
        ids = plain_ids(name, text, end_id)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows == want


def test_token_files_query(spark, documents):
    rows = sorted(tuple(r) for r in QUERIES["op8_token_files"][0](spark, "/root/testdata/sf0.001").collect())
    check_files(sorted((r.doc_id, r.text) for r in documents.collect()), rows, "byte_bpe_50k.json", 2)


def test_token_files_of_odd_rows(spark, odd, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(odd, str(tmp_path / "odd"), path, 2, frame_ids=100)
    back = token_files.read_token_files(spark, str(tmp_path / "odd"), with_ids=True).orderBy("start").collect()
    assert len(back) == odd.count() and back[0].doc_id is None
    ends = [0, *(r.start + r.n_tokens for r in back)]
    assert [r.start for r in back] == ends[:-1]
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(plain_ids("byte_bpe_50k.json", r.text, 2))
    for r in back:
        assert r.ids in texts[r.doc_id]
    token_files.write_token_files(none, str(tmp_path / "none"), path, 2)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_best_fit_is_tightest():
    rng = np.random.default_rng(3)
    for window in (16, 100, 2048):
        lengths = np.sort(rng.integers(1, window + 1, 300))[::-1]
        number, offset = packing.best_fit(lengths, window)
        rooms = []
        for length, n, o in zip(lengths.tolist(), number.tolist(), offset.tolist()):
            fitting = [r for r in rooms if r >= length]
            if fitting:
                assert n < len(rooms) and rooms[n] == min(fitting) and o == window - rooms[n]
                rooms[n] -= length
            else:
                assert n == len(rooms) and o == 0
                rooms.append(window - length)


def check_packing(rows, docs, name="word_bpe_49k.json", window=2048):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= window
    for doc_id, text in docs:
        ids, end = plain_ids(name, text, 1), 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (end, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[end:end + r.length], "<u4").tobytes())
            end += r.length
        assert end == len(ids)
    return sum(r.length for r in rows) / (window * len(places))


def test_packing_query(spark, documents):
    rows = QUERIES["op7_packing"][0](spark, "/root/testdata/sf0.001").collect()
    assert check_packing(rows, [(r.doc_id, r.text) for r in documents.collect()]) > 0.95


def test_pieces_without_id_are_dealt_over_tasks(spark):
    made = spark.range(6000).selectExpr("cast(null as long) as doc_id", "0L as start", "pmod(id, 300) + 1 as length", "'kept' as offset", "'kept' as place", "'kept' as _place")
    rows = packing.pack(made, per_task=500).collect()
    tasks = defaultdict(list)
    for r in rows:
        tasks[r.sequence_id // packing.PER_TASK].append(r)
    assert len(rows) == 6000 and len(tasks) == packing.tasks_for(6000, 8, 500) == 12 and max(map(len, tasks.values())) < 700
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(spans[-1]) <= packing.WINDOW
    assert {(r.place, r["_place"]) for r in rows} == {("kept", "kept")}
    assert [packing.tasks_for(n, 200, 200_000) for n in (0, 3_999, 8_000, 1_000_000, 10**9)] == [1, 1, 2, 200, 5_000]


def test_packing_of_odd_rows(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    packed = packing.pack(packing.cut_documents(odd, path, 1, with_ids=True)).cache()
    assert packed.agg({"length": "sum"}).first()[0] == sum(len(plain_ids("word_bpe_49k.json", r.text, 1)) for r in odd.collect())
    check_packing(packing.pack(packing.cut_documents(unique, path, 1)).collect(), [(r.doc_id, r.text) for r in unique.collect()])
    assert all(len(r.ids) <= 2048 for r in packing.sequences(packed).collect())
    assert packing.sequences(packed).count() == packed.select("sequence_id").distinct().count()
    assert packing.pack(packing.cut_documents(none, path, 1)).count() == 0
