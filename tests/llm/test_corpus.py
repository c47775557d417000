"""Decontamination, resampling, page text and the pipeline."""
from __future__ import annotations

import html
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

import corpus_pipeline
from shirube.llm import decontaminate, html_text, resampling
from shirube.llm.queries import QUERIES

from .conftest import SCHEMA, rows
from .test_dedup import brute_lines, jaccard
from .test_tokens import check_packing


def brute_leaks(docs, items):
    """The pairs whose question and answer shingles stand in the text, wherever."""
    out = set()
    for item_id, text in items:
        question, answer = map(decontaminate.shingles, decontaminate.question_and_answer(text or ""))
        for doc_id, doc in docs:
            has = decontaminate.shingles_in(decontaminate.words_of(doc or ""))
            if (question or answer) and all(sum(map(has, p)) >= 0.8 * len(p) for p in (question, answer)):
                out.add((doc_id, item_id))
    return out


def test_leaks_query(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontaminate"][0](spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_leaks([(r.doc_id, r.text) for r in documents.collect()], items) and got


def test_search_finds_all_above_threshold():
    rng = np.random.default_rng(2)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 12)))) for i in range(90)]
    counted = [Counter(decontaminate.words_of(t)) for _, t in items]
    frequencies = Counter(w for c in counted for w in c)
    index = decontaminate.Index(items, len(items), frequencies, sum(map(Counter.total, counted)) / len(items))
    for _ in range(60):
        terms = sorted({index.terms[w] for w in rng.choice(words, 15) if w in index.terms})
        exact = [sum(v for t in terms for n, v in zip(index.numbers[t], index.impacts[t]) if n == number) for number in range(len(index.items))]
        for threshold in (0.3, 0.7):
            found = {n: s for block in range(index.block_max.shape[1]) for n, s in index.search(terms, block, threshold)}
            assert set(found) == {n for n, s in enumerate(exact) if s >= threshold - 1e-9}
            assert all(abs(found[n] - exact[n]) < 1e-9 for n in found)


def test_leaks_of_odd_rows_and_shards(spark, odd, none):
    items = spark.createDataFrame([(1, "plain0 word0 more plain1 word7 more plain2 word14 more"), (2, None), (3, ""), (4, "one two"), (5, "one two")], "item_id long, text string")
    want = brute_leaks([(i, r.text) for i, r in enumerate(odd.collect())], [(r.item_id, r.text) for r in items.collect()])
    for shard in (4096, 1):
        found = decontaminate.find_leaks(odd, items, shard_items=shard)
        assert found.count() == len(want)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (7, 4), (7, 5)}
        kept = decontaminate.drop_leaked(odd, items, shard_items=shard)
        assert kept.columns == odd.columns and kept.count() == odd.count() - 5
    assert decontaminate.find_leaks(none, items).count() == 0 and decontaminate.find_leaks(odd, items.limit(0)).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(-10**12, 10**12, 400)] + [5] * 50 + [-7] * 30
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 37, 300, 480):
        assert resampling.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]


def test_best_cut():
    weights, good = np.array([0.0, 0.0, -0.5, -4.0, -9.0]), np.array([True, True, True, False, False])
    assert resampling.best_cut(weights, good) == -2.25
    assert resampling.best_cut(weights, good | True) == float("-inf")


def test_resampling_rejects_what_labels_call_bad(spark):
    rng = np.random.default_rng(5)
    plain = [f"usual{i}" for i in range(200)]
    made, marks = [], []
    for i in range(3000):
        text = list(rng.choice(plain, 30))
        bad = i % 5 == 0
        if bad:
            text[::4] = [f"nasty{rng.integers(6)}"] * len(text[::4])
        made.append((i, " ".join(text)))
        if i % 3 == 0:
            marks.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows(*made), SCHEMA).repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in resampling.resample(docs, labels).collect()}
    held_out = [i for i in range(3000) if i % 3]
    assert np.mean([i in kept for i in held_out if i % 5]) > 0.99 and not any(i in kept for i in held_out if i % 5 == 0)
    assert kept == {r.doc_id for r in resampling.keep_sampled(docs.repartition(5), labels).collect()}
    assert resampling.resample(docs, labels, share=0.25).count() == 750


def test_resampling_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (99, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    kept = resampling.keep_sampled(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert resampling.keep_sampled(none, labels).count() == 0 and resampling.resample(odd, labels.limit(0)).count() == odd.count()


def test_models_count_documents(spark, odd):
    counts = {r.bucket: (r.raw, r.target) for r in resampling.count_documents(odd.selectExpr("text", "doc_id <= 3 as flag").repartition(4), "text", "flag").collect()}
    features = resampling._Features(resampling.BUCKETS)
    raw, target = Counter(), Counter()
    for r in odd.collect():
        mine = features.of(r.text or "").tolist()
        raw.update(mine)
        target.update(mine if (r.doc_id or 99) <= 3 else [])
    assert counts == {b: (n, target[b]) for b, n in raw.items()}


def brute_grams(text):
    """The n-grams of a text, spelled out."""
    tokens = re.findall(r"\w+|[^\w\s]+", text.lower())
    grams = {g for w in tokens for g in [w, *("^" + w[:k] for k in (3, 4, 5, 6, 7) if len(w) > k)]}
    twice = [a == b for a, b in zip(tokens, tokens[1:])]
    if sum(twice) > 1:
        grams.add(f"<repeats {min(9, 10 * sum(twice) // len(twice))}>")
    if any(a and b for a, b in zip(twice, twice[1:])):
        grams.add("<run>")
    return {zlib.crc32(g.encode()) % resampling.BUCKETS for g in grams}


def brute_sample(docs, good, share, seed):
    """doc_id to (log weight, key) of the drawn documents, from (doc_id, text) and the ids of the target."""
    grams = {i: brute_grams(t) for i, t in docs}
    raw, target = (Counter(b for i, _ in docs if i in ids for b in grams[i]) for ids in (set(grams), good))
    level = sorted(target[b] / n for b, n in raw.items() if target[b] and n >= 20)
    level = level[(len(level) + 1) // 2 - 1]
    ratios = {}
    for b, n in raw.items():
        ratio = math.log((target[b] + 0.5) / (level * n + 0.5))
        if level * n - target[b] > 3.5 * math.sqrt(level * n + 1) and ratio <= -math.log(4):
            ratios[b] = ratio
    out = {}
    for i, text in docs:
        weight, h = math.fsum(ratios.get(b, 0.0) for b in grams[i]), 42
        for form, value in (("<q", i), ("<q", zlib.crc32(text.encode())), ("<i", seed)):
            h = xxhash.xxh64_intdigest(struct.pack(form, value), h)
        out[i] = (weight, weight - math.log(-math.log((h % (1 << 52) + 0.5) / (1 << 52))))
    drawn = sorted(out, key=lambda i: -out[i][1])[:round(share * len(docs))]
    return {i: out[i] for i in drawn}


def test_drawn_sample_and_weights(spark):
    rng = np.random.default_rng(8)
    made = []
    for i in range(1200):
        text = [f"usual{k}" for k in rng.integers(0, 150, 25)]
        if i % 5 == 0:
            text[::6] = [f"nasty{rng.integers(4)}"] * len(text[::6])
        if i % 7 == 0:
            text[3:9] = ["again"] * 6
        made.append((i, " ".join(text)))
    marks = [(i, int(i % 7 > 0), int(i % 5 == 0)) for i in range(0, 1200, 2)]
    want = brute_sample(made, {i for i, quality, toxic in marks if quality and not toxic}, 0.8, 5)
    docs, labels = spark.createDataFrame(rows(*made), SCHEMA).repartition(4), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.log_weight, r.key) for r in resampling.resample(docs, labels, share=0.8).collect()}
    assert got.keys() == want.keys() and len(want) == 960
    assert np.allclose([got[i] for i in want], [want[i] for i in want])
    assert len({w for w, _ in want.values()}) > 1


PAGE = """<html><head><title>t</title></head><body class="page"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies and a long text that goes on and on</div>
<nav><ul><li><a href="/">Home</a><li><a href="/b">News</a></ul></nav><main><article><header><h1>Title</h1></header><p>One <a href=x>two</a> thr&eacute;e.<p>Four<br>five</p>
<div class="advert">Buy now</div><aside>see also</aside><form><input><button>Go</button>mail</form><script>if(a<b){x("<p>no</p>")}</script><p>Last &lt;b&gt; par&nbsp;x</p>
<section class="comments"><p>I like it very much indeed thank you</p></section></article></main><div class="sidebar"><p>Recent</p></div><footer>c</footer></body></html>"""


def test_page_text():
    tree = html_text.default_tree()
    assert html_text.main_text(PAGE, tree) == "Title One two thrée. Four five Last <b> par x"
    for page, want in (("", []), ("<", ["<"]), ("<p", []), ("&am", ["&am"]), ("a & b < c", ["a & b < c"]), ("<!-- x", []), ("<script>abc", []), ("x</p>y", ["x", "y"])):
        assert [t for t, _ in html_text.blocks(page)] == want


def test_tree_learns_its_table():
    table = np.array(html_text.LABELLED)
    tree = html_text.default_tree()
    assert np.mean([tree.says(tuple(r[:-1])) == bool(r[-1]) for r in table]) > 0.97
    folds = [i % 5 for i in range(len(table))]
    right = 0
    for fold in range(5):
        seen, held = table[[f != fold for f in folds]], table[[f == fold for f in folds]]
        own = html_text.train(seen[:, :-1], seen[:, -1])
        right += sum(own.says(tuple(r[:-1])) == bool(r[-1]) for r in held)
    assert right / len(table) > 0.8


def test_pages_query(spark):
    def article(page):
        body = page[page.index("<article>") + 9:]
        return " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", body.split("</article>")[0])).split())

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = QUERIES["op10_html_text"][0](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
    odd = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>word", "x")], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in html_text.extract(odd).orderBy("page_id", "url").collect()][1:] == [("", 0), ("", 0)]


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, docs, sf_dir).cache()
        old = {r.doc_id: r.text for r in docs.collect()}
        if name == "packing":
            check_packing(now.collect(), list(old.items()))
            break
        new = {r.doc_id: r.text for r in now.collect()}
        assert now.columns == columns and set(new) <= set(old)
        if name == "line_dedup":
            want = {i: t for i, (t, exact, near) in brute_lines(old.items()).items() if t.strip() or not exact + near}
            assert new == want
        elif name == "simhash_near_dedup":
            kept = list(new)
            assert not any(jaccard(new[a], new[b]) >= 0.8 for i, a in enumerate(kept) for b in kept[:i])
            assert all(any(jaccard(old[a], old[b]) >= 0.8 for b in old if b != a) for a in set(old) - set(new))
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(old) - set(new) == {i for i, _ in brute_leaks(old.items(), items)}
        docs = now
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_of_odd_rows(spark, odd, none):
    for table in (odd, none):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            assert name == "packing" or docs.columns == table.columns
        assert (docs.count() > 0) == (table is odd)


def test_wrappers_of_a_page_are_not_asides():
    tree, text = html_text.default_tree(), " ".join(f"word{i}" for i in range(60))
    for name in ("content has-sidebar", "with-sidebar", "content-sidebar-wrap", "no-ads", "widget", "page banner"):
        for tag in ("article", "div"):
            page = f'<body><div class="{name}"><{tag}><p>{text}</p><p>{text}</p></{tag}><div class="sidebar"><p>Recent things to read</p></div></div></body>'
            assert html_text.main_text(page, tree) == f"{text} {text}", name
    assert html_text.main_text(f"<article><p>{text} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>", tree) == f"{text} x=1"


def test_forms_around_a_page_are_not_asides():
    tree, text = html_text.default_tree(), " ".join(f"word{i}" for i in range(60))
    for tag in ("article", "main", "div"):
        page = f'<body><form id="aspnetForm" action="x"><nav><a href=a>Home</a></nav><{tag}><p>{text}</p><form><label>Mail</label> send your address to us now</form></{tag}><p class="cookie">We use cookies here</p></form></body>'
        assert html_text.main_text(page, tree) == text, tag
    assert html_text.main_text(f"<body><article><p>{text}</p></article><form><p>{text}</p></form></body>", tree) == text
    assert html_text.main_text(f"<body><div><p>{text}</p></div><form><p>Write to us by this form, we answer soon</p></form></body>", tree) == text


def test_stages_send_texts_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.range(0, 9000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 400) AS text")
    corpus_pipeline.packed(spark, docs.limit(0), "/root/testdata/sf0.001")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    spark.conf.unset(name)
    assert sum(r["rows"] for r in got) == 9000 and max(r["bytes"] for r in got) <= 5 << 20
