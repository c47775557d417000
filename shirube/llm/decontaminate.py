"""Benchmark decontamination: a BM25 index of test items, queried with every passage of every document.

Index. Items are indexed in shards of bounded size, with document frequencies and the mean length taken over all items. Impacts
are scaled so that an item scores 1 against a passage that has all its words; the threshold is a share of that. Postings are
sorted by item and cut into blocks of items; for each term the index keeps its largest impact overall and in each block.

Search. A document is cut into cells of half the longest item's length; a passage is three cells in a row, so that every item
that a document holds lies whole in some passage. Block-max WAND: for all passages of a document at once, the block bounds of their
terms are added up, and only (passage, block) pairs that reach the threshold are searched; there the posting lists move in
step, the pivot is the first list at which the bounds of the lists so far reach the threshold, and lists before it skip to
the pivot. What is skipped cannot reach the threshold, so all items above it are found.

Verification. An item counts as leaked if the passage has at least 0.8 of the five-word shingles of its question and of its
answer. The answer is the item's last line; of one line, its last sentence; of one sentence, the last third of its words.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
THRESHOLD = 0.7
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 16
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of both parts of an item."""
    for parts in ([p for p in text.split("\n") if words_of(p)], [p for p in _SENTENCE.split(text) if words_of(p)]):
        if len(parts) > 1:
            return words_of("\n".join(parts[:-1])), words_of(parts[-1])
    words = words_of(text)
    third = len(words) // 3
    return words[:len(words) - third], words[len(words) - third:]


class Index:
    """The items of one shard. ``total`` items in all have ``frequencies`` of terms and a mean length of ``mean`` words."""

    def __init__(self, items: list[tuple[object, str]], total: int, frequencies: dict[str, int], mean: float):
        counted = [(item_id, text, Counter(words_of(text))) for item_id, text in items]
        self.items = sorted(((i, t, c) for i, t, c in counted if c), key=lambda x: (str(x[0]), x[1]))
        self.ids = [i for i, _, _ in self.items]
        self.parts = [tuple(map(shingles, question_and_answer(t))) for _, t, _ in self.items]
        self.longest = max((sum(c.values()) for *_, c in self.items), default=0)
        self.terms: dict[str, int] = {}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for number, (_, _, counts) in enumerate(self.items):
            size = sum(counts.values())
            impact = {}
            for term, tf in counts.items():
                df = frequencies[term]
                impact[term] = math.log(1 + (total - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
            whole = sum(impact.values())
            for term, value in impact.items():
                postings[self.terms.setdefault(term, len(self.terms))].append((number, value / whole))
        blocks = -(-len(self.items) // BLOCK)
        self.numbers = [[n for n, _ in postings[t]] for t in range(len(self.terms))]
        self.impacts = [[v for _, v in postings[t]] for t in range(len(self.terms))]
        self.block_max = np.zeros((len(self.terms) + 1, blocks), np.float32)  # the last row is of words that no item has
        for t in range(len(self.terms)):
            for n, v in postings[t]:
                self.block_max[t, n // BLOCK] = max(self.block_max[t, n // BLOCK], v)
        self.block_max *= np.float32(1.000001)  # bounds stay bounds in single precision

    def search(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """The items of a block that score at least ``threshold`` against distinct terms, with their scores."""
        stop = (block + 1) * BLOCK
        lists = []  # [item now, bound, place, numbers, impacts]
        for t in terms:
            bound = float(self.block_max[t, block])
            if bound:
                numbers = self.numbers[t]
                place = bisect_left(numbers, block * BLOCK)
                lists.append([numbers[place], bound, place, numbers, self.impacts[t]])
        found = []
        while lists:
            lists.sort(key=lambda x: x[0])
            total, pivot = 0.0, None
            for entry in lists:
                total += entry[1]
                if total >= threshold:
                    pivot = entry[0]
                    break
            if pivot is None or pivot >= stop:
                break
            if lists[0][0] == pivot:
                score = 0.0
                for entry in lists:
                    if entry[0] != pivot:
                        break
                    score += entry[4][entry[2]]
                    self._move(entry, pivot + 1, stop)
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
            else:
                for entry in lists:
                    if entry[0] >= pivot:
                        break
                    self._move(entry, pivot, stop)
            lists = [x for x in lists if x[0] < stop]
        return found

    @staticmethod
    def _move(entry: list, to: int, stop: int) -> None:
        place = bisect_left(entry[3], to, entry[2])
        entry[2] = place
        entry[0] = entry[3][place] if place < len(entry[3]) else stop

    def leaks(self, text: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, float, float, float]]:
        """The items that a text holds: number, best score, overlap of question and of answer."""
        words = words_of(text)
        if not words or not self.items:
            return []
        absent = len(self.terms)
        lookup = self.terms.get
        terms = np.fromiter((lookup(w, absent) for w in words), np.int64, len(words))
        cell = -(-self.longest // 2)
        cells = np.arange(len(words)) // cell
        pairs = np.unique(np.concatenate([np.maximum(cells - back, 0) * (absent + 1) + terms for back in range(3)]))
        owner, own = np.divmod(pairs, absent + 1)
        starts = np.searchsorted(owner, np.arange(cells[-1] + 2))
        bounds = np.add.reduceat(self.block_max[own], starts[:-1], axis=0)
        best: dict[int, tuple[float, float, float]] = {}
        for passage, block in zip(*np.nonzero(bounds >= threshold)):
            begin, end = passage * cell, (passage + 3) * cell
            distinct = own[starts[passage]:starts[passage + 1]]
            distinct = distinct[distinct != absent]
            found = self.search(distinct.tolist(), int(block), threshold)
            if not found:
                continue
            has = shingles_in(words[begin:end])
            for number, score in found:
                question, answer = (sum(has(s) for s in part) / len(part) if part else 1.0 for part in self.parts[number])
                if question >= overlap and answer >= overlap:
                    best[number] = max(best.get(number, (0.0, 0.0, 0.0)), (score, question, answer))
        return [(number, *values) for number, values in sorted(best.items())]


def shingles_in(words: list[str]):
    """A test whether a run of at most five words stands in ``words``."""
    sets: dict[int, set[tuple[str, ...]]] = {}

    def has(run: tuple[str, ...]) -> bool:
        n = len(run)
        if n not in sets:
            sets[n] = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
        return run in sets[n]

    return has


def build_indexes(benchmark: DataFrame, shard_items: int = 4096, shard_chars: int = 1 << 23, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The index in shards of about ``shard_items`` items and ``shard_chars`` characters, each small enough to broadcast."""
    rows = benchmark.select(benchmark[id_col].alias("item_id"), F.coalesce(benchmark[text_col], F.lit("")).alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    shards = max(1, -(-size["n"] // shard_items), -(-size["chars"] // shard_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, words = Counter(), []
            for text in batch.column(0):
                own = words_of(text.as_py())
                words.append(len(own))
                counts.update(set(own))
            yield pa.RecordBatch.from_pydict({"term": [None, *counts], "n": [sum(words), *counts.values()], "filled": [sum(w > 0 for w in words), *[0] * len(counts)]}, schema=pa.schema([("term", pa.string()), ("n", pa.int64()), ("filled", pa.int64())]))

    stats = rows.select("text").mapInArrow(terms, "term string, n long, filled long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("filled").alias("filled")).cache()
    whole = stats.where("term is null").first()
    total = whole["filled"] if whole else 0
    for shard in range(shards if total else 0):
        items = [(r["item_id"], r["text"]) for r in rows.where(part == shard).collect()]
        vocabulary = sorted({w for _, t in items for w in words_of(t)})
        own = stats.where(F.col("term").isin(vocabulary)) if len(vocabulary) <= 1000 else stats.where("term is not null") if shards == 1 else stats.join(F.broadcast(stats.sparkSession.createDataFrame([(w,) for w in vocabulary], "term string")), "term")
        yield Index(items, total, {r["term"]: r["n"] for r in own.collect()}, whole["n"] / total)
    stats.unpersist()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, **sharding) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    Null and empty texts hold nothing, items without words are held by none. Items with equal texts are all reported. Rows that
    repeat are searched each on their own; null ids stay null; other columns are ignored. Texts are searched whole, in one
    narrow pass for each shard of the benchmark; no text is shuffled.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {item_type}, score double, question_overlap double, answer_overlap double"

    def searched(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [(i, *hit) for i, text in enumerate(batch.column(1)) for hit in index.leaks(text.as_py() or "", threshold, overlap)]
                if hits:
                    places, numbers, *values = zip(*hits)
                    columns = [batch.column(0).take(pa.array(places)), pa.array([index.ids[n] for n in numbers]), *(pa.array(v, pa.float64()) for v in values)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return rows.mapInArrow(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for index in build_indexes(benchmark, **sharding):
        out = out.union(searched(index))
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, **sharding) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay, and no row moves between tasks."""
    at = docs.columns.index(text_col)

    def filtered(rows: DataFrame, index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.leaks(text.as_py() or "", threshold, overlap) for text in batch.column(at)], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    for index in build_indexes(benchmark, **sharding):
        docs = filtered(docs, index)
    return docs
