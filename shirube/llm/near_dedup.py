"""Near-duplicate documents: SimHash fingerprints with a covering LSH find candidates, shared word shingles decide.

Every row has the SimHash fingerprint of its five-word shingles. Rows whose fingerprints differ in at most ``RADIUS`` bits are
candidates: they share a bucket of one of the covering masks (``simhash``), and only pairs of a bucket within the radius are compared.

SimHash alone would miss most pairs at J 0.8, so it has a helper that only adds candidates. Every row also has min-wise values of
its five-word shingles: ``BANDS`` fingerprints of ``ROWS`` values each, from one hash family per
value. Two texts agree in one value with a probability equal to their Jaccard similarity J, wherever and however they differ:
scattered words, a passage added, cut or replaced. They share a fingerprint with probability 1 - (1 - J^ROWS)^BANDS, which is
99.8 % at J 0.8 and more above. Whether a pair is a link is then decided on the whole texts: Jaccard similarity of their sets of
five-word shingles.

Groups. Texts with equal words are one node from the start. A bucket of a few nodes compares all its pairs. A larger one
compares its nodes with one of them, picked by hash, so that a node meets other nodes in its other buckets; what the links so
far have not joined is then compared with all nodes of the bucket that are in other groups. Only pairs that are in one group
already are left out, so groups are those of all links between candidates, and a group of n texts costs about n comparisons.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, stored
from .components import components
from .simhash import SEED, fingerprint, masks, shingle_hashes

SHINGLE = 5
SIMILAR = 0.8
BANDS = 20
ROWS = 6
RADIUS = 2
AT_ONCE = 8
_FILTER_WORDS = 1 << 16
_AT_A_TIME = 1024  # shingles; bounds the memory of the table of hashed shingles


def _families(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each min-wise value: what its shingles are crossed with and multiplied by, and its factor in the fingerprint."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, (bands * rows, 1), np.uint32), rng.integers(0, 1 << 32, (bands * rows, 1), np.uint32) | np.uint32(1), rng.integers(0, 1 << 64, (bands, rows), np.uint64) | np.uint64(1)


def min_prints(hashes: np.ndarray, families: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The fingerprints (int64, one for each band) of a set of shingle hashes; none of an empty set."""
    cross, times, factors = families
    if not len(hashes):
        return np.zeros(0, np.int64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(cross), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), _AT_A_TIME):
        np.minimum(least, ((short[at:at + _AT_A_TIME] ^ cross) * times).min(axis=1), out=least)
    x = (least.reshape(factors.shape).astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def shingle_prints(docs: DataFrame, row_col: str, text_col: str, bands: int, rows_each: int) -> DataFrame:
    """_row, d1, d2 (a 128-bit hash of the word sequence), sim (SimHash fingerprint), fps (min-wise fingerprints of the shingles)."""
    rows = docs.select(docs[row_col].alias("_row"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = _families(bands, rows_each)
        for batch in batches:
            sums, sims, fps = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sums.append(xxhash.xxh3_128_digest(b" ".join(text.encode().lower().split())))
                hashes = shingle_hashes(text, SHINGLE)
                sims.append(fingerprint(hashes))
                fps.append(min_prints(hashes, families))
            halves = np.frombuffer(b"".join(sums), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(sims, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["_row", "d1", "d2", "sim", "fps"])

    return rows.mapInArrow(run, "_row long, d1 long, d2 long, sim long, fps array<long>")


def buckets(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes(node, sim, fps) to (key, node, sim, n, lead) of the buckets that more than one node shares.

    Buckets of the covering masks keep ``sim``, as their pairs count only within the radius (``_within``); in the others it is null.
    """
    covered = F.transform(F.array(*[F.lit(m) for m in masks(radius)]), lambda m, i: F.struct(F.xxhash64(F.lit("mask"), i, F.col("sim").bitwiseAND(m)).alias("key"), F.col("sim").alias("sim")))
    banded = F.transform("fps", lambda fp, i: F.struct(F.xxhash64(i, fp).alias("key"), F.lit(None).cast("long").alias("sim")))
    table = nodes.select("node", F.explode(F.concat(covered, banded)).alias("b")).select("node", "b.key", "b.sim")
    shared = table.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node", "sim")).alias("lead")).where("n > 1").select(F.col("key").bitwiseXOR(F.lit(0)).alias("k"), "n", F.col("lead.node").alias("lead"), F.col("lead.sim").alias("lead_sim"))
    return table.join(shared, F.col("key") == F.col("k")).drop("k")


def _within(one: str, other: str, radius: int = RADIUS) -> Column:
    """Pairs of a min-wise bucket, and pairs of a mask's bucket at most ``radius`` bits apart."""
    return F.col(one).isNull() | (F.bit_count(F.col(one).bitwiseXOR(F.col(other))) <= radius)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_sets(docs: DataFrame, members: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """node, grams (sorted distinct shingle hashes, binary) of the rows that may be in ``members``: a bit table of fixed size tells."""
    bit, word = (lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(k), F.lit(64)).cast("int"))), (lambda k: F.pmod(F.shiftright(F.xxhash64(k), 6), F.lit(_FILTER_WORDS)))
    bits = F.broadcast(members.select(word(F.col("node")).alias("_word"), bit(F.col("node")).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))  # 65,536 rows at most
    rows = docs.select(docs[row_col].alias("node"), docs[text_col].alias("text")).withColumn("_word", word(F.col("node"))).join(bits, "_word").where(F.col("_bits").bitwiseAND(bit(F.col("node"))) != 0).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.unique(shingle_hashes(t.as_py() or "", SHINGLE)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["node", "grams"])

    return rows.mapInArrow(run, "node long, grams binary")


def verified(pairs: DataFrame, grams: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have at least the similarity; two texts without words have it."""
    left, right = grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for ga, gb in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(ga.as_py(), np.uint64), np.frombuffer(gb.as_py(), np.uint64)
                small, large = sorted((len(x), len(y)))
                if small < similar * large:
                    near.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similar * (len(x) + len(y) - both))
            mask = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    return joined.mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, row_col: str, text_col: str = "text", similar: float = SIMILAR, bands: int = BANDS, rows_each: int = ROWS, at_once: int = AT_ONCE) -> DataFrame:
    """_row, root for every row: rows with one root are near-duplicates of each other, over a chain of links."""
    rows = stored(shingle_prints(docs, row_col, text_col, bands, rows_each))
    nodes = stored(rows.groupBy("d1", "d2").agg(F.min("_row").alias("node"), F.first("sim").alias("sim"), F.first("fps").alias("fps")))
    shared = stored(buckets(nodes))
    small, large = shared.where(F.col("n") <= at_once).select("key", "node", "sim"), shared.where(F.col("n") > at_once)
    in_small = small.select("key", F.col("node").alias("a"), "sim").join(small.select(F.col("key").alias("k"), F.col("node").alias("b"), F.col("sim").alias("sb")), F.col("key") == F.col("k")).where("a < b").where(_within("sim", "sb")).select("a", "b")
    begun = stored(_ordered(in_small.union(large.where(_within("sim", "lead_sim")).select(F.col("node").alias("a"), F.col("lead").alias("b")))))
    grams = stored(shingle_sets(docs, shared, row_col, text_col))
    edges = stored(verified(begun, grams, similar))
    roots = components(edges)
    if not large.isEmpty():
        placed = stored(large.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("key", "node", "sim", F.coalesce("root", "node").alias("root")))
        main = placed.groupBy("key").agg(F.mode("root").alias("main")).select(F.col("key").bitwiseXOR(F.lit(0)).alias("k"), "main")
        apart = placed.join(main, F.col("key") == F.col("k")).where("root <> main").select(F.col("key").alias("k"), F.col("node").alias("a"), F.col("sim").alias("sa"), F.col("root").alias("ra"))
        rest = apart.join(placed, F.col("k") == F.col("key")).where("ra <> root").where(_within("sa", "sim")).select("a", F.col("node").alias("b"))
        rest = stored(_ordered(rest).join(begun, ["a", "b"], "left_anti"))
        roots = components(edges.union(verified(rest, grams, similar)))
    of_node = nodes.select("d1", "d2", "node").join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.coalesce("root", "node").alias("root"))
    return rows.join(of_node, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).select("_row", "root")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id (null ids last, ties by place).

    Texts that differ in case of A-Z and white space only are copies. Texts of fewer than five words have their whole word
    sequence as shingle; texts without words (null included) are copies of each other. All columns stay, whatever their names.
    """
    columns, row_col = docs.columns, f"{free_prefix(docs)}row"
    numbered = stored(docs.withColumn(row_col, F.monotonically_increasing_id()))  # written once, so that the numbers are fixed
    placed = groups(numbered, row_col, text_col, **options).withColumnRenamed("_row", "r")
    ids = numbered.select(F.col(row_col).alias("_row"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row_col).alias("row")).alias("rank"))
    ranked = stored(ids.join(placed, F.col("_row") == F.col("r")).select("_row", "rank", "root"))
    first = ranked.groupBy("root").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("root").bitwiseXOR(F.lit(0)).alias("g"), "first")
    gone = stored(ranked.join(first, F.col("root") == F.col("g")).where("rank <> first").select(F.col("_row").alias(row_col)))
    return numbered.join(gone, row_col, "left_anti").select(*columns)
