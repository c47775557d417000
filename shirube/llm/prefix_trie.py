"""Trie of conversation prefixes with totals of every subtree, by depth-band rollup.

Order. Turns move once, by ranges of (conversation, turn), and are numbered by the rows before them: one row for each conversation and
range tells how many of its turns lie in earlier ranges. A conversation of any length is spread over ranges.

Keys. The key of a prefix is the sum of hashes of its turns, each taken with its place, in two 63-bit halves. Sums run along a
conversation by ordered scans in blocks of ``BLOCK`` turns, so prefixes of long conversations need no chain of hashes.

Bands. A node at depth d hangs in the band that begins at the last multiple of ``height`` below d, and carries the keys of its ancestors
there, at most ``height``. Totals of a band come from one explosion to those ancestors. What lies below the nodes at the foot of a band
is the total of bands that begin there; these roots form a smaller trie, whose paths are again cut into bands, and so on. Rounds grow
with the logarithm of the depth, rows of a round with ``height`` times the nodes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import Running, scan
from .common import spread_join, stored

HEIGHT = 8
BLOCK = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turns_in_order(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), own (turns of the conversation), d1, d2 (digest of role and text), n (code points of the text).

    Turns of equal number are ordered by role and text. Rows without a conversation are left out.
    """
    rows = conversations.select(
        conversations[conv_col].cast("long").alias("conv"), conversations[turn_col].alias("turn"),
        F.coalesce(conversations[role_col], F.lit("")).alias("role"), F.coalesce(conversations[text_col], F.lit("")).alias("text")).where("conv is not null")
    order = [F.col("conv"), F.asc_nulls_first("turn")]
    # what is sampled stays narrow: a short role is whole, so that the beginning of the text may follow it
    beginning = [F.substring("role", 1, 32), F.when(F.length("role") < 32, F.substring("text", 1, 64)).otherwise("")]
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    ranged = rows.repartitionByRange(*order, *beginning).sortWithinPartitions(*order, "role", "text")
    numbered = stored(ranged.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), half(1).alias("d1"), half(16).alias("d2"), F.length("text").cast("long").alias("n")))
    spans = numbered.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy("conv")  # one row for each range
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.struct("conv", "part").alias("span"), "first", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"), F.sum("held").over(whole).alias("own"))
    placed = numbered.withColumn("in", F.struct("conv", "part")).join(spans, F.col("in") == F.col("span"))
    return placed.select("conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "own", "d1", "d2", "n")


def rebuilt_turns(turns: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """conv, depth (from 1), d1, d2, n, last (depth of the conversation) of conversations whose first turns come from their family's first one.

    Conversation c takes its first h turns from conversation c - c % family (all it has, none if it is absent) and goes on with its own
    turns after the first h, where h = crc32 of the decimal c, modulo ``most``. Also one row of depth 0 for each conversation.
    """
    convs = turns.where("pos = 1").select("conv", "own")
    base = convs.select(F.col("conv").alias("head"), F.col("own").alias("head_own"))
    plan = convs.withColumn("base", F.col("conv") - F.col("conv") % family).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    plan = plan.join(base, F.col("base") == F.col("head"), "left").withColumn("m", F.least("h", F.coalesce("head_own", F.lit(0))))
    plan = plan.select("conv", "base", "own", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("last"))
    kept = spread_join(turns.select("conv", "pos", "d1", "d2", "n"), plan.select("conv", "own", "h", "m", "last"), ["conv"], "own")
    kept = kept.where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "d1", "d2", "n", "last")
    heads = turns.where((F.col("conv") % family == 0) & (F.col("pos") < most)).select(F.col("conv").alias("head"), F.col("pos").alias("depth"), "d1", "d2", "n")
    taken = heads.join(plan.select("conv", "base", "m", "last"), (F.col("head") == F.col("base")) & (F.col("depth") <= F.col("m"))).select("conv", "depth", "d1", "d2", "n", "last")
    zero = F.lit(0).cast("long")
    return kept.union(taken).union(plan.select("conv", zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), zero.alias("n"), "last"))


def prefixes(turns: DataFrame) -> DataFrame:
    """turns(conv, depth from 0, d1, d2, n, last) to conv, depth, key, n, last: the key names the turns of depth 1 to depth, and is zero at depth 0."""
    part = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "d1", "d2")).otherwise(0).cast("decimal(20,0)")
    summed = scan(turns, ["conv"], F.floor(F.col("depth") / BLOCK), ["depth"], {"s1": Running(part(1)), "s2": Running(part(2))})
    bits = lambda c: F.pmod(F.col(c), F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")
    return summed.select("conv", "depth", F.struct(bits("s1").alias("p"), bits("s2").alias("q")).alias("key"), "n", "last")


def _paths(members: DataFrame, height: int) -> DataFrame:
    """members(conv, i from 0 without gaps, key, ...) with path: the keys from the last multiple of ``height`` below i up to i - 1."""
    i, band = F.col("i"), F.floor(F.col("i") / height)
    bands = members.withColumn("band", F.explode(F.when((i > 0) & (i % height == 0), F.array(band - 1, band)).otherwise(F.array(band))))
    before = Window.partitionBy("conv", "band").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # at most height rows
    return bands.withColumn("path", F.collect_list("key").over(before)).where((i == 0) | (i > F.col("band") * height)).drop("band")


def subtree_totals(nodes: DataFrame, members: DataFrame, height: int, deepest: int) -> DataFrame:
    """nodes(key, i, path, leaves, saved), members(conv, i, key) to key, leaves, saved (totals of the subtree, its top included) and children."""
    if deepest:
        foot = (deepest - 1) // height
        below = nodes.where("i > 0").groupBy(F.try_element_at("path", F.lit(1)).alias("root")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        roots = members.where(F.col("i") % height == 0).select("conv", F.floor(F.col("i") / height).alias("i"), "key")
        upper = _paths(roots, height).groupBy("key").agg(F.first("i").alias("i"), F.first("path").alias("path")) if foot else None
        if foot:
            upper = stored(upper.join(below, F.col("key") == F.col("root")).drop("root"))
            below = subtree_totals(upper, roots, height, foot).select(F.col("key").alias("root"), F.col("leaves"), F.col("saved"))
        below = below.withColumnsRenamed({"leaves": "more_leaves", "saved": "more_saved"})
        nodes = nodes.join(below, F.col("key") == F.col("root"), "left").withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
    zero = F.lit(0).cast("long")
    own = F.struct(F.col("key"), F.col("leaves"), F.col("saved"), zero.alias("children"))
    inner = lambda place: (place > 0) & (F.col("i") > 0)
    steps = F.transform("path", lambda key, place: F.struct(
        key.alias("key"), F.when(inner(place), F.col("leaves")).otherwise(zero).alias("leaves"), F.when(inner(place), F.col("saved")).otherwise(zero).alias("saved"),
        F.when(place == F.size("path") - 1, F.lit(1)).otherwise(0).cast("long").alias("children")))
    given = nodes.select(F.explode(F.concat(F.array(own), steps)).alias("g")).select("g.*")
    return given.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("children").alias("children"))


def _hash_ends(ends: DataFrame) -> DataFrame:
    """ends(p, q, conv) to p, q, sha: SHA-256 of the ascending ids of each key, comma-joined.

    The hash is sequential by definition, so the ids of one key pass through one task; they are streamed in order and never held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for p, q, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (p, q) != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (p, q), hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["p", "q", "sha"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([state.hexdigest()])], names=["p", "q", "sha"])

    return ends.repartition("p", "q").sortWithinPartitions("p", "q", "conv").mapInArrow(run, "p long, q long, sha string")


def trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """turns(conv, depth from 0, d1, d2, n, last), as ``rebuilt_turns`` gives them, to one row per distinct prefix.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    members = stored(prefixes(turns))
    level = members.withColumnRenamed("depth", "i")
    nodes = _paths(level, height).groupBy("key").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("last") == F.col("i")).alias("n_ends"),
        F.first("i").alias("i"), F.first("n").alias("n"), F.first("path").alias("path"))
    nodes = stored(nodes.withColumn("leaves", (F.col("n_ends") == F.col("n_convs")).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n")))
    deepest = nodes.agg(F.max("i")).first()[0] or 0
    totals = subtree_totals(nodes.select("key", "i", "path", "leaves", "saved"), level.select("conv", "i", "key"), height, deepest)
    totals = totals.select(F.col("key").alias("total_key"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("children").alias("n_children"))
    hashed = _hash_ends(level.where("i = last").select("key.p", "key.q", "conv")).select(F.struct("p", "q").alias("end_key"), "sha")
    full = nodes.join(totals, F.col("key") == F.col("total_key")).join(hashed, F.col("key") == F.col("end_key"), "left")
    full = stored(full.select("key", "conv_id", F.col("i").alias("depth"), F.try_element_at("path", F.lit(-1)).alias("up"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("ends_sha256")))
    parents = full.where("n_children > 0").select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = spread_join(full.where("depth > 0"), parents.withColumnRenamed("n_children", "of"), ["up"], "of").select(*columns)
    return below.union(full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """The trie of rebuilt conversations (see ``rebuilt_turns`` and ``trie``).

    Null roles and texts are empty, null turns come first, turns of equal number are ordered by role and text (repeated rows are turns
    of their own), rows without a conversation are left out. Other columns are ignored, whatever their names. Texts are hashed where
    they are read in order and not moved again. An empty table gives no rows.
    """
    turns = stored(turns_in_order(conversations, conv_col, turn_col, role_col, text_col))
    return trie(rebuilt_turns(turns), height)
