"""Exact dedup by progressive refinement: length, then a hash of the first characters, then a hash of the whole text.

Each level keeps only rows whose key occurs more than once. What survives a level is known to the next scan as a bit table
of fixed size, broadcast; a row whose bit is unset is settled and its text is neither hashed further nor moved. A bit that
is set by chance only costs one more hash, as the last level groups by SHA-256. No text is shuffled, and the largest group
of copies is counted by map-side aggregation.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_case

#: Bits of a level's table are 64 x this many rows; the table is broadcast and holds at most 16 bytes x this many.
WORDS = 1 << 16


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.shiftright(key, 6), F.lit(words)).cast("int")


def _bit(key: Column) -> Column:
    return F.expr("shiftleft(1L, cast(pmod(_key, 64) as int))")


def _repeated(rows: DataFrame, words: int) -> DataFrame:
    """rows(_key): the bit table of keys that more than one row has. At most ``words`` rows."""
    return (
        rows.groupBy("_key").count().where("count > 1").select(_word(F.col("_key"), words).alias("_word"), _bit(F.col("_key")).alias("_bit"))
        .groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    )


def _survivors(rows: DataFrame, bits: DataFrame, words: int) -> DataFrame:
    """Adds _hit: whether the row's _key may be repeated."""
    joined = rows.withColumn("_word", _word(F.col("_key"), words)).join(F.broadcast(bits), "_word", "left")
    return joined.withColumn("_hit", F.coalesce(F.col("_bits").bitwiseAND(_bit(F.col("_key"))) != 0, F.lit(False))).drop("_word", "_bits")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 128, words: int = WORDS, hash_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, full_hash (null where an earlier level settled the row,
    unless ``hash_all`` asks for the hash of every row as part of the result).

    Texts are equal when identical after lower-casing A-Z. The row with the largest id stays. Null text counts as empty, and
    empty texts are copies of each other. Rows that repeat both id and text count in group_size and carry the same decision.
    A null id never wins against another id; a group of null ids keeps none by name (keep_id null, kept true). Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    base = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    length = F.octet_length("_text")
    lengths = base.withColumn("_key", F.xxhash64(length))
    first = _repeated(lengths.select("_key"), words)
    heads = _survivors(lengths, first, words).where("_hit").drop("_hit")
    head_key = F.xxhash64(length, F.substring(fold_case(F.substring("_text", 1, prefix)), 1, prefix))
    second = _repeated(heads.select(head_key.alias("_key")), words)
    # rows that level 1 has settled have a unique length, so their (length, head) is unique as well
    full = _survivors(base.withColumn("_key", head_key), second, words).select("_id", "_key", "_hit", F.when(F.col("_hit") | F.lit(hash_all), F.sha2(fold_case(F.col("_text")), 256)).alias("_hash"))
    # equal texts have equal keys; grouping by both leaves the join a shuffle of its own, so that Spark can split a hot group
    groups = full.where("_hit").groupBy("_hash", "_key").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size")).where("_size > 1").select(F.col("_hash").alias("_group"), "_keep", "_size")
    settled = F.concat_ws(":", F.lit("id"), "_id", "_key")  # spread, where a null key would meet in one task
    joined = full.withColumn("_join", F.when(F.col("_hit"), F.col("_hash")).otherwise(settled)).join(groups, F.col("_join") == F.col("_group"), "left")
    keep = F.when(F.col("_group").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(F.col("_id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("_id")).alias("kept"), F.col("_hash").alias("full_hash"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the copies that go, all columns kept. Ids are taken to be unique here."""
    gone = mark_copies(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
