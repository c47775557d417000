"""A training corpus from raw documents: what is of poor quality, repeated or in a benchmark goes; the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept. All but the last return the columns
of ``documents``; the last returns the pieces of the packed sequences.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirube.llm import decontaminate, line_dedup, near_dedup, packing, resampling
from shirube.llm.common import drop_stored, small_batches, stored, stored_so_far, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling: documents that are not drawn go."""
    small_batches(spark)
    return resampling.keep_sampled(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of a line go from the texts; documents that have nothing left by that go."""
    done = line_dedup.dedup_lines(docs)
    emptied = (F.trim("text") == "") & (F.col("n_exact") + F.col("n_near") > 0)
    kept = done.where(~F.coalesce(emptied, F.lit(False)))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    small_batches(spark)
    return near_dedup.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(packing.cut_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark),
    ("packing", packed),
]

#: Fingerprints, sampling noise and tokenizers are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is written; its other tables and its input are deleted then."""
    docs, begun = table(spark, sf_dir, "documents"), stored_so_far()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
            drop_stored(spark, begun)
    return docs
