"""Token files: the ids of all documents in ascending id order, Simple-8b coded, written and read by Spark.

A file set is a folder of Parquet files, one or more frames in each. A frame is a row: shard and frame number, the ids of the
shard before it, its documents and their lengths, and the coded ids with their block offsets and escapes. Shards follow the
order of the documents. Spark's writer commits whole tasks, so a lost executor leaves no half-written file, and any store that
Spark writes to will do.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .tokens import encoded

FRAME_IDS = 1 << 18
#: Words that an encoder remembers here, where a task holds one frame and nothing else of size.
WORDS = 1_000_000
FRAMES = "shard int, frame int, ids_before long, n_ids long, doc_ids array<long>, doc_lengths array<long>, words binary, block_offsets binary, escapes binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME_IDS) -> None:
    """Encode every text, append the end id, write the ids in ascending document order.

    Null text is empty and gives the end id alone. Null ids come first; rows that repeat an id follow each other in the order
    of their texts' hash. A frame holds ``frame_ids`` ids or one longer document. Other columns are ignored. An empty table
    gives an empty file set.
    """
    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    ordered = rows.repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie").select("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, frame, before = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words, offsets, escapes = simple8b.encode(np.concatenate(held))
            row = {"shard": [shard], "frame": [frame], "ids_before": [before], "n_ids": [size], "doc_ids": [ids], "doc_lengths": [[len(x) for x in held]], "words": [words.astype("<u8").tobytes()], "block_offsets": [offsets.astype("<i8").tobytes()], "escapes": [escapes.astype("<u8").tobytes()]}
            return pa.RecordBatch.from_pydict(row, schema=_FRAME_SCHEMA)

        for batch in batches:
            for doc_id, coded in zip(batch.column(0).to_pylist(), encoded(batch.column(1), tokenizer, end_id, WORDS)):
                ids.append(doc_id)
                held.append(coded)
                size += len(coded)
                if size >= frame_ids:
                    yield flush()
                    frame, before, size = frame + 1, before + size, 0
                    ids, held = [], []
        if held:
            yield flush()

    ordered.mapInArrow(run, FRAMES).write.parquet(path)


_FRAME_SCHEMA = pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("block_offsets", pa.binary()), ("escapes", pa.binary())])


def frame_values(words: bytes, block_offsets: bytes, escapes: bytes, n_ids: int) -> np.ndarray:
    """All ids of a frame."""
    return simple8b.decode(np.frombuffer(words, "<u8"), np.frombuffer(block_offsets, "<i8"), np.frombuffer(escapes, "<u8"), n_ids)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids if asked for.

    Frames decode independently of each other. What is before a shard is a running sum over one row per shard.
    """
    frames = spark.read.schema(FRAMES).parquet(path)
    fields = [("doc_id", pa.int64()), ("_shard", pa.int32()), ("_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = frame_values(row["words"], row["block_offsets"], row["escapes"], row["n_ids"]).astype("<u4")
                lengths = np.array(row["doc_lengths"], dtype=np.int64)
                begins = np.cumsum(lengths) - lengths
                out = {"doc_id": row["doc_ids"], "_shard": [row["shard"]] * len(lengths), "_start": begins + row["ids_before"], "n_tokens": lengths}
                out["ids_crc32"] = [zlib.crc32(values[b:b + n].tobytes()) for b, n in zip(begins, lengths)]
                if with_ids:
                    out["ids"] = [values[b:b + n] for b, n in zip(begins, lengths)]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(fields))

    schema = "doc_id long, _shard int, _start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    documents = frames.mapInArrow(run, schema)
    shards = frames.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    bases = shards.select(F.col("shard").alias("_shard"), (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_base"))
    out = documents.join(bases, "_shard")
    return out.select("doc_id", (F.col("_base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
