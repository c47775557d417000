"""Packing of documents into training windows by best-fit decreasing.

A document of more than a window is first cut into full windows and a rest. Pieces are counted and dealt by a hash over as many
tasks as keep each of them within a bound; each task takes its pieces from the longest to the shortest and puts each into the open window with the least room that
still holds it, which a segment tree indexed by remaining room finds in a few steps. With thousands of pieces a task, only its
last windows stay partly empty.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free_prefix, stored
from .tokens import encoded

WINDOW = 2048
#: The pieces of a task, about: 14 MB of numbers.
PIECES = 200_000
#: With fewer pieces a task, the windows that stay partly empty at its end would count.
FEWEST = 4_000
#: Sequence numbers of a task begin at its partition number times this.
PER_TASK = 1 << 40


class RoomTree:
    """Which amounts of remaining room are open: a segment tree over 0..window whose leaves count open windows."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The least open room of at least ``length``."""
        node, count = length + self.size, self.count
        if count[node]:
            return length
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.size:
            node = 2 * node + (not count[2 * node])
        return node - self.size


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; lengths are taken in the given order, which should be decreasing."""
    tree, open_windows = RoomTree(window), [[] for _ in range(window + 1)]
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, length in enumerate(lengths.tolist()):
        room = tree.tightest(length)
        if room is None:
            own, room, made = made, window, made + 1
        else:
            own = open_windows[room].pop()
            tree.add(room, -1)
        number[i], offset[i] = own, window - room
        if room > length:
            open_windows[room - length].append(own)
            tree.add(room - length, 1)
    return number, offset


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked for.

    Null text is empty and gives one piece with the end id alone. Null ids and repeated rows are cut like any other row.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name, _ in fields}
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), tokenizer, end_id)):
                ids = ids.astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window]
                    for name, value in (("doc_id", doc_id), ("start", start), ("length", len(piece)), ("ids_crc32", zlib.crc32(piece.tobytes())), ("doc_tokens", len(ids))):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(piece.astype(np.int64))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(fields))

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids)


def tasks_for(n_pieces: int, usual: int, per_task: int) -> int:
    return max(1, min(usual, n_pieces // min(FEWEST, per_task)), -(-n_pieces // per_task))


def pack(pieces: DataFrame, window: int = WINDOW, per_task: int = PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, start, length, ...) of at most ``window`` tokens.

    Offsets in a sequence have no gaps. Pieces are written once and counted; they are dealt over the session's shuffle
    partitions, over fewer where a task would get less than ``FEWEST`` and over more where it would get more than about ``per_task``. Equal pieces, and pieces without id,
    are dealt like any others. Where pieces carry their ids, a task holds those too: then ``per_task`` should be smaller. Ties of length
    are placed in the order of doc_id and start. Further columns pass through, save any named sequence_id or offset, which are
    replaced. An empty table gives an empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    columns, place = pieces.columns, f"{free_prefix(pieces)}place"
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    written = stored(pieces.withColumn(place, F.monotonically_increasing_id()))  # so that a rerun deals every piece to the same task
    tasks = tasks_for(written.count(), int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), per_task)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        mine = pd.concat(parts).sort_values(["length", "doc_id", "start", place], ascending=[False, True, True, True], kind="stable", ignore_index=True)[columns]
        number, offset = best_fit(mine["length"].to_numpy(), window)
        base = TaskContext.get().partitionId() * PER_TASK
        step = 50_000
        for at in range(0, len(mine), step):
            yield mine.iloc[at:at + step].assign(sequence_id=base + number[at:at + step], offset=offset[at:at + step])

    return written.repartition(tasks, F.xxhash64("doc_id", "start", place)).mapInPandas(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids, from packed pieces that carry ``ids``. A sequence has at most a window of ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.flatten("_parts.ids").alias("ids"))
