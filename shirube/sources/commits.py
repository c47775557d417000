"""Several tables that change together: new rows in folders of their own, and one row that says which folders count.

A commit names the head it was made from. The file of the next head is created only if it does not exist yet, so of two writers that
started from one head the second fails and leaves nothing visible. Rows are versions: of a key the newest commit counts.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import newest


class StaleHead(RuntimeError):
    """Somebody else has committed since the store was opened."""


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def head(spark: SparkSession, root: str) -> int:
    """The number of the last commit; 0 where there is none."""
    fs, folder = _fs(spark, f"{root}/heads")
    if not fs.exists(folder):
        return 0
    return max((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)


def _folders(spark: SparkSession, root: str, at: int) -> dict[str, list[str]]:
    if not at:
        return {}
    fs, file = _fs(spark, f"{root}/heads/{at:012d}")
    stream = fs.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, changes: dict[str, DataFrame], base: int, whole: bool = False) -> int:
    """Publish changed rows made from head ``base``; returns the new head, or raises ``StaleHead`` and publishes nothing.

    ``whole``: the rows replace the tables (first load, compaction) instead of being added.
    """
    folders = {} if whole else _folders(spark, root, base)
    for name, rows in changes.items():
        path = f"{root}/{name}/{base + 1:012d}-{uuid.uuid4().hex}"
        rows.withColumn("_commit", F.lit(base + 1)).write.parquet(path)
        folders.setdefault(name, []).append(path)
    fs, file = _fs(spark, f"{root}/heads/{base + 1:012d}")
    try:
        out = fs.create(file, False)  # fails if the file exists
    except Exception as error:  # noqa: BLE001
        if fs.exists(file):
            raise StaleHead(f"head {base} is not the last one") from error
        raise
    try:
        out.write(bytearray(json.dumps(folders).encode()))
    finally:
        out.close()
    return base + 1


def open_store(spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, list[str]], at: int | None = None) -> tuple[dict[str, DataFrame], int]:
    """(tables, head): of each key the row of its newest commit; tables without a key hold all rows. Missing tables are empty."""
    at = head(spark, root) if at is None else at
    folders, tables = _folders(spark, root, at), {}
    for name, schema in schemas.items():
        if name not in folders:
            tables[name] = spark.createDataFrame([], schema)
            continue
        rows = spark.read.schema(f"{schema}, _commit int").parquet(*folders[name])
        if name in keys and len(folders[name]) > 1:
            rows = newest(rows, keys[name], [F.desc("_commit")])
        tables[name] = rows.drop("_commit")
    return tables, at
