"""SNK-1..4: idempotent appends, master snapshots, CSV inventory and per-group results."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.evidence import spreadsheet_safe
from ..operators.adopt import not_imported


def append_absent(new: DataFrame, path: str, keys: list[str]) -> None:
    """SNK-1: append only rows whose key is not stored; a rerun adds nothing."""
    fresh = new.dropDuplicates(keys)
    if exists(new.sparkSession, path):
        stored = new.sparkSession.read.schema(new.schema).parquet(path)
        fresh = not_imported(fresh, stored, keys)
    fresh.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_snapshot(df: DataFrame, root: str) -> str:
    """SNK-2: a master snapshot goes to a new folder, then one small row points to it."""
    target = f"{root}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(target)
    pointer = df.sparkSession.createDataFrame([(target,)], "target string").withColumn("written_at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return target


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    pointer = spark.read.schema("target string, written_at timestamp").parquet(f"{root}/pointer")
    target = pointer.agg(F.max_by("target", "written_at").alias("t")).first().t
    return spark.read.parquet(target)


def export_csv(inventory: DataFrame, path: str) -> None:
    """SNK-3: text cells are guarded against formulas; the first header starts with a byte-order mark."""
    yes_no = lambda c: F.when(F.col(c), "対応済み").otherwise("未対応")
    safe = [(yes_no(f.name) if f.dataType.simpleString() == "boolean" else spreadsheet_safe(F.col(f.name).cast("string"))).alias(f.name) for f in inventory.schema]
    guarded = inventory.select(*safe)
    first = guarded.columns[0]
    guarded.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_results(results: DataFrame, path: str, group: str = "case_id", folders: int = 256) -> None:
    """SNK-4: JSON of each group, under one of a fixed number of folders by the group's hash; a group's rows stay together.

    Reading one group prunes to its folder: ``bucket = pmod(xxhash64(group), folders)``.
    """
    placed = results.withColumn("bucket", F.pmod(F.xxhash64(group), F.lit(folders)).cast("int"))
    (placed.repartition("bucket", group).sortWithinPartitions("bucket", group)
     .write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy("bucket").json(path))
