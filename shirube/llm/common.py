"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of this machine only in local mode and where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Of a batch of rows on its way to or from a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of at most ``BATCH_BYTES``, from now on in this session, unless it has a smaller limit.

    Spark's batches of 10,000 texts, of which the worker and the executor beside it hold several, grow with the length of the texts.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None)
    if own is None or not own.isdigit() or int(own) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_written: list[str] = []  # what this driver has stored and not deleted


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back, so that a lost executor loses nothing.

    The files stay until they are deleted (``drop_stored``, ``clear``), as a returned DataFrame may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_so_far() -> int:
    return len(_written)


def drop_stored(spark: SparkSession, since: int) -> None:
    """Delete what was stored after the first ``since`` tables, save the last one. Call it when only the last is still read."""
    for path in _written[since:-1]:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    del _written[since:-1]


def clear(spark: SparkSession) -> None:
    """Delete what ``stored`` has written for this session's folder. Call it when no result is read any more."""
    jvm, folder = spark.sparkContext._jvm, shared_folder(spark)
    glob = jvm.org.apache.hadoop.fs.Path(f"{folder}/llm-*")
    fs = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(glob) or []:
        fs.delete(status.getPath(), True)


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, for the names of columns that an operator adds for itself."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def fold_case(text: Column) -> Column:
    """A-Z to a-z and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


#: A key counts as frequent if it has more than one in this many of all rows, so there are fewer such keys than this.
FREQUENT = 4096


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], count_col: str, salts: int = 32) -> DataFrame:
    """Inner equi-join of ``rows`` with ``lookup``, which has one row per key and the number of ``rows`` with that key in ``count_col``.

    The rows of a frequent key are dealt over ``salts`` tasks and its lookup row is repeated for each. Frequent keys are broadcast
    by a hash: there are fewer than ``FREQUENT`` of them at any size. Returns the columns of ``rows`` and the further ones of ``lookup``.
    """
    counts = lookup.select(F.xxhash64(*keys).alias("_hot"), F.col(count_col).alias("_n"))
    hot = counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all")))).where(F.col("_n") * FREQUENT > F.col("_all"))  # one row against each
    hot = F.broadcast(hot.select("_hot").distinct())

    def flagged(df: DataFrame, prefix: str, salt: Column) -> DataFrame:
        named = df.select(*[F.col(c).alias(prefix + c) for c in df.columns], F.xxhash64(*keys).alias(f"{prefix}hash"))
        return named.join(hot, F.col(f"{prefix}hash") == F.col("_hot"), "left").withColumn(f"{prefix}salt", salt).drop("_hot", f"{prefix}hash")

    frequent = F.col("_hot").isNotNull()
    dealt = flagged(rows, "_r_", F.when(frequent, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0).cast("int"))
    copies = flagged(lookup, "_l_", F.explode(F.when(frequent, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    on = F.col("_r_salt") == F.col("_l_salt")
    for k in keys:
        on = on & (F.col(f"_r_{k}") == F.col(f"_l_{k}"))
    return dealt.join(copies, on).select(*[F.col(f"_r_{c}").alias(c) for c in rows.columns], *[F.col(f"_l_{c}").alias(c) for c in lookup.columns if c not in keys])
