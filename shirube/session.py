"""Session helpers shared by jobs, tests and the benchmark."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # of an execution, when it ends


def local_session(name: str = "shirube", cpus: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for one machine (tests, benchmark). Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over the session's shuffle partitions by key before costly work on each of them.

    A table that comes in one file, or in few row groups, is otherwise read and worked on by as few tasks. The number is given,
    so that adaptive execution does not join partitions whose rows are small but slow.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once, as compressed Parquet in the shared folder named by ``spark.checkpoint.dir``, and read them back.

    A checkpoint would keep the rows uncompressed and work out its last stage twice, for a count and for the files. A machine-local
    folder is used only when the session names none and runs in local mode. The files stay, as results may still read them; what was
    shuffled to make them goes at once, where it would stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    shared = context.getCheckpointDir()
    if shared is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.setCheckpointDir(shared)
    names = [c.lower() for c in df.columns]
    if "void" in df.schema.simpleString() or len(set(names)) < len(names):  # what Parquet does not hold
        return df.checkpoint()
    path = f"{shared.rstrip('/')}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
