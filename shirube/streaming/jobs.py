"""STR-1..7. Every sink is replay-safe: checkpoint plus the append-absent keys."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import append_absent


def stream_documents(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """STR-1: arriving documents. None is dropped for being late; the sink (``append_documents``) keeps each content once."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def append_documents(stream: DataFrame, target: str, checkpoint: str):
    """STR-1 sink: all-time dedupe by content hash."""
    return (stream.writeStream.foreachBatch(lambda batch, _: append_absent(batch, target, ["file_hash"]))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_diffs(values: DataFrame, baseline: Callable[[SparkSession], DataFrame], target: str, checkpoint: str):
    """STR-2: changes of arriving values against the baseline, re-read for every batch.

    ``baseline``: case_id, field_code, old_json, old_date. Older data never makes a change.
    """
    def changes(batch: DataFrame, _: int) -> None:
        append_absent(diff_batch(batch, baseline(batch.sparkSession)), target, ["case_id", "field_code", "version_id", "old_json"])

    return values.writeStream.foreachBatch(changes).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def diff_batch(values: DataFrame, base: DataFrame) -> DataFrame:
    joined = values.join(base, ["case_id", "field_code"], "left")
    older = F.coalesce(F.col("as_of_date") < F.col("old_date"), F.lit(False))
    absent = F.col("value_json").isNull() | (F.col("value_json") == "null")
    return joined.filter(~absent & ~F.col("value_json").eqNullSafe(F.col("old_json")) & ~older).select(
        "case_id", "field_code", "version_id", "old_json", F.col("value_json").alias("new_json"), "as_of_date")


def latest_by_asof(values: DataFrame, keys: list[str]) -> DataFrame:
    """STR-3: the value with the newest reference date wins, whenever it arrives; batch and update mode."""
    return values.groupBy(*keys).agg(F.max_by("value_json", F.struct("as_of_date", "arrived_at")).alias("value_json"), F.max("as_of_date").alias("as_of_date"))


JOB_STATE = "status string, runs int, updated_at timestamp"


def job_states(events: DataFrame, delay: str, minutes: int = 25, live: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """STR-4, STR-5: latest status and run count per job; a live job silent for 25 minutes turns failed.

    One small state row per job; late events never replace a newer status. The state outlives a silence, so a job that
    resumes goes on counting its runs. ``delay``: how late an event may be before it is left out of the count.
    """
    schema = "job_id string, status string, runs int, updated_at timestamp, stalled boolean"

    def advance(key, batches, state: GroupState):
        status, runs, at = state.get if state.exists else (None, 0, None)
        if state.hasTimedOut:
            state.update((status, runs, at))
            yield pd.DataFrame([(key[0], "failed", runs, at, True)], columns=["job_id", "status", "runs", "updated_at", "stalled"])
            return
        for batch in batches:
            runs += int((batch["status"] == "running").sum())
            newest = batch.sort_values(["ts", "event_id"]).iloc[-1]
            if at is None or newest["ts"] >= pd.Timestamp(at):
                status, at = newest["status"], newest["ts"].to_pydatetime()
        state.update((status, runs, at))
        if status in live:
            due = int(pd.Timestamp(at).timestamp() * 1000) + minutes * 60_000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], status, runs, at, False)], columns=["job_id", "status", "runs", "updated_at", "stalled"])

    return (events.withWatermark("ts", delay).groupBy("job_id")
            .applyInPandasWithState(advance, schema, JOB_STATE, "update", GroupStateTimeout.EventTimeTimeout))


def match_grants(plans: DataFrame, uses: DataFrame, delay: str, minutes: int = 30) -> DataFrame:
    """STR-6: a use within its plan's lifetime, same kind, hash and price settings.

    ``plans``: plan_id, kind, file_hash, price_key, plan_ts; ``uses``: use_id, kind, file_hash, price_key, use_ts.
    ``delay``: how late a row of either stream may be and still find its partner.
    """
    p = plans.select(F.col("plan_id"), F.col("kind").alias("_k"), F.col("file_hash").alias("_h"), F.col("price_key").alias("_p"), "plan_ts").withWatermark("plan_ts", delay)
    u = uses.withWatermark("use_ts", delay)
    within = (F.col("use_ts") >= F.col("plan_ts")) & (F.col("use_ts") <= F.col("plan_ts") + F.expr(f"interval {minutes} minutes"))
    same = (F.col("kind") == F.col("_k")) & (F.col("file_hash") == F.col("_h")) & (F.col("price_key") == F.col("_p"))
    return u.join(p, same & within).select("use_id", "plan_id", "kind", "file_hash", "plan_ts", "use_ts")


def grant_once(matches: DataFrame) -> DataFrame:
    """STR-6, per batch or over a stored match table: the latest plan grants, each plan and each use once."""
    from ..operators.ordered import newest
    by_use = newest(matches, ["use_id"], [F.desc("plan_ts"), F.asc("plan_id")])
    return newest(by_use, ["plan_id"], [F.asc("use_ts"), F.asc("use_id")])


def flush_pending(pending: DataFrame, cases: DataFrame, failed: DataFrame) -> DataFrame:
    """STR-7: waiting documents of entities that now have a case, in order; an entity stops at its first failure.

    ``pending``: source_id, ord, file_hash; ``cases``: source_id, case_id; ``failed``: file_hash that cannot be read.
    """
    joined = pending.join(cases, "source_id", "left").join(failed.select("file_hash").dropDuplicates().withColumn("_bad", F.lit(True)), "file_hash", "left")
    first_bad = joined.filter("_bad").groupBy("source_id").agg(F.min("ord").alias("_stop"))
    cut = joined.join(first_bad, "source_id", "left")
    status = (F.when(F.col("case_id").isNull(), "waiting").when(F.col("ord") < F.coalesce("_stop", F.lit(2**31 - 1)), "attached")
              .when(F.col("ord") == F.col("_stop"), "failed").otherwise("pending"))
    return cut.select("source_id", "case_id", "ord", "file_hash", status.alias("status"))


def stream_flush(pending: DataFrame, cases: Callable[[SparkSession], DataFrame], failed: Callable[[SparkSession], DataFrame], target: str, checkpoint: str):
    """STR-7 sink: attached documents of each batch, appended once."""
    def flush(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        done = flush_pending(batch, cases(spark), failed(spark)).filter("status = 'attached'")
        append_absent(done, target, ["source_id", "file_hash"])

    return pending.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
