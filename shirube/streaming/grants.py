"""STR-6: once-only grants of priced plans, the same in a batch and on a stream.

Of one kind and file the last plan before a use is what it may draw on, and a use takes that plan away, whether it is granted or not: it
is granted where the plan is at most half an hour old and has the same price settings. So a plan grants once at most.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.ordered import Last, scan

GRANTS = "kind string, file_hash string, use_id long, use_ts timestamp, plan_id long, granted boolean"
KEYS = ["kind", "file_hash"]


def grant_once(events: DataFrame, bucket: Column, minutes: int = 30) -> DataFrame:
    """Rows of ``GRANTS`` for every use of a batch. ``events``: kind, file_hash, event_id, ts, is_plan, price_key.

    ``plan_id`` is the plan that granted. Plans of a key may be many: the scan along ``bucket`` (a day of ts) spreads them over tasks.
    """
    seen = scan(events, KEYS, bucket, ["ts", "event_id"], {"_before": Last(F.struct("is_plan", "ts", "event_id", "price_key"), inclusive=False)})
    plan = F.col("_before")
    fits = plan["is_plan"] & plan["price_key"].eqNullSafe(F.col("price_key")) & (F.col("ts") <= plan["ts"] + F.expr(f"interval {minutes} minutes"))
    granted = F.coalesce(fits, F.lit(False))
    return seen.filter(~F.col("is_plan")).select(*KEYS, F.col("event_id").alias("use_id"), F.col("ts").alias("use_ts"), F.when(granted, plan["event_id"]).alias("plan_id"), granted.alias("granted"))


class _Grants(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then takes them in order; of the past only the open plan is kept."""

    def __init__(self, minutes: int):
        self.life = pd.Timedelta(minutes=minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, event_id long, is_plan boolean, price_key string")
        self.plan = handle.getValueState("plan", "ts long, event_id long, price_key string")

    def _settle(self, key: tuple, rows: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        due = sorted(r for r in rows if r[0] <= watermark_ms * 1000)
        later = [r for r in rows if r[0] > watermark_ms * 1000]
        plan, out = self.plan.get() if self.plan.exists() else None, []
        for ts, event_id, is_plan, price in due:
            if is_plan:
                plan = (ts, event_id, price)
                continue
            granted = plan is not None and plan[2] == price and ts - plan[0] <= self.life // pd.Timedelta(microseconds=1)
            out.append((*key, event_id, pd.Timestamp(ts, unit="us"), plan[1] if granted else None, granted))
            plan = None
        if due:
            if plan is None:
                self.plan.clear()
            else:
                self.plan.update(plan)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-min(r[0] for r in later) // 1000))
        else:
            self.waiting.clear()
        if out:
            frame = pd.DataFrame(out, columns=["kind", "file_hash", "use_id", "use_ts", "plan_id", "granted"])
            yield frame.astype({"plan_id": "Int64"})

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for frame in rows:
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            price = [p if isinstance(p, str) else None for p in frame["price_key"]]
            held += list(zip(micros.tolist(), frame["event_id"].tolist(), frame["is_plan"].tolist(), price))
        yield from self._settle(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def grant_stream(events: DataFrame, delay: str, minutes: int = 30) -> DataFrame:
    """Rows of ``GRANTS`` for every use of a stream of ``events`` (as for ``grant_once``), once the watermark has passed it.

    Events may arrive in any order and over any number of batches within ``delay``; older ones are left out by the watermark. A replay
    from the checkpoint gives the same rows. Needs the RocksDB state store.
    """
    marked = events.withWatermark("ts", delay).groupBy(*KEYS)
    return marked.transformWithStateInPandas(_Grants(minutes), GRANTS, "append", "EventTime")
