"""Grants on a stream equal grants in a batch, whatever the order and the batches."""
import datetime as dt
import random

from pyspark.sql import functions as F

from shirube.streaming import grants

SCHEMA = "kind string, file_hash string, event_id long, ts timestamp, is_plan boolean, price_key string"
at = lambda s: dt.datetime(2026, 1, 5) + dt.timedelta(seconds=s)


def one_by_one(rows):
    open_, out = {}, set()
    for kind, file, i, ts, is_plan, price in sorted(rows, key=lambda r: (r[3], r[2])):
        if is_plan:
            open_[kind, file] = (i, ts, price)
            continue
        plan = open_.pop((kind, file), None)
        good = plan is not None and plan[2] == price and ts - plan[1] <= dt.timedelta(minutes=30)
        out.add((kind, file, i, plan[0] if good else None, good))
    return out


def made(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice(["report", "registry"]), rng.choice("xyz"), i, at(rng.randrange(40_000)), rng.random() < 0.5, rng.choice(["p", "p", "p", None, "q"])) for i in range(n)]


def rows_of(df):
    return {(r.kind, r.file_hash, r.use_id, r.plan_id, r.granted) for r in df.collect()}


def test_batch_takes_events_in_order(spark):
    rows = made(1)
    got = rows_of(grants.grant_once(spark.createDataFrame(rows, SCHEMA), F.date_trunc("hour", "ts")))
    assert got == one_by_one(rows) and 5 < sum(r[4] for r in got) < len(got)
    assert grants.grant_once(spark.createDataFrame([], SCHEMA), F.to_date("ts")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = made(2)
    plan, first, second = ("report", "w", 900, at(100), True, "p"), ("report", "w", 901, at(200), False, "p"), ("report", "w", 902, at(300), False, "p")
    rows += [plan, first, second]
    random.Random(3).shuffle(rows)
    parts = [sorted(rows[i::3], key=lambda r: r[2]) for i in range(3)]  # every batch has events of all times, plans apart from their uses
    parts.append([("end", "e", 990, at(200_000), True, "p")])
    parts.append([("end", "e", 991, at(300_000), True, "p")])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    try:
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
            stream = grants.grant_stream(spark.readStream.schema(SCHEMA).parquet(src), "12 hours")
            query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(target)
    assert rows_of(got) == one_by_one(rows) and got.count() == len(one_by_one(rows))
    mine = {r.use_id: r.plan_id for r in got.filter("file_hash = 'w'").collect()}
    assert mine == {901: 900, 902: None}
