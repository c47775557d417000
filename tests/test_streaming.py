"""Streaming results equal the batch results, also after a replay."""
import datetime as dt

from pyspark.sql import functions as F

from shirube.streaming import jobs

T0 = dt.datetime(2026, 1, 5, 9, 0)
at = lambda m: T0 + dt.timedelta(minutes=m)


def test_documents_arrive_once(spark, tmp_path):
    schema = "file_hash string, name string, arrived_at timestamp"
    src, target, ckpt = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.createDataFrame([("a", "a.pdf", at(0)), ("a", "copy.pdf", at(1)), ("b", "b.pdf", at(2))], schema).write.parquet(src)
    jobs.append_documents(jobs.stream_documents(spark, src, schema), target, ckpt).awaitTermination()
    spark.createDataFrame([("a", "late.pdf", at(900)), ("c", "c.pdf", at(901))], schema).write.mode("append").parquet(src)
    jobs.append_documents(jobs.stream_documents(spark, src, schema), target, ckpt).awaitTermination()
    assert sorted(r.file_hash for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_change_feed_ignores_older_and_repeats(spark, tmp_path):
    schema = "case_id string, field_code string, version_id string, value_json string, as_of_date date"
    day = dt.date
    rows = [("k", "fee", "v1", "12000", day(2026, 1, 1)), ("k", "fee", "v2", "13500", day(2026, 2, 1)), ("k", "fee", "v0", "9000", day(2025, 1, 1)), ("k", "fee", "v3", "null", day(2026, 3, 1))]
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).write.parquet(src)
    base = lambda s: s.createDataFrame([("k", "fee", "12000", day(2026, 1, 1))], "case_id string, field_code string, old_json string, old_date date")
    for ck in ("c1", "c2"):  # the second run replays everything
        jobs.stream_diffs(spark.readStream.schema(schema).parquet(src), base, target, str(tmp_path / ck)).awaitTermination()
    assert [(r.version_id, r.new_json) for r in spark.read.parquet(target).collect()] == [("v2", "13500")]


def test_older_reference_date_never_wins(spark):
    rows = [("u", "fee", "2", dt.date(2026, 2, 1), at(1)), ("u", "fee", "1", dt.date(2025, 2, 1), at(9))]
    df = spark.createDataFrame(rows, "unit_id string, field_code string, value_json string, as_of_date date, arrived_at timestamp")
    assert jobs.latest_by_asof(df, ["unit_id", "field_code"]).first().value_json == "2"


def test_silent_job_turns_failed(spark, tmp_path):
    schema = "job_id string, event_id bigint, ts timestamp, status string"
    src = str(tmp_path / "in")
    first = [("j1", 1, at(0), "queued"), ("j1", 2, at(1), "running"), ("j2", 3, at(1), "running"), ("j2", 4, at(2), "done")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(src)
    out, ck = "job_out", str(tmp_path / "ck")
    for extra in ([("j3", 5, at(90), "queued")], [("j3", 6, at(95), "done")], [("j4", 7, at(200), "done")]):
        q = jobs.job_states(spark.readStream.schema(schema).parquet(src), "1 minute").writeStream.outputMode("update").foreachBatch(
            lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(str(tmp_path / out))).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.createDataFrame(extra, schema).coalesce(1).write.mode("append").parquet(src)
    rows = spark.read.parquet(str(tmp_path / out)).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.batch):
        last[r.job_id] = (r.status, r.runs, r.stalled)
    assert last["j1"] == ("failed", 1, True)
    assert last["j2"][0] == "done" and not last["j2"][2]


def test_grants_join_and_once(spark, tmp_path):
    plans = spark.createDataFrame([("p1", "report", "h", "k", at(0)), ("p2", "report", "h", "k", at(10))], "plan_id string, kind string, file_hash string, price_key string, plan_ts timestamp")
    uses = spark.createDataFrame([("u1", "report", "h", "k", at(20)), ("u2", "report", "h", "k", at(25)), ("u3", "report", "h", "other", at(21)), ("u4", "report", "h", "k", at(90))],
                                 "use_id string, kind string, file_hash string, price_key string, use_ts timestamp")
    batch = jobs.match_grants(plans, uses, "5 minutes")
    assert sorted((r.use_id, r.plan_id) for r in batch.collect()) == [("u1", "p1"), ("u1", "p2"), ("u2", "p1"), ("u2", "p2")]
    assert [(r.use_id, r.plan_id) for r in jobs.grant_once(batch).collect()] == [("u1", "p2")]
    plans.write.parquet(str(tmp_path / "p")), uses.write.parquet(str(tmp_path / "u"))
    stream = jobs.match_grants(spark.readStream.schema(plans.schema).parquet(str(tmp_path / "p")), spark.readStream.schema(uses.schema).parquet(str(tmp_path / "u")), "5 minutes")
    q = stream.writeStream.format("memory").queryName("grants").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.use_id, r.plan_id) for r in spark.table("grants").collect()) == sorted((r.use_id, r.plan_id) for r in batch.collect())


def test_pending_queue_stops_at_first_failure(spark):
    pending = spark.createDataFrame([("s1", 1, "a"), ("s1", 2, "b"), ("s1", 3, "c"), ("s2", 1, "d"), ("s3", 1, "e")], "source_id string, ord int, file_hash string")
    cases = spark.createDataFrame([("s1", "k1"), ("s2", "k2")], "source_id string, case_id string")
    failed = spark.createDataFrame([("b",)], "file_hash string")
    got = {r.file_hash: r.status for r in jobs.flush_pending(pending, cases, failed).collect()}
    assert got == {"a": "attached", "b": "failed", "c": "pending", "d": "attached", "e": "waiting"}
