"""Streaming operators agree with their batch forms."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from framegrid.operators import temporal as T
from framegrid.plans.queries import ticks
from framegrid.streaming import progress as P

from conftest import SF


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(180), "the query doesn't end"
    finally:
        q.stop()
    return q


def test_throttle_equals_batch(spark, tmp_path):
    all_ticks = ticks(spark, SF).select("clip_id", "done", "t", "stage", "final")
    for part in range(3):
        all_ticks.where(F.floor(F.col("done") / 7) % 3 == part).coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
    whole = str(tmp_path / "whole")
    for part in range(3):  # files come by time, so a clip's ticks are spread over micro-batches
        lo, hi = part * 30, part * 30 + 30 if part < 2 else 10**9
        all_ticks.where((F.col("done") >= lo) & (F.col("done") < hi)).coalesce(1).write.mode("append").parquet(whole)
    stream = spark.readStream.schema(P.TICK).option("maxFilesPerTrigger", 1).parquet(whole)
    run(P.throttled(stream), "sent")
    got = {(r.clip_id, r.done) for r in spark.table("sent").collect()}
    want = {(r.clip_id, r.done) for r in T.throttle(all_ticks).collect()}
    assert got == want and want
    firsts = spark.table("sent").groupBy("clip_id").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 for r in firsts)


def test_silent_clips_are_forgotten_by_event_time(spark, tmp_path):
    form = P.TICK + ", ts timestamp"
    src = str(tmp_path / "timed")
    rows = [[(1, 0, 0, 0, False, 0)], [(2, 0, 0, 0, False, 5000)], [(2, 1, 10, 0, False, 5001)], [(1, 1, 10, 0, False, 5002), (2, 2, 20, 0, False, 5002)]]
    for k, part in enumerate(rows):
        df = spark.createDataFrame(part, "clip_id long, done long, t long, stage long, final boolean, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s")
        df.coalesce(1).write.parquet(f"{src}-{k}")
        for file in Path(f"{src}-{k}").glob("*.parquet"):  # files are taken by their time
            os.makedirs(src, exist_ok=True)
            os.utime(file.rename(f"{src}/{k}.parquet"), (1_700_000_000 + 60 * k,) * 2)
    stream = spark.readStream.schema(form).option("maxFilesPerTrigger", 1).parquet(src)
    run(P.throttled(stream, forget=60_000, at="ts", late="1 second"), "timed_ticks")
    # clip 1 was silent for over a minute of event time: its next tick is a first one again; clip 2's is held back
    assert sorted((r.clip_id, r.done, r.seq) for r in spark.table("timed_ticks").collect()) == [(1, 0, 0), (1, 1, 0), (2, 0, 0)]


def test_since_snapshot_and_messages(spark):
    snap = spark.createDataFrame([(1, 5, "running"), (2, 9, "done")], "job_id long, seq long, status string")
    ev = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 10, "c"), (3, 1, "d")], "job_id long, seq long, what string")
    left = P.since_snapshot(snap, ev)
    assert sorted((r.job_id, r.seq) for r in left.collect()) == [(1, 6), (3, 1)]
    text = {r.job_id: r.message for r in P.messages(left).collect()}
    assert text[1] == 'data: {"job_id":1,"seq":6,"what":"b"}\n\n'


def test_publish_and_silent(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "job_id long, seq long, what string").write.parquet(src)
    seen = []
    q = P.publish(spark.readStream.schema("job_id long, seq long, what string").parquet(src), lambda df, n: seen.extend(r.job_id for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [1, 2]
    t = spark.createDataFrame([(1, 0), (1, 1), (1, 9)], "clip_id long, s int").select("clip_id", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.n for r in P.silent(t).collect()) == [1, 2]


def test_heartbeats_until_the_end(spark, tmp_path):
    src = str(tmp_path / "beats")
    ticks = "clip_id long, done long, t long, final boolean"
    spark.createDataFrame([(1, 3, 30, False), (2, 5, 50, False), (3, 9, 90, True)], ticks).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(ticks).parquet(src)
    q = P.heartbeats(stream, every=300, most=3).writeStream.format("memory").queryName("beats").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            if spark.table("beats").count() >= 6:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    got = sorted((r.clip_id, r.done, r.beat) for r in spark.table("beats").collect())
    assert got == [(1, 3, k) for k in (1, 2, 3)] + [(2, 5, k) for k in (1, 2, 3)]


def test_cancel_ends_only_its_own_job(spark):
    import time
    from concurrent.futures import ThreadPoolExecutor

    from framegrid.streaming import control

    def slow(name, seconds):
        def wait(batches):
            for b in batches:
                time.sleep(seconds)
                yield b

        return control.run_job(spark, name, lambda: spark.range(1, numPartitions=1).mapInPandas(wait, "id long").count())

    with ThreadPoolExecutor(2) as pool:
        one, two = pool.submit(slow, "one", 60), pool.submit(slow, "two", 8)
        time.sleep(4)
        control.cancel_job(spark, "one")
        assert two.result(90) == 1
        assert "cancel" in str(one.exception(90)).lower()
