"""The job table under concurrent changes, refusals, and events that end."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from framegrid.operators import jobtable as J
from framegrid.streaming import events as E


@pytest.fixture
def table(spark, tmp_path):
    t = J.JobTable(spark, f"file://{tmp_path}/jobs")
    rows = [(k, "queued" if k < 6 else "running" if k == 6 else "done", f"2024-01-0{1 + k % 3} 00:00:00") for k in range(8)]
    t.create(spark.createDataFrame(rows, "job_id long, status string, created_at string").selectExpr("job_id", "status", "cast(created_at as timestamp) as created_at", "cast(null as timestamp) as started_at"))
    return t


def statuses(t):
    return {r.job_id: r.status for r in t.read().collect()}


def test_two_claims_of_one_job(spark, table):
    tables = [J.JobTable(spark, table.root) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda t: t.claim(job_id=3), tables))
    assert sorted(won) == [[], [], [], [3]] and statuses(table)[3] == "running"
    with ThreadPoolExecutor(3) as pool:
        won = [x for w in pool.map(lambda t: t.claim(), tables[:3]) for x in w]
    assert sorted(won) == [0, 1, 4]  # oldest first: 0 and 3 are of the first day, 1 and 4 of the second
    assert table.claim(job_id=99) == [] and table.claim(most=9) == [2, 5] and table.claim() == []


def test_a_conflict_works_the_change_out_again(spark, table):
    seen = []

    def work(held):
        seen.append(held.where("status = 'queued'").count())
        if len(seen) == 1:
            J.JobTable(spark, table.root).cancel(0)  # comes first
        return held.where("job_id = 1").selectExpr("job_id", "'failed' as status", "created_at", "started_at")

    before = table.version()
    assert [r.job_id for r in table.change(work).collect()] == [1]
    assert seen == [6, 5] and table.version() == before + 2 and statuses(table)[0] == "cancelled" and statuses(table)[1] == "failed"


def test_refusals_and_old_versions(spark, table):
    with pytest.raises(J.JobError, match="E_JOB_RUNNING"):
        table.delete(6)
    with pytest.raises(J.JobError, match="E_JOB_NOT_FOUND"):
        table.delete(77)
    with pytest.raises(J.JobError, match="E_JOB_EXISTS"):
        table.create(table.read().limit(1))
    table.delete(7)
    assert 7 not in statuses(table) and 7 in {r.job_id for r in table.read(1).collect()}
    assert table.cancel(2) and not table.cancel(2) and not table.cancel(6)
    with pytest.raises(J.JobError):
        J.JobTable(spark, table.root + "-none").read()
    assert J.JobTable(spark, table.root + "-none").claim() == []


def test_versions_are_written_whole_now_and_then(spark, table, monkeypatch):
    monkeypatch.setattr(J, "WHOLE", 3)
    for k in range(6):
        table.set_status(k, "failed", ("queued",))
    assert len(table._folders(table.version())) <= 3
    assert statuses(table) == {**{k: "failed" for k in range(6)}, 6: "running", 7: "done"}


def test_no_attempt_is_left(spark, table, monkeypatch):
    monkeypatch.setattr(J, "ATTEMPTS", 2)
    with pytest.raises(J.Conflict):
        table.change(lambda held: (J.JobTable(spark, table.root).change(lambda h: h.where("job_id = 5")), held.where("job_id = 4"))[1])


def test_streams_of_events_end(spark, tmp_path):
    rows = [[(1, 0, None, "running", "a"), (1, 1, "s1", None, None), (2, 0, "s1", None, None)], [(1, 2, None, "running", "b"), (1, 3, "s2", None, None), (2, 1, None, "running", None)], [(1, 4, None, "done", "c"), (1, 5, None, "done", "late"), (1, 6, "s3", None, None)]]
    sent = []
    for k, part in enumerate(rows):
        spark.createDataFrame(part, E.ARRIVALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(E.ARRIVALS).parquet(str(tmp_path / "in"))
        q = E.subscribed(stream).writeStream.foreachBatch(lambda df, n: sent.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)  # each run goes on where the last one ended
    got = sorted((r.job_id, r.subscriber, r.n, r.kind) for r in sent)
    assert got == [(1, "s1", 0, "snapshot"), (1, "s1", 1, "event"), (1, "s1", 2, "event"), (1, "s2", 0, "snapshot"), (1, "s2", 1, "event"), (1, "s3", 0, "snapshot"), (2, "s1", 0, "missing")]
    assert [r.message for r in sent if r.subscriber == "s3"] == [E.sse({"type": "snapshot", "job_id": 1, "status": "done", "body": "c"})]


def test_tables_of_arrivals_say_what_streams_say(spark, tmp_path):
    rows = [
        (1, -1, "early", None, None), (1, 0, None, "queued", 'a "b"\n\u00e9'), (1, 1, "s", None, None), (1, 2, None, "running", None), (1, 3, "s", None, None), (1, 4, "t", None, None), (1, 5, None, "running", "c"), (1, 6, "early", None, None), (1, 7, None, "failed", "d"),
        (1, 8, None, "running", "late"), (1, 9, "s", None, None), (2, 0, "s", None, None), (3, 0, None, "done", "x"), (3, 1, "s", None, None), (3, 2, "s", None, None),
    ]
    spark.createDataFrame(rows, E.ARRIVALS).coalesce(1).write.parquet(str(tmp_path / "in"))
    sent = []
    stream = spark.readStream.schema(E.ARRIVALS).parquet(str(tmp_path / "in"))
    q = E.subscribed(stream).writeStream.foreachBatch(lambda df, n: sent.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    table = E.subscribed(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, sent)) and len(sent) == 15
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "TransformWithState" not in plan and "Python" not in plan  # no call of Python per job


def test_silence_gives_pings(spark, tmp_path):
    spark.createDataFrame([(1, 0, None, "running", None), (1, 1, "s", None, None), (2, 0, None, "done", None), (2, 1, "s", None, None)], E.ARRIVALS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(E.ARRIVALS).parquet(str(tmp_path / "in"))
    q = E.subscribed(stream, keepalive=300).writeStream.format("memory").queryName("pings").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            pings = spark.table("pings").where("kind = 'ping'").collect()
            if len(pings) >= 2:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert len(pings) >= 2 and {(r.job_id, r.subscriber, r.message) for r in pings} == {(1, "s", E.PING)}
