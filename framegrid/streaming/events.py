"""Events of jobs to their subscribers: a snapshot first, then what comes later, until the job's end.

On a stream, state is kept by job: what its last event said, whether it is over, and who listens.
A table holds all arrivals, so there each job's are numbered by windows and joined with its
subscribers; state by job costs a call of Python per job, which millions of jobs don't bear.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framegrid.operators.service import TERMINAL

#: Rows in: the order of arrival ``at``; a subscriber, or a status and a text.
ARRIVALS = "job_id long, at long, subscriber string, status string, body string"
SENT = "job_id long, subscriber string, n long, kind string, message string"
PING = ": ping\n\n"


def sse(payload: dict) -> str:
    return f"data: {json.dumps(payload, ensure_ascii=False, separators=(',', ':'))}\n\n"


class Subscriptions(StatefulProcessor):
    """One job's events for each of its subscribers; ``keepalive`` ms of silence give a ping, where set."""

    def __init__(self, keepalive: int | None = None):
        self.keepalive = keepalive

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, body string")
        self.open = handle.getMapState("open", "subscriber string", "n long")

    def _send(self, job, subscriber: str, n: int, kind: str, message: str) -> tuple:
        return int(job), subscriber, n, kind, message

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (job,) = key
        state = self.last.get() if self.last.exists() else None
        listening = {k[0]: v[0] for k, v in self.open.iterator()} if self.open.exists() else {}
        began, out = set(listening), []
        arrivals = pd.concat(list(rows)).sort_values("at", kind="stable")
        for _, r in arrivals.iterrows():
            if isinstance(r["subscriber"], str):
                who = r["subscriber"]
                if state is None:
                    out.append(self._send(job, who, 0, "missing", sse({"type": "job_status", "job_id": int(job), "status": "failed", "error": {"code": "E_JOB_NOT_FOUND"}})))
                    continue
                out.append(self._send(job, who, 0, "snapshot", sse({"type": "snapshot", "job_id": int(job), "status": state[0], "body": state[1]})))
                if state[0] not in TERMINAL:
                    listening[who] = 0
                continue
            if state is not None and state[0] in TERMINAL:
                continue  # a job that is over says no more
            state = (r["status"], r["body"] if isinstance(r["body"], str) else None)
            for who in sorted(listening):
                listening[who] += 1
                out.append(self._send(job, who, listening[who], "event", sse({"type": "job_status", "job_id": int(job), "status": state[0], "body": state[1]})))
            if state[0] in TERMINAL:
                listening = {}
        if state is not None:
            self.last.update(state)
        for who in began - set(listening):
            self.open.removeKey((who,))
        for who, n in listening.items():
            self.open.updateValue((who,), (n,))
        if self.keepalive:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            if listening:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keepalive)
        yield pd.DataFrame(out, columns=["job_id", "subscriber", "n", "kind", "message"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = sorted((k[0], v[0]) for k, v in self.open.iterator()) if self.open.exists() else []
        if waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keepalive)
        yield pd.DataFrame([self._send(key[0], who, n, "ping", PING) for who, n in waiting], columns=["job_id", "subscriber", "n", "kind", "message"])

    def close(self) -> None:
        pass


def _sent(arrivals: DataFrame) -> DataFrame:
    """``subscribed`` over a table: a subscriber gets its job's event of the number that stood when it came, and all later ones.

    Events are numbered from 1 to the first terminal one; a subscriber that comes again is counted
    from there.  Of arrivals with the same ``at`` events come first.
    """
    event = F.col("subscriber").isNull()
    by = W.partitionBy("job_id").orderBy("at", F.when(event, 0).otherwise(1), "subscriber", "status", "body")
    ends = F.coalesce(event & F.col("status").isin(*TERMINAL), F.lit(False))
    over = F.coalesce(F.max(ends).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    live = arrivals.select("job_id", "at", "subscriber", "status", "body").withColumn("_live", event & ~over)
    marked = live.withColumn("_k", F.sum(F.col("_live").cast("long")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    again = W.partitionBy("job_id", "subscriber").orderBy("at", "_k")
    who = marked.where(~event).select("job_id", "subscriber", F.col("_k").alias("_from"), F.lead("_k").over(again).alias("_to"))
    said = marked.where("_live").select(F.col("job_id").alias("_job"), "_k", "status", "body")
    due = (F.col("_k") == F.col("_from")) | ((F.col("_from") > 0) & (F.col("_k") > F.col("_from")) & (F.col("_to").isNull() | (F.col("_k") <= F.col("_to"))))
    got = who.join(said, (F.col("job_id") == F.col("_job")) & due, "left")
    n = F.coalesce(F.col("_k") - F.col("_from"), F.lit(0))
    kind = F.when(F.col("_k").isNull(), "missing").when(n == 0, "snapshot").otherwise("event")
    told = F.struct(F.when(n == 0, "snapshot").otherwise("job_status").alias("type"), "job_id", "status", "body")
    lost = F.struct(F.lit("job_status").alias("type"), "job_id", F.lit("failed").alias("status"), F.struct(F.lit("E_JOB_NOT_FOUND").alias("code")).alias("error"))
    text = F.when(F.col("_k").isNull(), F.to_json(lost)).otherwise(F.to_json(told, {"ignoreNullFields": "false"}))
    return got.select("job_id", "subscriber", n.alias("n"), kind.alias("kind"), F.concat(F.lit("data: "), text, F.lit("\n\n")).alias("message"))


def subscribed(arrivals: DataFrame, keepalive: int | None = None) -> DataFrame:
    """(job_id, subscriber, n, kind, message): what every subscriber is sent, in the order of n.

    ``arrivals`` (ARRIVALS) holds the events of jobs and their subscribers in one order: a
    subscriber gets the job's last state, then each later event, and nothing after a terminal
    status.  A job that is over takes no more events, and one that isn't known is an error message.
    Pings come by the clock, so with ``keepalive`` a stream runs until it is stopped; a table has
    none.  State of this kind needs Spark's RocksDB store, which is set for the session.
    """
    if not arrivals.isStreaming:
        return _sent(arrivals)
    arrivals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    mode = "ProcessingTime" if keepalive else "None"
    return arrivals.groupBy("job_id").transformWithStateInPandas(Subscriptions(keepalive), SENT, "append", mode)
