"""Streaming forms of the progress operators: state by clip, snapshots joined with later events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framegrid.operators.service import TERMINAL

TICK = "clip_id long, done long, t long, stage long, final boolean"
SENT = "clip_id long, done long, t long, stage long, seq long"


def throttled(ticks: DataFrame, wait: int = 200, frames: int = 5, forget: int = 3_600_000, at: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(clip_id, done, t, stage, seq) of the ticks to publish; a clip's state is the last one published.

    A tick goes out on a new stage, as the final one, ``wait`` ms or ``frames`` frames after the
    last one published.  A clip's ticks are taken by ``done`` within a micro-batch; the final
    tick ends its state.  With a timestamp column ``at``, whose watermark is ``late`` behind, a
    clip without ticks for ``forget`` ms of event time is forgotten too; such timers ask for no
    batch of their own, so a query over what is there now ends.  With ``frames`` of 0 only stage,
    time and end count, as for previews.
    """
    timed = at is not None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        sent, over = [], False
        rows = pd.concat(list(batches)).sort_values(["done", "t"], kind="stable")
        for done, t, stage, final in rows[["done", "t", "stage", "final"]].itertuples(index=False):
            due = last is None or stage != last[2] or final or t - last[1] >= wait or (frames > 0 and done - last[0] >= frames)
            if due:
                last = (int(done), int(t), int(stage), 0 if last is None else last[3] + 1)
                sent.append((key[0], *last))
            over = over or bool(final)
        if over:
            state.remove()
        else:
            state.update(last)
            if timed:
                newest = int(rows["_at"].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + forget)
        yield pd.DataFrame(sent, columns=["clip_id", "done", "t", "stage", "seq"])

    own = ["clip_id", "done", "t", "stage", "final"]
    if timed:
        ticks = ticks.withWatermark(at, late).withColumn("_at", F.col(at))
        own.append("_at")
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return ticks.select(*own).groupBy("clip_id").applyInPandasWithState(step, SENT, "done long, t long, stage long, seq long", "append", timeout)


def heartbeats(ticks: DataFrame, every: int = 2000, most: int = 1800) -> DataFrame:
    """(clip_id, done, t, beat): the last tick of a clip again after every ``every`` ms without a new one.

    The final tick ends a clip's beats; so do ``most`` beats in a row.  Beats come by the clock,
    so the query runs until it is stopped: it is no query for what is there now.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            done, t, beat = state.get
            if beat + 1 < most:
                state.update((done, t, beat + 1))
                state.setTimeoutDuration(every)
            else:
                state.remove()
            yield pd.DataFrame([(key[0], done, t, beat + 1)], columns=["clip_id", "done", "t", "beat"])
            return
        rows = pd.concat(list(batches)).sort_values(["done", "t"], kind="stable")
        if rows["final"].any():
            if state.exists:
                state.remove()
            return
        state.update((int(rows["done"].iloc[-1]), int(rows["t"].iloc[-1]), 0))
        state.setTimeoutDuration(every)

    keyed = ticks.select("clip_id", "done", "t", "final").groupBy("clip_id")
    return keyed.applyInPandasWithState(step, "clip_id long, done long, t long, beat long", "done long, t long, beat long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def silent(ticks: DataFrame, at: str = "ts", quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(clip_id, first_ts, last_ts, n): runs of ticks that ``quiet`` without one has ended; later ones are dropped after ``late``."""
    runs = ticks.withWatermark(at, late).groupBy("clip_id", F.session_window(at, quiet)).agg(F.min(at).alias("first_ts"), F.max(at).alias("last_ts"), F.count("*").alias("n"))
    return runs.select("clip_id", "first_ts", "last_ts", "n")


def messages(events: DataFrame, keys: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """``keys`` and ``message``: every row as one server-sent event."""
    return events.select(*keys, F.concat(F.lit("data: "), F.to_json(F.struct(*events.columns)), F.lit("\n\n")).alias("message"))


def since_snapshot(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """Events newer than their job's snapshot, and all of jobs that have none; jobs at an end send no more.

    ``snapshot`` is (job_id, seq, status), ``events`` a stream or table of (job_id, seq, ...).
    """
    seen = snapshot.select("job_id", F.col("seq").alias("_seen"), F.col("status").isin(*TERMINAL).alias("_over"))
    joined = events.join(seen, "job_id", "left")
    return joined.where((F.col("_seen").isNull() | (F.col("seq") > F.col("_seen"))) & ~F.coalesce("_over", F.lit(False))).drop("_seen", "_over")


def publish(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch of messages to ``sink`` (frame, batch number); a restart goes on from ``checkpoint``."""
    return messages(events).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
