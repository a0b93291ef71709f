"""The job queue as a stream: keyed state per job with timers for leases.

Events of a job apply in order of time. A claim takes a runnable job, or one whose lease has run out, under the next attempt and a
lease; heartbeats, completions and failures hold only for the attempt that has the lease (the fence). A failure waits for a backoff with
jitter or, at the last attempt, ends the job. A lease that runs out at the last attempt ends it too: a timer does so when the
watermark passes, and an event of a later time finds it done, so the answer doesn't depend on where micro-batches end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.jobs import LEASE_MS, MOST_ATTEMPTS
from ..schemas import Job

PENDING, RUNNING, DONE, FAILED, DEAD = (int(x) for x in (Job.PENDING, Job.RUNNING, Job.DONE, Job.FAILED, Job.DEAD))
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = "state int, attempts int, due long, change long"
CHANGES = "id long, at long, event string, accepted boolean, state int, attempts int, next_attempt_at long, change long"


class Held(NamedTuple):
    """A job: ``due`` is the end of its lease or wait, ``change`` counts its changes."""

    state: int
    attempts: int
    due: int | None
    change: int


class Rules(NamedTuple):
    lease_ms: int = LEASE_MS
    most_attempts: int = MOST_ATTEMPTS
    backoff_ms: int = 1000
    most_backoff_ms: int = 300_000

    def expired(self, job: Held | None, now: int) -> Held | None:
        """The job after the time ``now`` has come: dead if its last lease has run out."""
        if job is not None and job.state == RUNNING and job.due <= now and job.attempts >= self.most_attempts:
            return Held(DEAD, job.attempts, None, job.change + 1)
        return job

    def wait(self, attempts: int, draw: float) -> int:
        """Half the ceiling and, by ``draw`` in 0..1, up to as much again."""
        ceiling = min(self.most_backoff_ms, self.backoff_ms * 2 ** min(attempts - 1, 40))
        return max(1, int(ceiling / 2 * (1 + draw) + 0.5))

    def after(self, job: Held | None, at: int, event: str, attempt: int, draw: float) -> Held | None:
        """The job after an event, or None if the event holds nothing (an unknown job, a lost lease, a wait not over)."""
        if job is None:
            return Held(PENDING, 0, at, 1) if event == "enqueue" else None
        n = job.change + 1
        if event == "claim" and job.state in (PENDING, FAILED, RUNNING) and job.due <= at and (job.state != RUNNING or job.attempts < self.most_attempts):
            return Held(RUNNING, job.attempts + 1, at + self.lease_ms, n)
        if job.state != RUNNING or attempt != job.attempts:
            return None
        if event == "heartbeat":
            return Held(RUNNING, job.attempts, at + self.lease_ms, n)
        if event == "complete":
            return Held(DONE, job.attempts, None, n)
        if event == "fail":
            return Held(DEAD, job.attempts, None, n) if job.attempts >= self.most_attempts else Held(FAILED, job.attempts, at + self.wait(job.attempts, draw), n)
        return None


class Leases(StatefulProcessor):
    """One row out for each event, and one when a timer ends a job."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", HELD)

    def _held(self) -> Held | None:
        return Held(*self.job.get()) if self.job.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job, out = self._held(), []
        before = job
        for at, _, event, attempt, draw in _in_order(rows):  # a job's events of one micro-batch
            at, attempt = int(at), -1 if pd.isna(attempt) else int(attempt)
            ended = self.rules.expired(job, at)
            if ended is not job:
                out.append((key[0], job.due, "reap", True, *ended))
                job = ended
            now = self.rules.after(job, at, event, attempt, 0.0 if pd.isna(draw) else float(draw))
            if now is not None:
                job = now
            out.append((key[0], at, event, now is not None, *(job or (None, 0, None, 0))))
        if job is not None and job != before:
            self._timer(before, job)
            self.job.update(tuple(job))
        yield _rows(out)

    def _timer(self, before: Held | None, job: Held) -> None:
        if before is not None and before.state == RUNNING:
            self.handle.deleteTimer(before.due)
        if job.state == RUNNING:
            self.handle.registerTimer(job.due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self._held()
        ended = self.rules.expired(job, expiredTimerInfo.getExpiryTimeInMs())
        if ended is not job:
            self.job.update(tuple(ended))
            yield _rows([(key[0], job.due, "reap", True, *ended)])
        else:
            yield _rows([])

    def close(self) -> None:
        pass


def _in_order(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    """(at, seq, event, attempt, draw) by at and seq, nulls last. Jobs have few events, so lists are sorted: a frame made for each job would cost more than its events."""
    found = [row for f in frames for row in zip(*(f[c].tolist() for c in ("at", "seq", "event", "attempt", "draw")), strict=True)]
    return sorted(found, key=lambda e: (e[0], pd.isna(e[1]), 0 if pd.isna(e[1]) else e[1]))


KINDS = {"id": "int64", "at": "int64", "event": "object", "accepted": "bool", "state": "Int32", "attempts": "int32", "next_attempt_at": "Int64", "change": "int64"}


def _rows(rows: list[tuple]) -> pd.DataFrame:
    """One frame, made column by column: types set afterwards would make each column twice."""
    columns = zip(*rows, strict=True) if rows else [()] * len(KINDS)
    return pd.DataFrame({name: pd.array(c, kind) if kind[0] == "I" else np.array(c, kind) for (name, kind), c in zip(KINDS.items(), columns, strict=True)})


def changes(events: DataFrame, late: str = "0 seconds", rules: Rules = Rules()) -> DataFrame:
    """What each event of the stream (id, at in ms, seq, event, attempt, draw) did, and what timers did: (id, at, event, accepted, state, attempts,
    next_attempt_at, change). Events that come more than ``late`` behind are left out."""
    timed = events.withColumn("_time", F.timestamp_millis("at")).withWatermark("_time", late)
    return timed.groupBy("id").transformWithStateInPandas(statefulProcessor=Leases(rules), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def latest(done: DataFrame) -> DataFrame:
    """(id, state, attempts, next_attempt_at, n_changes) after the last change of each job in ``done``; jobs never enqueued are left out."""
    last = done.where("state is not null").groupBy("id").agg(F.max_by(F.struct("state", "attempts", "next_attempt_at"), "change").alias("v"), F.max("change").alias("n_changes"))
    return last.select("id", "v.*", "n_changes")


def run(stream: DataFrame, path: str, checkpoint: str, fault: Callable[[int], None] | None = None) -> StreamingQuery:
    """Write the stream's micro-batches to ``path`` until nothing is left, under keyed state. A batch that runs again replaces what it wrote, so a
    restart after a loss at any point repeats nothing. ``fault`` is called with a batch's number after it is written (tests)."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if fault is not None:
            fault(number)

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
