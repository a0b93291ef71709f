"""The job queue as an event log: a deterministic reducer per job, claims and leases as batch steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..schemas import Job

LEASE_MS, MOST_ATTEMPTS = 60_000, 5
STATE = "id long, state int, attempts int, next_attempt_at long, last_event_at long"


def reduce_events(events: DataFrame, lease_ms: int = LEASE_MS, most_attempts: int = MOST_ATTEMPTS, backoff_ms: int = 1000, most_backoff_ms: int = 300_000) -> DataFrame:
    """Job states from (id, at, event, attempt): enqueue, claim, heartbeat, complete, fail, reap.

    Events of a job apply in order of time; complete, fail and heartbeat hold only for the attempt that has the
    lease, so a late worker changes nothing. A job's events are one group, bounded by its attempts.
    """

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, attempts, due, last = None, 0, 0, 0
        for at, event, attempt in rows.sort_values(["at", "seq"])[["at", "event", "attempt"]].itertuples(index=False):
            last, ours = int(at), attempt == attempts
            if event == "enqueue" and state is None:
                state, due = Job.PENDING, last
            elif event == "claim" and state is not None and (state in (Job.PENDING, Job.FAILED) and due <= at or state == Job.RUNNING and due <= at and attempts < most_attempts):
                state, attempts, due = Job.RUNNING, attempts + 1, last + lease_ms
            elif event == "heartbeat" and state == Job.RUNNING and ours:
                due = last + lease_ms
            elif event == "complete" and state == Job.RUNNING and ours:
                state = Job.DONE
            elif event == "fail" and state == Job.RUNNING and ours:
                state = Job.DEAD if attempts >= most_attempts else Job.FAILED
                due = last + max(1, min(most_backoff_ms, backoff_ms * 2 ** (attempts - 1)))
            elif event == "reap" and state == Job.RUNNING and due <= at and attempts >= most_attempts:
                state = Job.DEAD
        return pd.DataFrame([(int(key[0]), None if state is None else int(state), attempts, due, last)], columns=["id", "state", "attempts", "next_attempt_at", "last_event_at"])

    return events.groupBy("id").applyInPandas(step, STATE)


def runnable(jobs: DataFrame, now: int) -> DataFrame:
    return jobs.where(F.col("state").isin(int(Job.PENDING), int(Job.FAILED)) & (F.col("next_attempt_at") <= now))


def claim(jobs: DataFrame, now: int, n: int = 1, lease_ms: int = LEASE_MS, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """The next ``n`` jobs as they are after the claim: runnable ones by priority, time and id, then those
    whose lease has run out."""
    expired = (F.col("state") == int(Job.RUNNING)) & (F.col("next_attempt_at") <= now) & (F.col("attempts") < most_attempts)
    ready = F.col("state").isin(int(Job.PENDING), int(Job.FAILED)) & (F.col("next_attempt_at") <= now)
    taken = jobs.where(ready | expired).orderBy(F.when(ready, 0).otherwise(1), "priority", "next_attempt_at", "id").limit(n)
    return taken.withColumn("state", F.lit(int(Job.RUNNING))).withColumn("attempts", F.col("attempts") + 1).withColumn("next_attempt_at", F.lit(now + lease_ms).cast("long"))


def reap(jobs: DataFrame, now: int, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """Jobs after abandoned ones (lease run out at the last attempt) are dead."""
    dead = (F.col("state") == int(Job.RUNNING)) & (F.col("next_attempt_at") <= now) & (F.col("attempts") >= most_attempts)
    return jobs.withColumn("state", F.when(dead, int(Job.DEAD)).otherwise(F.col("state")))


def fail(jobs: DataFrame, now: int, draw, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """Running jobs after a failure: retried after a delay, or dead."""
    dead = F.col("attempts") >= most_attempts
    return jobs.withColumn("next_attempt_at", F.lit(now) + expr.backoff_delay(F.col("attempts"), draw)).withColumn("state", F.when(dead, int(Job.DEAD)).otherwise(int(Job.FAILED)))


def dead_letters(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.where(F.col("state") == int(Job.DEAD)).orderBy("id").limit(limit)
