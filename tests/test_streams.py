"""Keyed streams against plain walks, restarts, and the merge in order against a fold."""

import random
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from silverquill.operators import sync
from silverquill.streaming import leases, versions

EVENTS = "id long, at long, seq long, event string, attempt int, draw double"
RULES = leases.Rules(lease_ms=100, most_attempts=3, backoff_ms=10, most_backoff_ms=40)


def walk(events, rules, until):
    """Every job's last state by applying events in order; leases that ran out by ``until`` end."""
    jobs = {}
    for id_, at, _, event, attempt, draw in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        state, tries, due, n = jobs.get(id_, (None, 0, None, 0))
        if state == 1 and due <= at and tries >= rules.most_attempts:
            state, due, n = 4, None, n + 1
        if state is None:
            if event == "enqueue":
                state, due, n = 0, at, n + 1
        elif event == "claim" and state in (0, 1, 3) and due <= at and not (state == 1 and tries >= rules.most_attempts):
            state, tries, due, n = 1, tries + 1, at + rules.lease_ms, n + 1
        elif state == 1 and attempt == tries and event in ("heartbeat", "complete", "fail"):
            n += 1
            if event == "heartbeat":
                due = at + rules.lease_ms
            elif event == "complete" or tries >= rules.most_attempts:
                state, due = (2 if event == "complete" else 4), None
            else:
                state, due = 3, at + max(1, int(min(rules.most_backoff_ms, rules.backoff_ms * 2 ** (tries - 1)) / 2 * (1 + draw) + 0.5))
        jobs[id_] = (state, tries, due, n)
    for id_, (state, tries, due, n) in jobs.items():
        if state == 1 and due < until and tries >= rules.most_attempts:
            jobs[id_] = (4, tries, None, n + 1)
    return {i: j for i, j in jobs.items() if j[0] is not None}


def made(rng, n, jobs):
    at, out = 1_700_000_000_000, []
    for k in range(n):
        at += rng.randrange(1, 12)
        out.append((rng.randrange(jobs), at, k, rng.choice(["enqueue", "claim", "claim", "claim", "heartbeat", "complete", "fail", "fail", "nonsense"]), rng.choice([None, 1, 1, 2, 3]), rng.choice([None, 0.0, 0.37, 1.0])))
    return [(i, a, s, e, t, 0.0 if d is None else d) for i, a, s, e, t, d in out]


def states(spark, path):
    done = leases.latest(spark.read.schema(leases.CHANGES).parquet(f"{path}/batch=*"))
    return {r.id: (r.state, r.attempts, r.next_attempt_at, r.n_changes) for r in done.collect()}


def test_leases_equal_a_plain_walk_across_a_restart(spark, tmp_path):
    """The second run's first batch is lost after it is written; the run after starts it again."""
    events = made(random.Random(1), 900, 25)
    seen = []

    def lose(number):
        seen.append(number)
        if seen.count(number) == 1 and number == 2:
            raise RuntimeError("lost")

    for part in range(3):
        spark.createDataFrame(events[part * 300 : part * 300 + 300], EVENTS).repartition(2).write.parquet(f"{tmp_path}/in/{part}")
        for _ in range(2):
            stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in/*")
            q = leases.run(leases.changes(stream, rules=RULES), f"{tmp_path}/out", f"{tmp_path}/cp", lose)
            try:
                q.awaitTermination()
                break
            except Exception as failure:
                assert "lost" in str(failure)
    want = walk(events, RULES, events[-1][1])
    assert seen.count(2) == 2 and states(spark, f"{tmp_path}/out") == want
    assert {s for s, *_ in want.values()} >= {2, 4}
    numbers = [r for r in spark.read.parquet(f"{tmp_path}/out/batch=*").where("accepted").groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("change").alias("d"), F.max("change").alias("m")).collect()]
    assert numbers and all(r.n == r.d == r.m for r in numbers)


def test_a_silent_job_ends_by_its_timer(spark, tmp_path):
    """Nothing happens to job 1 after its last claim; other jobs' events move the watermark on."""
    rows = [(1, 1000, 0, "enqueue", None, 0.0)] + [(1, 1000 + 101 * k, k, "claim", None, 0.0) for k in range(1, 4)] + [(2, 5000, 9, "enqueue", None, 0.0)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/in")
    leases.run(leases.changes(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), rules=RULES), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert states(spark, f"{tmp_path}/out") == {1: (4, 3, None, 5), 2: (0, 0, 5000, 1)}
    reaped = spark.read.parquet(f"{tmp_path}/out/batch=*").where("event = 'reap'").collect()
    assert [(r.id, r.at) for r in reaped] == [(1, 1303 + 100)]


def test_versions_have_no_gap_after_a_loss(spark, tmp_path):
    rng, seen = random.Random(2), []
    parts = [[(f"U#{rng.randrange(3)}", k * 100 + i) for i in range(60)] for k in range(3)]

    def lose(number):
        seen.append(number)
        if len(seen) == 2:
            raise RuntimeError("lost")

    for k, part in enumerate(parts):
        spark.createDataFrame(part, "pk string, sk long").repartition(3).write.parquet(f"{tmp_path}/in/{k}")
        for _ in range(2):
            q = leases.run(versions.versioned(spark.readStream.schema("pk string, sk long").parquet(f"{tmp_path}/in/*"), most=7), f"{tmp_path}/log", f"{tmp_path}/cp", lose)
            try:
                q.awaitTermination()
                break
            except Exception as failure:
                assert "lost" in str(failure)
    assert seen == [0, 1, 1, 2]
    got = {}
    for r in spark.read.schema("pk string, sk long, version long").parquet(f"{tmp_path}/log/batch=*").collect():
        got.setdefault(r.pk, []).append((r.sk, r.version))
    for pk in ("U#0", "U#1", "U#2"):
        want, last = [], 0
        for part in parts:
            own = sorted(sk for p, sk in part if p == pk)
            want += [(sk, last + 1 + i // 7) for i, sk in enumerate(own)]
            last += -(-len(own) // 7)
        assert sorted(got[pk]) == want and {v for _, v in got[pk]} == set(range(1, last + 1))
    shutil.rmtree(tmp_path)


ROW = "key long, updated_at long, deleted_at long, version long, payload string"


def fold(local, remote):
    now = {r[0]: r for r in local}
    for r in sorted(remote, key=lambda r: (r[3], r[1])):
        old = now.get(r[0])
        if old is not None and r[2] is None and not r[1] > old[1] and old[2] is None:
            now[r[0]] = (*old[:3], r[3], old[4])
        else:
            now[r[0]] = r
    return sorted(now.values())


@pytest.mark.parametrize("seed", range(6))
def test_merge_in_order_equals_a_fold(spark, seed):
    rng = random.Random(seed)
    row = lambda key, v: (key, rng.randrange(8), rng.choice([None, None, None, 3]), v, f"p{v}")
    local = [row(k, rng.randrange(50)) for k in range(0, 30, 2)]
    remote = [row(rng.randrange(30), 10 + v) for v in range(rng.choice([20, 150]))]
    got = sync.lww_merge(spark.createDataFrame(local, ROW), spark.createDataFrame(remote, ROW), "key", mode="reference")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == fold(local, remote)


def test_merge_in_order_gathers_no_records(spark):
    one = spark.range(1000).selectExpr("1L key", "id % 7 updated_at", "if(id = 500, id, null) deleted_at", "id version", "'x' payload")
    plan = sync.lww_merge(one.limit(0), one, "key", mode="reference")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_events_of_a_job_in_order_and_rows_out():
    frames = [pd.DataFrame({"at": [5, 3], "seq": [1, 9], "event": ["a", "b"], "attempt": [1, None], "draw": [None, 0.5]}), pd.DataFrame({"at": [3], "seq": [2], "event": ["c"], "attempt": [2], "draw": [0.1]})]
    assert [e[2] for e in leases._in_order(iter(frames))] == ["c", "b", "a"] and leases._in_order(iter([])) == []
    out = leases._rows([(1, 5, "claim", True, None, 0, None, 0), (1, 6, "fail", False, 3, 1, 9, 2)])
    assert dict(out.dtypes.astype(str)) == leases.KINDS == dict(leases._rows([]).dtypes.astype(str))
    assert out["state"].isna().tolist() == [True, False] and out["next_attempt_at"].tolist()[1] == 9
