"""The layout kept by deltas against one made from all rows in plain Python."""

import hashlib
import random
import re
import zlib
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from silverquill.llm import late
from silverquill.llm.queries import queries

EPOCH = datetime(1970, 1, 1)
NAMES = ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"]
SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def us(t):
    return None if t is None else (t - EPOCH) // timedelta(microseconds=1)


def day(t):
    return -1 if t is None else (t - EPOCH).days


def rank(r):
    return [(v is not None, v if v is not None else 0) for v in (r[5], *r)]


def layout(rows, per_file):
    best = {}
    for r in rows:
        if r[0] not in best or rank(r) > rank(best[r[0]]):
            best[r[0]] = r
    days = {}
    for r in sorted(best.values(), key=lambda r: [(v is not None, v if v is not None else 0) for v in (r[4], r[0])]):
        days.setdefault(day(r[4]), []).append(r)
    return best, {(d, k): own[i : i + per_file] for d, own in days.items() for k, i in enumerate(range(0, len(own), per_file))}


def crc(r):
    return zlib.crc32(":".join("" if v is None else str(v) for v in (r[0], us(r[4]), us(r[5]))).encode())


def expected(sales, files=700, copies=True):
    per_file, rows = 1 + len(sales) // files, list(sales)
    for r in sales if copies else ():
        h = None if r[0] is None else zlib.crc32(str(r[0]).encode())
        if h is not None and h % 3 == 0 and day(r[4]) % 7 == 0:
            more = lambda t, n: None if t is None else t + timedelta(days=n)
            rows.append((r[0], r[1], r[2], None if r[3] is None else r[3] + 1, more(r[4], h % 2), more(r[5], 1 + h % 97), r[6]))
    early = lambda r: r[5] is not None and r[5] < datetime(2024, 4, 10)
    old, start = layout([r for r in rows if early(r)], per_file)
    new, final = layout(rows, per_file)
    dirty = {d for k, r in new.items() if not early(r) for d in (day(r[4]), *([day(old[k][4])] if k in old else []))}
    found = {}
    for (d, k), own in final.items():
        ids = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in own).encode()).hexdigest()
        found[d, k] = (len(own), sum(int((100 * r[3] + 0.5) // 1) for r in own if r[3] is not None), sum(map(crc, own)), ids, d in dirty)
    assert all(final[k] == start[k] for k in final if k[0] not in dirty)
    return found, final


def compare(df, sales, **how):
    want, final = expected(sales, **how)
    got = df.collect()
    assert {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in got} == want and len(got) == len(want)
    for r in got:
        file = pq.ParquetFile(r.path)
        assert ",".join(file.schema_arrow.names) == r.columns == ",".join(NAMES)
        assert [tuple(x.values()) for x in file.read().to_pylist()] == final[r.day, r.file_no]
    return got


def test_query_on_the_given_table(spark):
    from ..oracle import DATA

    sales = [tuple(r) for r in spark.read.parquet(f"{DATA}/sales.parquet").collect()]
    got = compare(queries()["op13_late_overwrite"](spark, DATA), sales)
    assert {r.rewritten for r in got} == {True, False}
    folder = re.sub("/[^/]*$", "", got[0].path)
    import os

    assert sorted(f for _, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")) == sorted(r.path.rsplit("/", 1)[1] for r in got)


def made(rng, n, keys):
    when = lambda lo, hi: datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(lo * 86_400, hi * 86_400))
    return [
        (rng.choice([None, *range(keys)]), rng.choice([None, 1]), rng.choice([None, "", "open"]), rng.choice([None, 0.0, 1.005, -2.5, 10.01]), rng.choice([None, when(0, 9), datetime(2024, 1, 1), datetime(1969, 12, 31, 23)]), rng.choice([None, when(80, 120), datetime(2024, 4, 10)]), rng.choice([None, 3]))
        for _ in range(n)
    ]


@pytest.mark.parametrize(("seed", "n", "keys"), [(1, 300, 400), (2, 300, 20)])
def test_random_rows(spark, seed, n, keys):
    rows = made(random.Random(seed), n, keys)
    rows += rows[:20]
    compare(late.maintain(spark.createDataFrame(rows, SCHEMA), files=50).digests(), rows, files=50)


def test_untouched_files_keep_their_bytes(spark):
    """Late rows on one day only: the other days' files are those written at the start."""
    at = lambda d, h=0: datetime(2024, 2, d, h)
    rows = [(k, 1, "s", 1.0, at(1 + k % 5, k % 7), at(20), 1) for k in range(60)] + [(7, 1, "s", 2.0, at(4), datetime(2024, 4, 12), 1)]
    got = compare(late.maintain(spark.createDataFrame(rows, SCHEMA), files=10, copies=False).digests(), rows, files=10, copies=False)
    assert {r.day for r in got if r.rewritten} == {day(at(3)), day(at(4))} and len({r.day for r in got}) == 5


def test_no_late_rows_no_rows_and_one_day(spark):
    rows = [(k, 1, "s", 1.0, datetime(2024, 2, 1), datetime(2024, 2, 1), 1) for k in range(50)]
    assert not any(r.rewritten for r in compare(late.maintain(spark.createDataFrame(rows, SCHEMA), files=10, copies=False).digests(), rows, files=10, copies=False))
    assert late.maintain(spark.createDataFrame([], SCHEMA)).digests().collect() == []


def test_columns_of_its_own_names(spark):
    rows = [(k, 1, "s", 1.0, datetime(2024, 2, 1 + k % 3), datetime(2024, 4, 9 + k % 2), 1, "d", k) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA + ", day string, _file long")
    got = late.maintain(df, files=10, copies=False).digests().collect()
    assert sum(r.n_rows for r in got) == 30 and {r["columns"] for r in got} == {",".join([*NAMES, "day", "_file"])}


def test_sessions_in_another_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = made(random.Random(5), 100, 50)
        compare(late.maintain(spark.createDataFrame(rows, SCHEMA), files=20).digests(), rows, files=20)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_delta_weights(spark):
    df = spark.createDataFrame([(1, 1, "s", 1.0, datetime(2024, 2, 1), datetime(2024, 2, 1), 1), (2, 1, "s", None, None, None, 1)], SCHEMA)
    new = spark.createDataFrame([(1, 1, "s", 2.0, datetime(2024, 2, 2), datetime(2024, 4, 11), 1), (2, 0, "s", None, None, None, 1), (3, 1, "s", 1.0, None, None, 1)], SCHEMA)
    signed = late.delta(late.boxed(df), late.winners(late.boxed(new)))
    assert sorted((r.weight, r._sale) for r in signed.collect()) == [(-1, 1), (1, 1), (1, 3)]
    whole = late.consolidated(late.boxed(df).withColumn("weight", F.lit(1)).unionByName(signed))
    assert sorted((r._sale, r._day) for r in whole.collect()) == [(1, 19755), (2, -1), (3, -1)]
