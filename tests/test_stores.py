"""Exchange shards as a data source, and objects stored by the tasks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverquill.sources import store, vec1, vectors


def _shards(spark, path, n=250, per=100):
    rng = np.random.default_rng(1)
    rows = [(k, f"id{k}".encode(), rng.integers(-128, 128, 256).tolist()) for k in range(n) if k != 7]
    df = spark.createDataFrame(rows, "slot long, id binary, coarse array<tinyint>").repartition(3)
    return rows, vec1.write(df, path, per).collect()


def test_shards_are_read_by_range(spark, tmp_path):
    rows, written = _shards(spark, f"file://{tmp_path}/v")
    assert sorted((r.shard, r.rows) for r in written) == [("00000.bin", 99), ("00001.bin", 100), ("00002.bin", 50)]
    assert [(i.rstrip(b"\0"), v.tolist()) for i, v in vectors.decode_shard((tmp_path / "v/00001.bin").read_bytes())] == [(i, v) for k, i, v in rows if 100 <= k < 200]
    vec1.register(spark)
    df = spark.read.format("vec1").option("rows", 30).load(f"file://{tmp_path}/v")
    got = sorted((r.shard, r.row, bytes(r.id).rstrip(b"\0"), list(r.coarse)) for r in df.collect())
    assert [g[2:] for g in got] == [(i, v) for _, i, v in rows] and df.rdd.getNumPartitions() == 4 + 4 + 2
    some = df.where("shard = '00001.bin' and row >= 40 and row < 70")
    assert [r.row for r in some.orderBy("row").collect()] == list(range(40, 70)) and some.rdd.getNumPartitions() == 2
    assert df.where(F.col("shard").isin("00002.bin", "x")).count() == 50 and df.where("shard = 'none'").count() == 0


@pytest.mark.parametrize("fault", ["short", "long", "magic", "empty"])
def test_broken_shards_are_errors(spark, tmp_path, fault):
    _shards(spark, f"{tmp_path}/v")
    file = tmp_path / "v/00002.bin"
    data = file.read_bytes()
    file.write_bytes({"short": data[:-1], "long": data + b"x", "magic": b"VEC2" + data[4:], "empty": b""}[fault])
    vec1.register(spark)
    df = spark.read.format("vec1").load(f"{tmp_path}/v")
    with pytest.raises(Exception, match="00002.bin"):
        df.collect()
    assert df.where("shard = '00000.bin'").count() == 99


def test_objects_are_stored_by_tasks(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    digest = lambda b: hashlib.sha256(b).hexdigest()
    rows = [("a/b", b"one", None), ("a/c", b"two", digest(b"two")), ("a/d", b"three", digest(b"other")), ("../x", b"4", None), ("a//b", b"5", None), ("a/.", b"6", None), ("e", None, None), ("f", b"", digest(b"")), (None, b"7", None)]
    df = spark.createDataFrame(rows, "key string, content binary, sha256 string")
    heads = spark.createDataFrame(store.put_all(df, root).collect(), store.STORED)
    problems = {r.key: r.problem for r in heads.collect()}
    assert problems == {"a/b": None, "a/c": None, "a/d": "another digest", "../x": "bad key", "a//b": "bad key", "a/.": "bad key", "e": "no content", "f": None, None: "bad key"}
    assert (tmp_path / "s/objects/a/c").read_bytes() == b"two" and not list((tmp_path / "s/.tmp").iterdir())
    store.put_all(spark.createDataFrame([("a/c", b"2", None), ("a/b", b"bad", digest(b"x"))], df.schema), root).collect()
    assert (tmp_path / "s/objects/a/c").read_bytes() == b"2" and (tmp_path / "s/objects/a/b").read_bytes() == b"one"
    status = {r.key: r.status for r in store.verify_all(heads.where("problem is null or problem <> 'bad key'"), root).collect()}
    assert status == {"a/b": "ok", "a/c": "corrupt", "a/d": "missing", "e": "missing", "f": "ok"}
    one = store.ObjectStore(spark, root)
    one.put("a/b", b"again")
    one.put("a/b", b"again and again")
    assert one.get("a/b") == b"again and again" and one.head("a/b")["size"] == 15
