import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverquill.operators import ingest
from silverquill.operators.sync import lww_merge
from silverquill.sources import files, manifest, vectors, versions
from silverquill.streaming import sync as streams


def test_manifest_round_trip(spark, tmp_path):
    entry = {"hash": "a" * 64, "file": "x.jpg", "kind": "image", "bytes": 5, "capturedAt": "2019-06-08T14:22:31.000Z", "albums": ["t"]}
    lines = spark.createDataFrame([(json.dumps(entry),), (json.dumps(entry | {"kind": "cat", "bytes": -1}),), ("nonsense",)], "value string")
    parsed = manifest.parse_lines(lines).collect()
    assert parsed[0]["problems"] == [] and parsed[1]["problems"] == ["kind", "bytes"] and "not an object" in parsed[2]["problems"]
    good = manifest.parse_lines(lines).where(F.size("problems") == 0).drop("problems")
    assert json.loads(good.select(manifest.format_line(F.struct(*good.columns))).first()[0]) == entry
    manifest.append(good, str(tmp_path / "m"))
    manifest.append(good.withColumn("capturedAt", F.lit("2020-01-01T00:00:00Z")), str(tmp_path / "m"))
    assert {r["month"] for r in manifest.read(spark, str(tmp_path / "m")).collect()} == {"2019-06", "2020-01"}


def test_export_folders(spark, tmp_path):
    for part in ("takeout-10", "takeout-2", "other"):
        (tmp_path / part / "Takeout" / "Google Photos" / "Photos from 2019").mkdir(parents=True) if part != "other" else (tmp_path / part).mkdir()
    parts = files.discover_parts(str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in parts] == ["takeout-2", "takeout-10"]
    assert files.find_export_root(parts[0] + "/Takeout", "Google Fotos").endswith("Google Photos")
    with pytest.raises(files.ExportError):
        files.discover_parts(str(tmp_path / "other"))
    (tmp_path / "takeout-2/Takeout/Google Photos/Photos from 2019/a b+é.jpg").write_bytes(b"123")
    (tmp_path / "takeout-10/Takeout/Google Photos/metadata.json").write_text("{}")
    rows = {r["path"]: r for r in files.scan(spark, [p + "/Takeout/Google Photos" for p in parts]).collect()}
    assert rows["Photos from 2019/a b+é.jpg"]["kind"] == "media" and rows["Photos from 2019/a b+é.jpg"]["byte_size"] == 3
    assert rows["metadata.json"]["kind"] == "album-metadata" and rows["metadata.json"]["part_index"] == 1


def test_sidecar(spark):
    rows = spark.createDataFrame([('{"title":"a","photoTakenTime":{"timestamp":"1560003751"},"trashed":true}',), ("{}",), ("oops",)], "t string").select(files.sidecar_fields(F.col("t")).alias("s")).select("s.*").collect()
    assert rows[0]["photo_taken_ms"] == 1560003751000 and rows[0]["trashed"] and not rows[0]["archived"]
    assert rows[1]["problems"] == ["no photoTakenTime"] and rows[2]["problems"][0] == "not JSON"


def test_byte_range(spark):
    df = spark.createDataFrame([(bytearray(b"0123456789"),)], "c binary")
    got = df.select(files.byte_range(F.col("c"), 2, 4), files.byte_range(F.col("c"), 8, 99), files.byte_range(F.col("c"), 10), files.byte_range(F.col("c"), 3)).first()
    assert [None if x is None else bytes(x) for x in got] == [b"234", b"89", None, b"3456789"]


def test_synthetic_library(spark):
    lib = files.synthetic_library(spark, 300)
    assert lib.where("kind = 1").count() == 20 and lib.where("album_id is not null").count() == 30 and lib.select("hash").distinct().count() == 300


def test_vector_shards(spark, tmp_path):
    rows = [(bytes([i]) * 32, np.arange(256) % (i + 2) - 1) for i in range(3)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/00000.bin").write_bytes(vectors.encode_shard(rows))
    got = sorted(vectors.read_shards(spark, str(tmp_path / "s")).collect(), key=lambda r: bytes(r["id"]))
    assert [list(r["coarse"]) for r in got] == [v.tolist() for _, v in rows]
    with pytest.raises(vectors.ShardError):
        vectors.decode_shard(b"VEC1\x01\0\0\0")
    df = spark.range(10_000).select(F.col("id").alias("slot"), F.lit("m").alias("model_id"), F.array(F.lit(1).cast("tinyint")).alias("coarse"))
    vectors.backup(df, str(tmp_path / "b"))
    assert vectors.restore(spark, str(tmp_path / "b"), [1, 7]).count() == 4096 and vectors.restore(spark, str(tmp_path / "b")).count() == 10_000
    assert vectors.check_slots(df.unionByName(df.limit(1)), 1, "m").count() == 1


def test_streams_equal_the_batch(spark, tmp_path):
    ddl = streams.LOG
    rows = [(k, (k * 7 + v) % 13, 9 if (k + v) % 11 == 0 else None, v + 1, float(v)) for v in range(20) for k in range(5)]
    for n in range(4):
        spark.createDataFrame(rows[n * 25 : n * 25 + 25], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    want = sorted(map(tuple, lww_merge(spark.createDataFrame([], ddl), spark.createDataFrame(rows, ddl), "key").collect()))
    query = streams.apply_to_table(streams.pull(spark, str(tmp_path / "log"), files_per_trigger=1), str(tmp_path / "t"), str(tmp_path / "c"))
    query.awaitTermination()
    assert len(streams.generations(spark, str(tmp_path / "t"))) == 4
    assert sorted(map(tuple, streams.current(spark, str(tmp_path / "t")).collect())) == want
    q = streams.merged_stream(streams.pull(spark, str(tmp_path / "log"))).writeStream.outputMode("update").format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("SELECT key, max_by(updated_at, version), max_by(deleted_at, version), max(version), max_by(payload, version) FROM merged GROUP BY key").collect())) == want
    p = streams.push(streams.pull(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "c3"))
    p.awaitTermination()
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("version").distinct().collect()} == {1}


def test_windowed_counts(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = streams.windowed_counts(events)
    assert got.agg(F.sum("n")).first()[0] == events.count()


def test_migrations(spark, tmp_path):
    done = []
    steps = [(n, lambda s, f, n=n: done.append(n)) for n in (1, 2, 3)]
    folder = str(tmp_path / "t")
    assert versions.current_version(spark, folder) == 0 and versions.migrate(spark, folder, steps[:2]) == 2
    assert versions.migrate(spark, folder, steps) == 3 and done == [1, 2, 3] and versions.current_version(spark, folder) == 3
    with pytest.raises(versions.MigrationError):
        versions.migrate(spark, folder, steps[:2])
    with pytest.raises(versions.MigrationError):
        versions.migrate(spark, folder, steps[1:])


def test_ingest(spark):
    local = spark.createDataFrame([("a", None, 0, 0, 1, 1)], "local_id string, hash string, platform int, hash_state int, first_seen long, last_seen long")
    listed = ingest.enumerate_assets(local, spark.createDataFrame([("a", 0), ("b", 1), ("b", 1)], "local_id string, platform int"), 9)
    assert sorted((r["local_id"], r["first_seen"], r["last_seen"]) for r in listed.collect()) == [("a", 1, 9), ("b", 9, 9)]
    fetched = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x"))], "local_id string, content binary")
    assets, bound = ingest.materialise_originals(fetched, spark.createDataFrame([], "hash string, byte_size long, updated_at long"), listed, 10)
    assert assets.count() == 1 and {r["hash_state"] for r in bound.collect()} == {1}
    plan = ingest.upload_plan(spark.createDataFrame([("a", 9 << 20, 0), ("b", 5, 3), ("c", 5, 2)], "hash string, byte_size long, remote_state int"))
    assert {r["hash"]: r["parts"] for r in plan.collect()} == {"a": 2, "b": 1}
    got = ingest.embed(spark.createDataFrame([(1, "ab"), (2, "c")], "k int, t string"), "k", "t", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    assert {r["k"]: r["vector"] for r in got.collect()} == {1: [2.0, 1.0], 2: [1.0, 1.0]}
