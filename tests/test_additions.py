"""Stores, recovery, traversal, slots, headers, verification, pushes and compaction."""

import base64
import hashlib
import json
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverquill.functions import expr
from silverquill.functions.udf import fold, term_counts
from silverquill.operators import lifecycle, relational, resolve, sync, text, vector
from silverquill.plans import archives, catalogue
from silverquill.schemas import schema
from silverquill.sources import files, recovery, store, vectors
from silverquill.streaming import sync as streams

from .oracle import DATA, duck, rows_of


def test_object_store(spark, tmp_path):
    s = store.ObjectStore(spark, f"file://{tmp_path}/objects")
    body = os.urandom(5000)
    digest = hashlib.sha256(body).hexdigest()
    head = s.put("u1/orig/a", body, digest)
    assert head["size"] == 5000 and s.head("u1/orig/a") == head and s.get("u1/orig/a") == body
    assert s.get("u1/orig/a", 10, 19) == body[10:20] and s.get("u1/orig/a", 4990, 9999) == body[4990:]
    for bad in (lambda: s.put("u1/orig/b", body, "0" * 64), lambda: s.get("u1/orig/a", 5000), lambda: s.get("nothing"), lambda: s.put("a/../b", body), lambda: s.put("", body)):
        with pytest.raises(store.StoreError):
            bad()
    assert s.head("u1/orig/b") is None and s.put("u1/orig/a", b"new")["size"] == 3 and s.get("u1/orig/a") == b"new"
    s.put("empty", b"")
    assert s.get("empty") == b"" and {(r["key"], r["size"]) for r in store.objects(spark, s).select("key", "size").collect()} == {("u1/orig/a", 3)}
    assert s.delete("u1/orig/a") and not s.delete("u1/orig/a") and s.head("u1/orig/a") is None


def test_saved_records(spark, tmp_path):
    kind = "id string, tags array<string>, exif struct<make:string>"
    path = f"file://{tmp_path}/web"
    assert store.load_records(spark, path, kind).count() == 0
    rows = spark.createDataFrame([("a", ["x", "y"], ("Apple",)), ("b", None, None)], kind)
    store.save_records(rows, path)
    assert sorted(map(str, store.load_records(spark, path, kind).collect())) == sorted(map(str, rows.collect()))


def test_recovery(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1, 2]) for i in range(3) for _ in range(1)], "slot int, coarse array<int>")
    vectors.backup(rows, f"file://{tmp_path}/shards")
    records = spark.createDataFrame([("h1", 0, 10, "image/jpeg", 5, b"t"), ("h1", 0, 10, "image/jpeg", 5, b"t"), ("h2", 1, 20, "video/mp4", 6, b"u")], "hash string, kind int, byte_size long, mime string, captured_at long, thumbhash binary")
    got = recovery.recover(spark, f"file://{tmp_path}/clean", [(1, lambda *_: None)], f"file://{tmp_path}/shards", records, 9)
    assert got == {"database_rebuilt": True, "restored_slots": 3, "restored_assets": 2}
    back = spark.read.parquet(f"file://{tmp_path}/clean/assets")
    assert back.columns == schema("assets").names and {(r["remote_state"], r["local_state"], r["updated_at"]) for r in back.collect()} == {(2, 0, 9)}


def test_search_capability(spark):
    assert all(recovery.search_capability(spark).values())


def test_traverse(spark, tmp_path):
    for part, names in {"takeout-1": ["Google Photos/Iceland/a.jpg", "Google Photos/Iceland/a.jpg.json"], "takeout-2": ["Google Photos/Iceland/a.jpg", "Google Photos/Trash/b.jpg"]}.items():
        for name in names:
            path = tmp_path / part / "Takeout" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(part)
        (tmp_path / part / "Takeout" / "archive_browser.html").write_text("x")
    rows = files.traverse(spark, [str(tmp_path / "takeout-1"), str(tmp_path / "takeout-2")], "Google Photos").collect()
    inside, outside = [r for r in rows if not r["outside_export"]], [r for r in rows if r["outside_export"]]
    assert sorted((r["part"], r["path"], r["dir"]) for r in inside if r["name"] == "a.jpg") == [("takeout-1", "Iceland/a.jpg", "Iceland"), ("takeout-2", "Iceland/a.jpg", "Iceland")]
    assert sorted(r["source_path"] for r in outside) == ["takeout-1/Takeout/archive_browser.html", "takeout-2/Takeout/archive_browser.html"]
    merged = resolve.merge_parts(files.traverse(spark, [str(tmp_path / "takeout-1"), str(tmp_path / "takeout-2")], "Google Photos"), outside="outside_export")
    assert merged.count() == 5
    with pytest.raises(files.ExportError):
        files.traverse(spark, [], "x")


def test_traverse_takes_all_files_in_few_tasks(spark, tmp_path, monkeypatch):
    """Hidden and empty files, links, names with signs, and folders deeper than the driver looks are found; a file isn't a 32nd of a task."""
    photos = tmp_path / "takeout-1" / "Takeout" / "Google Photos"
    names = ["_a.jpg", ".DS_Store", "empty.jpg", "modifie\u0301 100%+a.jpg", "x/y/z/deep.mp4", *(f"many/{n}.jpg" for n in range(700))]
    for name in names:
        (photos / name).parent.mkdir(parents=True, exist_ok=True)
        (photos / name).write_text("" if name == "empty.jpg" else "text")
    (photos / "nothing here").mkdir()
    (photos / "loop.jpg").symlink_to(photos)
    want = {(n.replace("e\u0301", "\u00e9"), 0 if n == "empty.jpg" else 4) for n in names} | {("loop.jpg", 0)}
    for folders in (256, 2):
        monkeypatch.setattr(files, "FOLDERS", folders, raising=False)
        df = files.traverse(spark, [str(tmp_path / "takeout-1")], "Google Photos")
        rows = {r["path"]: r for r in df.collect()}
        assert {(r["path"], r["byte_size"]) for r in rows.values()} == want and df.count() == len(want) and not any(r["outside_export"] for r in rows.values())
        assert rows["loop.jpg"]["kind"] == rows[".DS_Store"]["kind"] == "unknown" and rows["loop.jpg"]["media_kind"] is None and rows["_a.jpg"]["kind"] == "media"
        assert rows["x/y/z/deep.mp4"]["dir"] == "x/y/z" and abs(rows["_a.jpg"]["mtime_ms"] - (photos / "_a.jpg").stat().st_mtime * 1000) <= 1
        assert df.rdd.getNumPartitions() <= 8


def test_headers_and_scans(spark):
    good = {"modelId": "m", "coarseDim": 256, "slotCount": 3, "freeSlots": [1]}
    assert vectors.open_header(json.dumps(good), 768, model="m") == good and vectors.open_header(None, 0, model="m")["slotCount"] == 0
    assert vectors.open_header(None, 512, model="m", adopt_headerless=True)["slotCount"] == 2
    for change, size in (({"coarseDim": 128}, 768), ({"modelId": "n"}, 768), ({"freeSlots": [1, 1]}, 768), ({"freeSlots": [3]}, 768), ({"slotCount": "3"}, 768), ({}, 767)):
        with pytest.raises(vectors.ShardError):
            vectors.open_header(json.dumps(good | change), size, model="m")
    for header, size, adopt in ((None, 512, False), (None, 500, True), ("{", 0, False), ("[]", 0, False)):
        with pytest.raises(vectors.ShardError):
            vectors.open_header(header, size, model="m", adopt_headerless=adopt)
    rows = spark.createDataFrame([(i, [i]) for i in (0, 2, 1, 3)], "slot int, coarse array<int>")
    assert [(r["slot"], r["read"]) for r in vectors.live_vectors(rows, [1], 4, 2).collect()] == [(0, 0), (2, 1), (3, 1)]
    with pytest.raises(vectors.ShardError):
        vectors.live_vectors(rows, [], 6)


def test_bootstrap_stops_at_a_gap(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    spark.createDataFrame([(0, 0), (5000, 1), (13000, 3)], "slot int, x int").withColumn("shard", F.floor(F.col("slot") / 4096).cast("int")).write.partitionBy("shard").parquet(path)
    assert sorted(r["slot"] for r in vectors.bootstrap(spark, path).collect()) == [0, 5000]


def test_slots(spark):
    index = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "slot long, hash string")
    index, free = vector.release_slots(index, [], spark.createDataFrame([("a",), ("c",)], "hash string"))
    assert free == [0, 2]
    index, free, slots = vector.allocate_slots(index, free, 3, spark.createDataFrame([("b",), ("d",), ("e",), ("f",)], "hash string"))
    assert {r["hash"]: r["slot"] for r in index.collect()} == {"b": 1, "d": 2, "e": 0, "f": 3} and free == [] and slots == 4
    same, free, slots = vector.allocate_slots(index, [9], 4, spark.createDataFrame([("b",)], "hash string"))
    assert same.count() == 4 and free == [9] and slots == 4


def test_verify_objects_by_composite(spark):
    body = bytes(range(256)) * 10
    parts = [body[i : i + 1000] for i in range(0, len(body), 1000)]
    whole = base64.b64encode(hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in parts)).digest()).decode() + f"-{len(parts)}"
    h = hashlib.sha256(body).hexdigest()
    rows = [(h, bytearray(body), None, whole, 3), (h, bytearray(body[:-1]), None, whole, 3), (h, bytearray(body), None, None, 3), (h, None, None, whole, 3), (h, bytearray(body), base64.b64encode(bytes.fromhex(h)).decode(), None, 1), ("0" * 64, bytearray(body), base64.b64encode(bytes.fromhex(h)).decode(), None, 1)]
    got = lifecycle.verify_objects(spark.createDataFrame(rows, "hash string, content binary, checksum string, composite string, part_count int"), 1000).collect()
    assert [(r["method"], r["verified"], r["problem"]) for r in got] == [("composite", True, None), ("composite", False, "composite mismatch"), ("full", True, None), ("composite", False, "object not found"), ("checksum", True, None), ("checksum", False, "checksum mismatch")]


def test_pushes_stay_in_their_partition(spark):
    rows = spark.createDataFrame([("U#me", f"A#{i:03}") for i in range(60)], "pk string, sk string")
    assert sorted({(r["version"], r["n"]) for r in sync.push_batches(rows, "me", 7).groupBy("version").agg(F.count("*").alias("n")).collect()}) == [(7, 25), (8, 25), (9, 10)]
    with pytest.raises(sync.PushError):
        sync.push_batches(rows.unionByName(spark.createDataFrame([("U#you", "A#1")], "pk string, sk string")), "me", 7)


def test_compaction_keeps_the_table(spark, tmp_path):
    log, table = f"file://{tmp_path}/log", f"file://{tmp_path}/table"
    for k in range(6):
        spark.createDataFrame([(i, k * 10 + i, None, k + 1, float(k)) for i in range(5)], streams.LOG).write.mode("append").parquet(log)
        streams.apply_to_table(streams.pull(spark, log), table, f"file://{tmp_path}/cp", buckets=4, compact_every=2).awaitTermination()
    assert sorted((r["key"], r["version"], r["payload"]) for r in streams.current(spark, table).collect()) == [(i, 6, 5.0) for i in range(5)]
    folders = [p for g in streams._children(spark, table, "generation=").values() for p in streams._children(spark, g, "bucket=")]
    assert len(folders) <= 3 * 4


def test_python_sees_only_what_needs_it(spark):
    texts = ["Plain ASCII", "Crème brûlée", None, "ﬁne É", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["f"] for r in df.select(fold(F.col("t")).alias("f")).collect()]
    assert got[:3] == ["plain ascii", "creme brulee", None] and got[4] == ""
    counts = df.select(term_counts(F.col("t"), [("creme", False), ("a", True), ("br", True)]).alias("c")).collect()
    assert [(r["c"]["length"], list(r["c"]["tf"])) for r in counts] == [(2, [0, 1, 0]), (2, [1, 0, 1]), (0, [0, 0, 0]), (2, [0, 0, 0]), (0, [0, 0, 0])]


def test_text_index_equals_unindexed_search(spark, tmp_path):
    rnd = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "Été", "漢字"]
    docs = spark.createDataFrame([(i, " ".join(words[k] for k in rnd.integers(0, 7, rnd.integers(0, 30)))) for i in range(200)], "id long, body string")
    text.write_index(docs, "id", "body", f"file://{tmp_path}/i")
    for query, prefixes in (("alpha beta", False), ("alph* ete", True), ("zeta", False), ("", False)):
        a = [(r["id"], round(r["score"], 9)) for r in text.search(docs, "id", "body", query, prefixes=prefixes).collect()]
        assert a == [(r["id"], round(r["score"], 9)) for r in text.search_index(spark, f"file://{tmp_path}/i", "id", query, prefixes=prefixes).collect()]
    allowed = docs.where("id % 50 = 0").select("id")
    few = text.search_index(spark, f"file://{tmp_path}/i", "id", "alpha", limit=3, allowed=allowed).collect()
    assert 0 < len(few) <= 3 and all(r["id"] % 50 == 0 for r in few)
    plan = text.search_index(spark, f"file://{tmp_path}/i", "id", "alpha")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,alpha)" in plan


def test_batch_topk_in_blocks(spark):
    v = np.random.default_rng(1).normal(size=(120, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<float>")
    got = vector.batch_topk(df.where("id % 5 = 0"), df, "id", "id", "v", 4, block=7).collect()
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    for q in range(0, 120, 5):
        want = np.lexsort((np.arange(120), -(unit @ unit[q])))[:4].tolist()
        assert [r["item"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == want
    assert vector.batch_topk(df.limit(0), df, "id", "id", "v", 4).count() == 0
    a, b = vector.probe_blocks(df, df, "id", "id", "v", block=50).first(), vector.probe_report(vector.similarity_matrix(df, df, "id", "id", "v")).first()
    assert all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))


def test_evictions_of_clustered_uses(spark):
    rows = [(i, 10, 1000 + (i % 3 if i < 4900 else i * 1000)) for i in range(5000)]
    c = spark.createDataFrame(rows, "key long, bytes long, used long")
    got = sorted(r["key"] for r in relational.lru_evictions(c, "key", "bytes", "used", 20_000, rows_per_bucket=500).collect())
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    assert got == sorted(r[0] for r in order[:3000])


def test_decomposed_suffix(spark):
    names = ["a-modifié.jpg", "a-modifié.jpg", "a-EDITED.jpg", "-edited.jpg", "plain.jpg"]
    got = [r["b"] for r in spark.createDataFrame([(n,) for n in names], "n string").select(expr.edited_base(F.col("n")).alias("b")).collect()]
    assert got == ["a", "a", "a", None, None]


def test_byte_labels_round_as_c(spark):
    sizes = [1152, 1408, 1664, 1029, 1 << 20, (1 << 20) - 1, (1 << 40) + (1 << 37), (1 << 40) * 5 + (3 << 37), 102400, -5, 0, 10, (1 << 53) - 1]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", expr.format_bytes(F.col("n")).alias("s")).collect()

    def want(n):
        power = min(4, int(math.log(n) / math.log(1024) + 1e-12)) if n > 0 else 0
        return re.sub(r"\.?0+$", "", f"{n / 1024**power:.2f}") + " " + ["B", "KB", "MB", "GB", "TB"][power]

    assert [r["s"] for r in got] == [want(n) for n in sizes]


@pytest.mark.parametrize("ids", ["event_id - 2000", "if(event_id % 3 = 1, null, event_id - 500)", None])
def test_pull_loop_takes_every_event(spark, tmp_path, ids):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events = events.where("false") if ids is None else events.withColumn("event_id", F.expr(ids))
    events.write.parquet(str(tmp_path / "events.parquet"))
    columns, rows = duck(catalogue.oracle_sql()["pull_loop"], {"events": events.toArrow()})
    got = archives.pull_loop(spark, str(tmp_path)).select(columns)
    assert rows_of(columns, [tuple(r) for r in got.collect()]) == rows_of(columns, rows)
