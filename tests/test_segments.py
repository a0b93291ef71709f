"""Segments against an index made anew, and logs with several writers."""

import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silverquill.functions import udf
from silverquill.operators import text
from silverquill.sources import commits, manifest
from silverquill.sources.segments import SegmentedIndex

WORDS = [f"w{k}" for k in range(12)] + ["Éa", "!!!"]


@pytest.mark.parametrize("seed", range(2))
def test_search_equals_an_index_made_anew(spark, tmp_path, seed):
    rng, now = random.Random(seed), {}
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", "id", fan=2)
    assert index.search("w1").collect() == []
    for step in range(9):
        if step % 4 == 3:
            gone = rng.sample(range(40), 8)
            index.delete(spark.createDataFrame([(k,) for k in [*gone, gone[0]]], "id long"))
            now = {k: t for k, t in now.items() if k not in gone}
        else:
            docs = {k: rng.choice([" ".join(rng.choices(WORDS, k=rng.randrange(1, 8))), " ", None, "!!!"]) for k in rng.sample(range(40), rng.randrange(1, 15))}
            index.upsert(spark.createDataFrame(list(docs.items()), "id long, t string"), "t")
            now |= {k: t for k, t in docs.items() if t and t.strip()}
        if step % 3 == 2:
            while index.merge():
                pass
            index.vacuum()
    current = spark.createDataFrame(list(now.items()), "id long, t string")
    for query, prefixes in (("w1", False), ("w2 ea", False), ("w1*", True), ("none", False), ("", False)):
        rows = lambda df: sorted((r["id"], round(r["score"], 9)) for r in df.collect())
        assert rows(index.search(query, None, prefixes)) == rows(text.search(current, "id", "t", query, None, prefixes))


def test_an_upsert_writes_its_own_postings_only(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", "id")
    index.upsert(spark.range(500).selectExpr("id", "concat('a b c ', id) t"), "t")
    index.upsert(spark.createDataFrame([(7, "new words"), (900, "a")], "id long, t string"), "t")
    sizes = {s["id"]: spark.read.parquet(f"file://{tmp_path}/i/postings/segment={s['id']}").count() for s in index.segments()}
    assert list(sizes.values()) == [2000, 3] and [s["docs"] for s in index.segments()] == [500, 2]
    plan = index.search("a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [token") <= 2 and "StartsWith" not in plan and "EqualTo(token,a)" in plan


def test_merges_follow_tiers(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", "id", fan=4)
    sizes = lambda *docs: [{"id": k, "docs": n} for k, n in enumerate(docs)]
    assert index.run_to_merge(sizes(1000, 3, 3, 3)) is None and index.run_to_merge(sizes(1000, 3, 3, 0, 3)) == (1, 5)
    assert index.run_to_merge(sizes(1000, 15, 14, 13, 3)) == (1, 5) and index.run_to_merge([]) is None


def test_of_two_writers_of_a_version_one_wins(spark, tmp_path):
    log = commits.Log(spark, f"file://{tmp_path}/log")
    assert log.last() == (0, {}) and log.create(1, {"a": 1}) and not log.create(1, {"a": 2}) and log.last() == (1, {"a": 1})
    threads = [threading.Thread(target=lambda: [log.commit(lambda s: {"n": s.get("n", 0) + 1}) for _ in range(10)]) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert log.last() == (41, {"n": 40})
    log.tidy(3)
    assert log.numbers() == [39, 40, 41]


def test_writers_of_a_month_lose_no_line(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    entry = lambda k: spark.range(k * 10, k * 10 + 10).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit("f").alias("file"), F.lit("image").alias("kind"), F.col("id").alias("bytes"), F.concat(F.lit("2024-0"), (F.col("id") % 2 + 1).cast("string"), F.lit("-01T00:00:00Z")).alias("capturedAt"))
    threads = [threading.Thread(target=manifest.commit_append, args=(entry(k), path)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    entry(99).write.partitionBy("kind").json(f"{path}/parts/lost")  # a writer that never committed
    assert sorted(r["bytes"] for r in manifest.read_commits(spark, path).collect()) == list(range(40))
    assert {r["month"] for r in manifest.read_commits(spark, path, ["2024-02"]).collect()} == {"2024-02"}
    assert manifest.read_commits(spark, f"file://{tmp_path}/none").collect() == []


def test_tokens_are_counted_in_pieces(spark, monkeypatch):
    """A batch of any size is cut a piece at a time, and no piece is lost."""
    texts = pa.array(["a b a", None, "é" * 700, "", "x" * 3000, "b"])
    monkeypatch.setattr(udf, "PIECE_BYTES", 1000)
    parts = list(udf._pieces(texts.slice(1)))
    assert [len(p) for p in parts] == [1, 1, 1, 1, 1] and pa.concat_arrays(parts).equals(texts.slice(1)) and [len(p) for p in udf._pieces(texts[:1])] == [1]
    assert udf._by_pieces(lambda t: pa.array([len(t.to_pylist())] * len(t)), texts[:0]).to_pylist() == []


def test_index_rows_of_one_key_are_one(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, None), (3, "  "), (4, "É e")], "id long, t string")
    text.write_index(docs, "id", "t", f"file://{tmp_path}/index")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/index/postings").select("token", "id", "tf").collect())) == [("a", 1, 2), ("b", 1, 2), ("c", 1, 1), ("e", 4, 2)]
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/index/lengths").collect())) == [(1, 5), (4, 2)] and not (tmp_path / "index/counted").exists()
    rows = spark.read.parquet(f"file://{tmp_path}/index/postings")
    plan = text.sorted_postings(rows, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
