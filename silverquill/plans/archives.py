"""Queries that write archives, shards, tables and logs made of the given tables, read them back and answer from what is read, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import ingest
from ..session import scratch_folder, table
from ..sources import files, recovery, store, vectors, versions
from ..streaming import sync as streams
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    """A new shared folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


_PLACE = "concat('Photos from 20', 10 + doc_id % 5, '/', doc_id, CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpg.json' WHEN 2 THEN '.mp4' ELSE '.txt' END)"
_PART = "concat('takeout-', doc_id % 3 + 1)"


@query(f"""WITH d AS (SELECT *, doc_id % 17 = 0 AS outside, {_PART} AS part, CASE WHEN doc_id % 17 = 0 THEN concat('Takeout/Mail/', doc_id, '.mbox') ELSE {_PLACE} END AS path FROM documents WHERE text IS NOT NULL)
SELECT part, path, CASE WHEN outside OR doc_id % 4 = 3 THEN 'unknown' WHEN doc_id % 4 = 1 THEN 'sidecar' ELSE 'media' END AS kind, strlen(text) AS byte_size, outside AS outside_export, CASE WHEN outside THEN concat(part, '/', path) ELSE path END AS source_path FROM d""")
def archive_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of an export in three parts, found, scanned and traversed as one; every 17th lies outside the product's folder."""
    root = _folder(spark, "export")
    inside = F.expr(f"concat({_PART}, '/Takeout/Google Photos/', {_PLACE})")
    key = F.when(F.expr("doc_id % 17 = 0"), F.expr(f"concat({_PART}, '/Takeout/Mail/', doc_id, '.mbox')")).otherwise(inside)
    d = table(spark, sf_dir, "documents").where("text is not null").select(key.alias("key"), F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("string").alias("sha256"))
    store.put_all(d, root).write.format("noop").mode("append").save()
    parts = files.discover_parts(root.removeprefix("file://") + "/objects")
    return files.traverse(spark, parts, "Google Photos").select("part", "path", "kind", "byte_size", "outside_export", "source_path")


@query("""SELECT vec_id * 50 // 4096 AS shard, count(*) AS slots, min(vec_id * 50) AS first_slot, round(sum(embedding[1]::DOUBLE), 6) AS total FROM embeddings WHERE vec_id * 50 // 4096 < 3 GROUP BY 1""")
def vector_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors backed up in shards of 4096 slots, of which the fourth is lost: what lies before the gap is restored."""
    path = _folder(spark, "backup")
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 50).alias("slot"), F.col("embedding")[0].cast("double").alias("x"))
    vectors.backup(v.where("slot div 4096 <> 3"), path)
    return vectors.bootstrap(spark, path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("slots"), F.min("slot").alias("first_slot"), F.round(F.sum("x"), 6).alias("total"))


@query("""WITH d AS (SELECT sha256(text) AS hash, min(n_chars)::BIGINT AS byte_size FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT hash, byte_size, 2 AS remote_state, 0::BIGINT AS version, (SELECT count(*) FROM embeddings) AS restored_slots FROM d""")
def catalogue_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue made anew from shards and remote records, one asset per content."""
    root = _folder(spark, "recovered")
    vectors.backup(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slot"), "embedding"), f"{root}/shards")
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("hash"), F.col("n_chars").cast("long").alias("byte_size"))
    found = recovery.recover(spark, f"{root}/catalogue", [(1, lambda s, f: None)], f"{root}/shards", d.groupBy("hash").agg(F.min("byte_size").alias("byte_size")), 1)
    return spark.read.parquet(f"{root}/catalogue/assets").select("hash", "byte_size", "remote_state", "version", F.lit(found["restored_slots"]).cast("long").alias("restored_slots"))


_TURNED = "(event_id * 7919) % 1000003"


@query(f"""WITH l AS (SELECT user_id AS key, {_TURNED} AS updated_at, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN event_id END AS deleted_at, event_id AS version, value AS payload FROM events)
SELECT key, updated_at, deleted_at, max(version) OVER (PARTITION BY key) AS version, payload FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY deleted_at IS NOT NULL DESC, updated_at DESC) = 1""")
def pull_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log in four files, pulled one a micro-batch with the checkpoint as cursor and merged into a table."""
    root = _folder(spark, "pull")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.expr(_TURNED).alias("updated_at"), F.expr("CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN event_id END").alias("deleted_at"), F.col("event_id").alias("version"), F.col("value").alias("payload"))
    for k in range(4):
        log.where(f"coalesce(pmod(version, 4), 0) = {k}").coalesce(1).write.mode("append").parquet(f"{root}/log")
    streams.apply_to_table(streams.pull(spark, f"{root}/log", files_per_trigger=1), f"{root}/table", f"{root}/checkpoint", buckets=8, compact_every=2).awaitTermination()
    return streams.current(spark, f"{root}/table").select("key", "updated_at", "deleted_at", "version", "payload")


@query("SELECT p_partkey, p_size * 2 AS double_size, concat('#', p_brand) AS label FROM part")
def schema_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table brought through three versions, in two runs."""
    root = _folder(spark, "migrated")
    part = table(spark, sf_dir, "part")
    steps = [
        (1, lambda s, f: part.select("p_partkey", "p_size", "p_brand").write.parquet(f"{f}/v1")),
        (2, lambda s, f: s.read.parquet(f"{f}/v1").withColumn("double_size", F.col("p_size") * 2).drop("p_size").write.parquet(f"{f}/v2")),
        (3, lambda s, f: s.read.parquet(f"{f}/v2").withColumn("label", F.concat(F.lit("#"), "p_brand")).drop("p_brand").write.parquet(f"{f}/v3")),
    ]
    versions.migrate(spark, root, steps[:2])
    return spark.read.parquet(f"{root}/v{versions.migrate(spark, root, steps)}").select("p_partkey", "double_size", "label")


@query("SELECT source, count(*) AS objects, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL AND lang = 'en' GROUP BY 1")
def exported_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents handed to a writer partition by partition, and counted from what it wrote."""
    root = _folder(spark, "exported")
    plan = table(spark, sf_dir, "documents").where("text is not null and lang = 'en'").select("doc_id", "source", F.octet_length("text").alias("bytes"))

    def write(rows: Iterator) -> None:
        import json

        from pyspark import TaskContext

        target, path = store.opened(root)
        target.create_dir(path, recursive=True)
        with target.open_output_stream(f"{path}/part-{TaskContext.get().partitionId():05d}.json") as out:  # a task that runs again replaces its file
            for r in rows:
                out.write((json.dumps({"source": r.source, "bytes": r.bytes}) + "\n").encode())

    ingest.export_objects(plan, write)
    return spark.read.schema("source string, bytes long").json(root).groupBy("source").agg(F.count("*").alias("objects"), F.sum("bytes").alias("bytes"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 5) THEN CASE WHEN doc_id % 6 = 0 THEN n_chars ELSE 0 END END::BIGINT AS slots, CASE doc_id % 6 WHEN 1 THEN 'a buffer of 128 dimensions' WHEN 2 THEN 'a bad free list' WHEN 3 THEN concat(n_chars, ' slots in ', n_chars * 256 - 1, ' bytes') WHEN 4 THEN '512 bytes without a header' END AS problem FROM documents""")
def packed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of packed buffers, good and bad, one made of each document."""
    n = F.col("n_chars").cast("string")
    header = lambda dims, free: F.concat(F.lit('{"modelId": "", "coarseDim": ' + dims + ', "slotCount": '), n, F.lit(', "freeSlots": ' + free + "}"))
    kind = F.col("doc_id") % 6
    text = F.when(kind == 1, header("128", "[]")).when(kind == 2, header("256", "[0, 0]")).when(kind.isin(0, 3), header("256", "[]"))
    size = F.when(kind == 3, F.col("n_chars") * 256 - 1).when(kind == 4, 512).when(kind == 5, 0).otherwise(F.col("n_chars") * 256).cast("long")

    @F.pandas_udf("slots long, problem string")
    def opened(headers: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        found = []
        for h, s in zip(headers, sizes, strict=True):
            try:
                found.append((vectors.open_header(h, int(s))["slotCount"], None))
            except vectors.ShardError as e:
                found.append((None, str(e).split(" by ")[0]))
        return pd.DataFrame(found, columns=["slots", "problem"]).astype({"slots": "Int64"})

    made = table(spark, sf_dir, "documents").select("doc_id", opened(text, size).alias("o"))
    return made.select("doc_id", "o.slots", "o.problem")


@query("""SELECT vec_id % 400 AS slot, CASE WHEN vec_id % 9 = 2 THEN 'another model' WHEN vec_id % 9 = 5 THEN 'another length' END AS problem FROM embeddings WHERE vec_id % 9 IN (2, 5)
UNION ALL SELECT vec_id % 400, 'slot taken twice' FROM embeddings GROUP BY 1 HAVING count(*) > 1""")
def slot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks an index of vectors: slots taken twice, another model or length."""
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 400).alias("slot"), F.when(F.col("vec_id") % 9 == 2, "old").otherwise("m").alias("model_id"), F.when(F.col("vec_id") % 9 == 5, F.slice(expr.quantize_round(F.col("embedding")), 1, 3)).otherwise(F.slice(expr.quantize_round(F.col("embedding")), 1, 4)).alias("coarse"))
    return vectors.check_slots(v, 4, "m").select("slot", "problem")
