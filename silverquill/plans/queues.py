"""Queries of queues and change logs as streams, of merges in order, and of indexes and manifests under change, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import sync
from ..session import scratch_folder, table
from ..sources import manifest, store, vec1
from ..sources.segments import SegmentedIndex
from ..streaming import leases, versions
from .registry import query

LEASE = leases.Rules(lease_ms=6 * 3_600_000, backoff_ms=60_000, most_backoff_ms=7_200_000)
PUSHES = 3


def _millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def fed(spark: SparkSession, parts: list[DataFrame], run, schema: str) -> None:
    """Hand ``parts`` to a stream one after another, each a run of its own from one checkpoint: ``run(stream, checkpoint)``. All in a new shared folder."""
    root = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    for number, part in enumerate(parts):
        part.write.parquet(f"{root}/in/part{number}")
        run(spark.readStream.schema(schema).parquet(f"{root}/in/*"), root).awaitTermination()


# A user's events are those of one job: event_id % 8 says what happens, event_id // 8 to which attempt.
_EVENT = "CASE event_id % 8 WHEN 0 THEN 'enqueue' WHEN 4 THEN 'heartbeat' WHEN 5 THEN 'complete' WHEN 6 THEN 'fail' WHEN 7 THEN 'fail' ELSE 'claim' END"


@query(f"""WITH RECURSIVE ev AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS ms, {_EVENT} AS event, 1 + event_id // 8 % 5 AS attempt, (event_id % 10) / 10.0 AS draw, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
walk(id, n, state, attempts, due, change) AS (
    SELECT DISTINCT id, 0::BIGINT, NULL::INT, 0, NULL::BIGINT, 0::BIGINT FROM ev
    UNION ALL
    SELECT id, n, CASE WHEN NOT ok THEN s WHEN event = 'enqueue' THEN 0 WHEN event IN ('claim', 'heartbeat') THEN 1 WHEN event = 'complete' THEN 2 WHEN attempts >= 5 THEN 4 ELSE 3 END,
        attempts + CASE WHEN ok AND event = 'claim' THEN 1 ELSE 0 END,
        CASE WHEN NOT ok THEN d WHEN event = 'enqueue' THEN ms WHEN event IN ('claim', 'heartbeat') THEN ms + {LEASE.lease_ms} WHEN event = 'fail' AND attempts < 5 THEN ms + greatest(1, floor(least({LEASE.most_backoff_ms}, {LEASE.backoff_ms} * 2 ** (attempts - 1)) / 2 * (1 + draw) + 0.5))::BIGINT END,
        c + ok::INT
    FROM (SELECT *, coalesce(CASE WHEN s IS NULL THEN event = 'enqueue' WHEN event = 'claim' THEN s IN (0, 1, 3) AND d <= ms AND (s <> 1 OR attempts < 5) ELSE event <> 'enqueue' AND s = 1 AND attempt = attempts END, FALSE) AS ok
        FROM (SELECT w.id, e.n, e.ms, e.event, e.attempt, e.draw, w.attempts, CASE WHEN gone THEN 4 ELSE w.state END AS s, CASE WHEN NOT gone THEN w.due END AS d, w.change + gone::INT AS c
            FROM (SELECT w.*, e.ms AS now, coalesce(w.state = 1 AND w.due <= e.ms AND w.attempts >= 5, FALSE) AS gone FROM walk w JOIN ev e ON e.id = w.id AND e.n = w.n + 1) w JOIN ev e ON e.id = w.id AND e.n = w.n + 1))),
ends AS (SELECT *, coalesce(state = 1 AND due <= (SELECT max(ms) FROM ev) AND attempts >= 5, FALSE) AS gone FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)
SELECT id, CASE WHEN gone THEN 4 ELSE state END::INT AS state, attempts::INT AS attempts, CASE WHEN NOT gone THEN due END AS next_attempt_at, change + gone::INT AS n_changes FROM ends WHERE state IS NOT NULL""")
def lease_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a stream of claims, heartbeats, outcomes and silences in three runs from one checkpoint."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), _millis("ts").alias("at"), F.col("event_id").alias("seq"), F.expr(_EVENT).alias("event"), F.expr("int(1 + event_id div 8 % 5)").alias("attempt"), F.expr("(event_id % 10) / 10.0d").alias("draw"))
    cuts = events.agg(F.percentile_approx("at", [(k + 1) / PUSHES for k in range(PUSHES - 1)])).first()[0]
    parts = [events.where(cond) for cond in (f"at <= {cuts[0]}", f"at > {cuts[0]} and at <= {cuts[1]}", f"at > {cuts[1]}")]
    done = []

    def run(stream: DataFrame, root: str):
        done[:] = [f"{root}/changes"]
        return leases.run(leases.changes(stream, rules=LEASE), done[0], f"{root}/checkpoint")

    fed(spark, parts, run, events.schema)
    return leases.latest(spark.read.schema(leases.CHANGES).parquet(f"{done[0]}/batch=*"))


@query(f"""WITH o AS (SELECT concat('U#', o_custkey % 20) AS pk, o_orderkey AS sk, o_orderkey % {PUSHES} AS push FROM orders), c AS (SELECT pk, push, (count(*) + 24) // 25 AS v FROM o GROUP BY ALL),
b AS (SELECT pk, push, coalesce(sum(v) OVER (PARTITION BY pk ORDER BY push ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT pk, sk, (before + (row_number() OVER (PARTITION BY pk, push ORDER BY sk) - 1) // 25 + 1)::BIGINT AS version FROM o JOIN b USING (pk, push)""")
def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders pushed in three parts, each under versions of their user's own."""
    orders = table(spark, sf_dir, "orders").select(F.expr("concat('U#', o_custkey % 20)").alias("pk"), F.col("o_orderkey").alias("sk"))
    done = []

    def run(stream: DataFrame, root: str):
        done[:] = [f"{root}/log"]
        return leases.run(versions.versioned(stream), done[0], f"{root}/checkpoint")

    fed(spark, [orders.where(f"sk % {PUSHES} = {k}") for k in range(PUSHES)], run, orders.schema)
    return spark.read.schema("pk string, sk long, version long").parquet(f"{done[0]}/batch=*")


@query("""WITH RECURSIVE log AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS updated_at, CASE WHEN event_type = 'error' THEN epoch_us(ts) // 1000 END AS deleted_at, event_id AS version, value AS payload FROM events),
loc AS (SELECT * FROM log WHERE version % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY version) = 1), rem AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (version * 7919) % 10007, version) AS n FROM log WHERE version % 2 = 1),
walk(key, n, updated_at, deleted_at, version, payload) AS (
    SELECT k.key, 0::BIGINT, updated_at, deleted_at, version, payload FROM (SELECT DISTINCT key FROM log) k LEFT JOIN loc USING (key)
    UNION ALL
    SELECT key, n, CASE WHEN keep THEN u ELSE updated_at END, CASE WHEN keep THEN d ELSE deleted_at END, version, CASE WHEN keep THEN p ELSE payload END
    FROM (SELECT r.*, w.updated_at AS u, w.deleted_at AS d, w.payload AS p, w.version IS NOT NULL AND r.deleted_at IS NULL AND NOT coalesce(r.updated_at > w.updated_at, FALSE) AND w.deleted_at IS NULL AS keep FROM walk w JOIN rem r ON r.key = w.key AND r.n = w.n + 1))
SELECT w.key, w.updated_at, w.deleted_at, CASE WHEN w.n > 0 THEN (w.version * 7919) % 10007 * 1000000000 + w.version ELSE w.version END AS version, w.payload FROM walk w WHERE w.version IS NOT NULL QUALIFY row_number() OVER (PARTITION BY w.key ORDER BY w.n DESC) = 1""")
def lww_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that come in another order than their times, applied one by one."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), _millis("ts").alias("updated_at"), F.when(F.col("event_type") == "error", _millis("ts")).alias("deleted_at"), F.col("event_id").alias("version"), F.col("value").alias("payload"))
    first = log.where("version % 2 = 0").groupBy("key").agg(F.min_by(F.struct("updated_at", "deleted_at", "version", "payload"), "version").alias("r")).select("key", "r.*")
    shuffled = log.where("version % 2 = 1").withColumn("version", F.expr("(version * 7919) % 10007 * 1000000000 + version"))
    return sync.lww_merge(first, shuffled, "key", mode="reference")


def _changed_sql() -> str:
    from .catalogue import _bm25_sql

    changed = "docs AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND doc_id % 35 <> 0 THEN concat('License the ', lang, ' ', substr(text, 1, 200)) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 5 OR doc_id % 22 = 5)"
    ranked = _bm25_sql(["token = 'license'", "token = 'the'"]).replace("FROM documents", "FROM docs")
    return f"WITH {changed}, {ranked} SELECT doc_id, round(score, 9) AS score FROM bm"


def index_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over segments after documents were indexed in three parts, every seventh anew (every 35th with a blank text, which changes nothing), some deleted and half of
    these indexed again, with merges between."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    index = SegmentedIndex(spark, f"{scratch_folder(spark)}/segments-{uuid.uuid4().hex}", "doc_id", fan=3)
    for k in range(3):
        index.upsert(docs.where(f"doc_id % 3 = {k}").select("doc_id", "text"), "text")
    index.merge()
    again = F.when(F.expr("doc_id % 35 = 0"), F.lit("  ")).otherwise(F.concat(F.lit("License the "), "lang", F.lit(" "), F.substring("text", 1, 200)))
    index.upsert(docs.where("doc_id % 7 = 0").select("doc_id", again.alias("text")), "text")
    index.delete(docs.where("doc_id % 11 = 5"))
    back = docs.where("doc_id % 22 = 5").select("doc_id", F.when(F.expr("doc_id % 7 = 0 and doc_id % 35 <> 0"), again).otherwise(F.col("text")).alias("text"))
    index.upsert(back, "text")
    index.merge()
    return index.search("License THE").withColumn("score", F.round("score", 9))


@query("""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2024-01' WHEN doc_id % 3 = 1 THEN '2024-02' ELSE '2024-03' END AS month, n_chars FROM documents WHERE text IS NOT NULL)
SELECT month, count(*) AS entries, sum(n_chars)::BIGINT AS bytes FROM e GROUP BY 1""")
def manifest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by month after four commits of two writers in turn."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    path = f"{scratch_folder(spark)}/manifest-{uuid.uuid4().hex}"
    captured = F.concat(F.lit("2024-0"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-05T00:00:00.000Z"))
    entries = docs.select("doc_id", F.sha2("text", 256).alias("hash"), F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file"), F.lit("image").alias("kind"), F.col("n_chars").cast("long").alias("bytes"), captured.alias("capturedAt"))
    for k in range(4):
        manifest.commit_append(entries.where(f"doc_id % 4 = {k}").drop("doc_id"), path)
    return manifest.read_commits(spark, path).groupBy("month").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"))


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::DOUBLE * 127 + 0.5)::INT))) AS v FROM embeddings), r AS (SELECT vec_id, v, vec_id // 100 AS shard, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1 AS row FROM q)
SELECT concat(lpad(shard::VARCHAR, 5, '0'), '.bin') AS shard, row, substr(sha256(vec_id::VARCHAR), 1, 32) AS id, list_sum(v)::BIGINT AS total, v[1]::INT AS first FROM r WHERE row >= 20""")
def vector_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised vectors written as exchange shards of 100 slots and read back by range: all rows but the first 20 of each."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slot"), F.substring(F.sha2(F.col("vec_id").cast("string"), 256), 1, 32).alias("id"), expr.quantize_round(F.col("embedding")).alias("c"))
    padded = v.select("slot", "id", F.concat("c", F.array_repeat(F.lit(0).cast("tinyint"), 256 - F.size("c"))).alias("coarse"))
    path = f"{scratch_folder(spark)}/vec1-{uuid.uuid4().hex}"
    vec1.write(padded, path, 100).write.format("noop").mode("append").save()
    vec1.register(spark)
    back = spark.read.format("vec1").load(path).where("row >= 20")
    total = F.aggregate("coarse", F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return back.select("shard", "row", F.decode("id", "UTF-8").alias("id"), total.alias("total"), F.element_at("coarse", 1).cast("int").alias("first"))


@query("""SELECT concat('u1/orig/', doc_id % 7, '/', doc_id) AS key, CASE WHEN text IS NOT NULL THEN strlen(text) END AS size, CASE WHEN text IS NULL THEN 'no content' WHEN doc_id % 9 = 4 THEN 'another digest' END AS problem, CASE WHEN text IS NULL OR doc_id % 9 = 4 THEN 'missing' ELSE 'ok' END AS status FROM documents""")
def object_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored as objects by the tasks, some with a wrong digest promised, and verified."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("u1/orig"), (F.col("doc_id") % 7).cast("string"), F.col("doc_id").cast("string")).alias("key"), F.encode("text", "UTF-8").alias("content"), F.when(F.col("doc_id") % 9 == 4, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    root = f"{scratch_folder(spark)}/store-{uuid.uuid4().hex}"
    store.put_all(d, root).write.parquet(f"{root}/heads")
    heads = spark.read.schema(store.STORED).parquet(f"{root}/heads")
    return heads.join(store.verify_all(heads, root), "key").select("key", "size", "problem", "status")
