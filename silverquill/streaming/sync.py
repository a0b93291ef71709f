"""Change logs as streams: cursor pulls, versioned pushes and a stateful last-writer-wins merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sync import lww_merge, push_batches

LOG = "key long, updated_at long, deleted_at long, version long, payload double"


def pull(spark: SparkSession, path: str, schema: str = LOG, files_per_trigger: int = 500) -> DataFrame:
    """The change log's files as a stream; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def apply_to_table(stream: DataFrame, table: str, checkpoint: str, key: str = "key", buckets: int = 256, available_now: bool = True, compact_every: int = 100) -> StreamingQuery:
    """Merge every micro-batch into a Parquet table, generation by generation.

    Keys lie in hash buckets. A batch reads and writes only the buckets of its own keys, from the latest
    generation before its number, so a batch run again after a failure gives the same files. Every ``compact_every`` batches what
    later generations replaced is deleted, so that folders don't pile up.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cut = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = {r[0] for r in cut.select("bucket").distinct().collect()}
        paths = [p for b, p in latest(spark, table, number).items() if b in touched]
        local = spark.read.schema(batch.schema).parquet(*paths) if paths else spark.createDataFrame([], batch.schema)
        merged = lww_merge(local, cut.drop("bucket"), key).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{table}/generation={number}")
        cut.unpersist()
        if compact_every and number and number % compact_every == 0:
            compact(spark, table, number)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _children(spark: SparkSession, where: str, prefix: str) -> dict[int, str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return {int(p.getName()[len(prefix) :]): p.toString() for p in found if p.getName().startswith(prefix)}


def generations(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the batches that were written whole."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = []
    for number, where in _children(spark, table, "generation=").items():
        mark = jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
        if mark.getFileSystem(conf).exists(mark):
            done.append(number)
    return sorted(done)


def latest(spark: SparkSession, table: str, before: int | None = None) -> dict[int, str]:
    """The newest folder of each bucket, of generations before ``before``."""
    found: dict[int, str] = {}
    for number in generations(spark, table):
        if before is None or number < before:
            found |= _children(spark, f"{table}/generation={number}", "bucket=")
    return found


def compact(spark: SparkSession, table: str, before: int) -> None:
    """Delete bucket folders of generations before ``before`` that a later one of them replaced, and generations of which none is left, so that what is listed
    stays as long as the buckets are many; a batch run again still finds what it read."""
    keep = set(latest(spark, table, before).values())
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for number, where in _children(spark, table, "generation=").items():
        if number < before:
            folders = list(_children(spark, where, "bucket=").values())
            gone = [f for f in folders if f not in keep]
            for folder in gone if len(gone) < len(folders) else [where]:
                path = path_of(folder)
                path.getFileSystem(conf).delete(path, True)


def current(spark: SparkSession, table: str, schema: str = LOG) -> DataFrame:
    """The table after the last whole batch; without rows so far, an empty one of this schema."""
    folders = latest(spark, table).values()
    return spark.read.parquet(*folders) if folders else spark.createDataFrame([], schema)


def merged_stream(stream: DataFrame) -> DataFrame:
    """(key, updated_at, deleted_at, version, payload) after each micro-batch, for keys that changed: a tombstone
    is final, else the newest record wins. State is one row per key; tombstones stay."""
    state = "updated_at long, deleted_at long, version long, payload double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else None
        version = -1 if now is None else now[2]
        for rows in batches:  # the best record of a batch at once, then that one against the state
            if not len(rows):
                continue
            ranked = rows.assign(dead=rows["deleted_at"].notna()).sort_values(["dead", "updated_at", "version"], kind="stable")
            r, version = ranked.iloc[-1], max(version, int(rows["version"].max()))
            if now is None or (bool(r["dead"]), r["updated_at"], r["version"]) > (now[1] is not None, now[0], now[2]):
                now = (int(r["updated_at"]), int(r["deleted_at"]) if r["dead"] else None, int(r["version"]), float(r["payload"]))
        held.update(now)
        yield pd.DataFrame([(key[0], now[0], now[1], version, now[3])], columns=["key", "updated_at", "deleted_at", "version", "payload"]).astype({"deleted_at": "Int64"})

    return stream.groupBy("key").applyInPandasWithState(step, LOG, state, "update", GroupStateTimeout.NoTimeout)


def push(stream: DataFrame, log: str, checkpoint: str, next_version: Callable[[int], int] = lambda batch: batch + 1, subject: str | None = None) -> StreamingQuery:
    """Append each micro-batch to the log under one version of its own; a batch run again replaces itself. With a ``subject`` the
    records (pk, sk, ...) must lie in its partition, and every 25 of them have a version (``push_batches``)."""

    def write(batch: DataFrame, number: int) -> None:
        if subject is not None:
            push_batches(batch, subject, next_version(number)).write.mode("overwrite").parquet(f"{log}/batch={number}")
            return
        batch.withColumn("version", F.lit(next_version(number)).cast("long")).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and kind with a watermark; an addition of this engine."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
