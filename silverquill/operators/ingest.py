"""Device ingest: enumeration, status, binding of sources, upload plans, embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..schemas import HashState, Job, Remote, Stage
from .relational import sighting_class, stale_models, upsert


def enumerate_assets(known: DataFrame, listed: DataFrame, now: int) -> DataFrame:
    """Local assets (local_id, hash, platform, hash_state, first_seen, last_seen) after a listing (local_id,
    platform): new ones wait for their hash, known ones were seen now."""
    fresh = sighting_class(known, listed.dropDuplicates(["local_id"]), "local_id")
    new = fresh.where("status = 'new'").select("local_id", F.lit(None).cast("string").alias("hash"), F.col("platform").cast("int"), F.lit(int(HashState.PENDING)).alias("hash_state"), F.lit(now).cast("long").alias("first_seen"), F.lit(now).cast("long").alias("last_seen"))
    seen = listed.select(F.col("local_id").alias("_id")).distinct()
    old = known.join(seen, F.col("local_id") == F.col("_id"), "left").withColumn("last_seen", F.when(F.col("_id").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("last_seen"))).drop("_id")
    return old.unionByName(new)


def library_status(assets: DataFrame, local: DataFrame) -> DataFrame:
    """(total, uploading, verified, failed, unhashed) in one row; deleted assets don't count."""
    live = assets.where("deleted_at is null").agg(F.count("*").alias("total"), *(F.count_if(F.col("remote_state") == int(s)).alias(s.name.lower()) for s in (Remote.UPLOADING, Remote.VERIFIED, Remote.FAILED)))
    return live.join(F.broadcast(local.agg(F.count_if(F.col("hash_state") == int(HashState.PENDING)).alias("unhashed"))))


def materialise_originals(fetched: DataFrame, assets: DataFrame, local: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(assets, local) after originals (local_id, content) came: hashed where they are, one asset per content, each source bound."""
    hashed = fetched.select("local_id", F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("byte_size"))
    new = hashed.groupBy("hash").agg(F.max("byte_size").alias("byte_size")).withColumn("updated_at", F.lit(now).cast("long"))
    bound = local.join(hashed.select("local_id", F.col("hash").alias("_h")), "local_id", "left").withColumn("hash_state", F.when(F.col("_h").isNotNull(), int(HashState.DONE)).otherwise(F.col("hash_state"))).withColumn("hash", F.coalesce("_h", "hash")).drop("_h")
    return upsert(assets, new, ["hash"], ["updated_at"]), bound


def upload_plan(assets: DataFrame) -> DataFrame:
    """Assets to upload with their parts; an empty object is put whole."""
    plan = F.when(expr.uses_multipart(F.col("byte_size")), expr.multipart(F.col("byte_size")))
    return assets.where(F.col("remote_state").isin(int(Remote.LOCAL_ONLY), int(Remote.FAILED))).withColumn("plan", plan).withColumn("parts", F.coalesce(F.col("plan.part_count"), F.lit(1).cast("long")))


def unhashed(local: DataFrame) -> DataFrame:
    """Local sources that wait for their hash."""
    return local.where(F.col("hash_state") == int(HashState.PENDING))


def backed_up(local: DataFrame, assets: DataFrame) -> DataFrame:
    """Local sources whose asset is verified remotely."""
    return local.join(assets.where(F.col("remote_state") == int(Remote.VERIFIED)).select("hash"), "hash", "left_semi")


def migration_jobs(jobs: DataFrame, vectors: DataFrame, current, now: int, first_id: int, key: str = "hash", model: str = "model_id") -> DataFrame:
    """``jobs`` and an Embed job of priority 10 for every key with a vector of another model and none of ``current``."""
    stale = stale_models(vectors, key, model, current).select(F.col(key).cast(jobs.schema["hash"].dataType).alias("hash"))
    made = stale.withColumn("id", F.lit(first_id) + F.monotonically_increasing_id())
    values = {"kind": int(Stage.EMBED), "priority": 10, "state": int(Job.PENDING), "attempts": 0, "next_attempt_at": now, "created_at": now}
    return jobs.unionByName(made.select(*(F.col(c).cast(jobs.schema[c].dataType) if c in ("id", "hash") else F.lit(values.get(c)).cast(jobs.schema[c].dataType).alias(c) for c in jobs.columns)))


def embed(rows: DataFrame, key: str, content: str, model: Callable[[], Callable[[pd.Series], list]], dims: int) -> DataFrame:
    """(key, vector) by a model that each worker opens once. ``model()`` gives a function of a batch of contents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = model()
        for b in batches:
            vectors = predict(b[content])
            if any(len(v) != dims for v in vectors):
                raise ValueError(f"the model doesn't give {dims} numbers")
            yield pd.DataFrame({key: b[key], "vector": vectors})

    return rows.select(key, content).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<float>")


def export_objects(plan: DataFrame, writer: Callable[[Iterator], None]) -> None:
    """Hand each partition of an export to ``writer`` on the executors."""
    plan.foreachPartition(writer)
