"""Verification, purging, export, storage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..schemas import Local, Tier


def purge_eligibility(assets: DataFrame) -> DataFrame:
    """Assets with (eligible, reason, next_local_state)."""
    reason = expr.purge_reason(F.col("remote_state"), F.col("derivative_mask"))
    return assets.withColumn("eligible", reason.isNull()).withColumn("reason", reason).withColumn("next_local_state", expr.after_purge_check(F.col("remote_state"), F.col("derivative_mask"), F.col("local_state")))


def purge_batch(assets: DataFrame, outcomes: DataFrame, key: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(audit, assets after): the audit of intent and outcome for the eligible, and their new states; write
    the audit first. outcome: 0 deleted, 1 refused, 2 failed."""
    batch = assets.where(F.col("local_state") == int(Local.PURGE_ELIGIBLE)).join(outcomes.select(key, "outcome"), key)
    after = assets.join(batch.select(key, "outcome"), key, "left").withColumn("local_state", F.when(F.col("outcome") == 0, int(Local.PURGED)).otherwise(F.col("local_state"))).drop("outcome")
    return batch, after


def verify_remote(objects: DataFrame, content: str = "content", expected: str = "hash") -> DataFrame:
    """Objects with (actual, verified): the digest of the stored bytes against the content's name."""
    return objects.withColumn("actual", F.sha2(content, 256)).withColumn("verified", F.col("actual") == F.col(expected))


def verify_objects(objects: DataFrame, part_bytes: int | None = None) -> DataFrame:
    """Objects (hash, content, checksum, composite, part_count) with (method, verified, problem).

    A stored SHA-256 checksum (base64) is compared with the name of an object of one part; of several parts the stored composite is
    compared with that of the content, cut into parts of ``part_bytes``. Without such a checksum the content is hashed whole; an object without
    content isn't there. Content is read only where the method needs it.
    """
    missing = F.col("content").isNull()
    has_composite = F.col("composite").isNotNull() & F.lit(part_bytes is not None)
    method = expr.verify_method(F.col("checksum").isNotNull(), has_composite, F.col("part_count"))
    stored = expr.base64_to_hex(F.regexp_replace("checksum", "-[0-9]+$", ""))
    size = part_bytes or 1
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("content") / size).cast("int") - 1, F.lit(0))), lambda i: F.sha2(F.substring(F.col("content"), i * size + 1, F.lit(size)), 256))
    composite = F.sha2(F.unhex(F.array_join(parts, "")), 256) == expr.base64_to_hex(F.regexp_replace("composite", "-[0-9]+$", ""))
    same = F.when(missing, False).when(method == "checksum", stored == F.lower("hash")).when(method == "composite", composite).otherwise(F.sha2("content", 256) == F.lower("hash"))
    problem = F.when(missing, "object not found").when(~same, F.concat(method, F.lit(" mismatch")))
    return objects.withColumn("method", method).withColumn("verified", F.coalesce(same, F.lit(False))).withColumn("problem", problem)


def export_plan(assets: DataFrame, size: str, *conditions: Column) -> DataFrame:
    rows = assets
    for c in conditions:
        rows = rows.where(c)
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def storage_stats(assets: DataFrame, size: str, purged: Column, verified: Column) -> DataFrame:
    """(total_bytes, local_bytes, reclaimed_bytes, verified, purged) in one pass."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col(size))), F.lit(0))
    return assets.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), part(~purged).alias("local_bytes"), part(purged).alias("reclaimed_bytes"), F.count_if(verified).alias("verified"), F.count_if(purged).alias("purged"))


def storage_cost(stored: DataFrame, size: str, egress_bytes: int) -> DataFrame:
    total = stored.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return total.select("bytes", expr.monthly_cost(F.col("bytes"), F.lit(egress_bytes)).alias("c")).select("bytes", "c.*")


def tier_step(assets: DataFrame) -> DataFrame:
    """(action, next_tier): what a request for the original does in each storage tier."""
    cold = F.col("tier_state") == int(Tier.COLD)
    return assets.withColumn("action", F.when(cold, "restore").when(F.col("tier_state") == int(Tier.RESTORING), "wait").otherwise("fetch")).withColumn("next_tier", F.when(cold, int(Tier.RESTORING)).otherwise(F.col("tier_state")))


def multipart_parts(objects: DataFrame, key: str, size: str) -> DataFrame:
    """(key, part, start, end): a row per part of every object with bytes."""
    plans = objects.select(key, expr.multipart(F.col(size)).alias("_p")).where("_p is not null")
    rows = plans.withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_p.part_count"))))
    r = expr.part_range(F.col("_p"), F.col("part"))
    return rows.select(key, "part", r["start"].alias("start"), r["end"].alias("end"))


def toggle_favorite(assets: DataFrame, key: str, ident: str, album: str = "favorites") -> DataFrame:
    """Flips a favourite and its membership of the favourites' album."""
    hit = F.col(key) == ident
    linked = F.when(F.col("favorite"), F.array_remove("album_ids", album)).otherwise(F.array_union("album_ids", F.array(F.lit(album))))
    return assets.withColumn("album_ids", F.when(hit, linked).otherwise(F.col("album_ids"))).withColumn("favorite", F.when(hit, ~F.col("favorite")).otherwise(F.col("favorite")))
