"""Rebuilding a catalogue after corruption, and what a session can do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text
from ..operators.relational import insert_or_ignore
from ..schemas import Local, Remote, schema
from . import vectors
from .versions import Step, migrate

PROBE = ((1, "Crème brûlée recipe"), (2, "creme fraiche"), (3, "recipe for bread"), (4, "nothing at all"))


def recover(spark: SparkSession, folder: str, steps: Sequence[tuple[int, Step]], shards: str, records: DataFrame, now: int) -> dict:
    """A clean catalogue under ``folder``: migrated, its vectors restored from the shards that are there, its assets inserted
    from remote ``records`` (hash, kind, byte_size, mime, captured_at, thumbhash), one per hash. Returns what was restored."""
    migrate(spark, folder, steps)
    restored = vectors.restore(spark, shards)
    restored.write.mode("overwrite").parquet(f"{folder}/vectors")
    fixed = {"captured_at_src": 0, "remote_state": int(Remote.VERIFIED), "local_state": int(Local.ABSENT), "updated_at": now, "version": 0, "favorite": False, "tier_state": 0, "derivative_mask": 0}
    columns = [F.col(f.name).cast(f.dataType) if f.name in records.columns else F.lit(fixed.get(f.name)).cast(f.dataType).alias(f.name) for f in schema("assets")]
    none = spark.createDataFrame([], schema("assets"))
    insert_or_ignore(none, records.select(*columns), "hash").write.mode("overwrite").parquet(f"{folder}/assets")
    return {"database_rebuilt": True, "restored_slots": spark.read.parquet(f"{folder}/vectors").count(), "restored_assets": spark.read.parquet(f"{folder}/assets").count()}


def search_capability(spark: SparkSession) -> dict[str, bool]:
    """A self-test of full-text search: accents fold, atoms are joined by AND, prefixes match, rarer words rank higher."""
    docs = spark.createDataFrame(PROBE, "id long, body string")
    found = lambda q, **more: [r["id"] for r in text.search(docs, "id", "body", q, **more).collect()]
    folds, both, prefix = sorted(found("creme")) == [1, 2], found("recipe creme") == [1], sorted(found("rec*", prefixes=True)) == [1, 3]
    ranked = text.search(docs, "id", "body", "recipe").collect()
    return {"folds_accents": folds, "implicit_and": both, "prefixes": prefix, "ranks": all(a["score"] <= b["score"] for a, b in zip(ranked, ranked[1:], strict=False)), "usable": folds and both}
