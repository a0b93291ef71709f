"""Dedupe ledger, manifest and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_contents(sightings: DataFrame, hash_: str = "hash", ref: str = "ref", size: str = "size") -> DataFrame:
    """(hash, sources, bytes_saved, size_conflict): a row per content; every distinct source beyond the first saves its size."""
    per = sightings.groupBy(hash_, ref).agg(F.min(size).alias("_lo"), F.max(size).alias("_hi"))
    return per.groupBy(hash_).agg(F.count("*").alias("sources"), ((F.count("*") - 1) * F.min("_lo")).alias("bytes_saved"), (F.min("_lo") != F.max("_hi")).alias("size_conflict"))


def dedupe_ledger(sightings: DataFrame, hash_: str = "hash", ref: str = "ref", size: str = "size") -> DataFrame:
    """(contents, sources, bytes_saved, conflicts, diverged): totals; diverged counts sources seen with two contents."""
    contents = dedupe_contents(sightings, hash_, ref, size).agg(F.count("*").alias("contents"), F.coalesce(F.sum("sources"), F.lit(0)).alias("sources"), F.coalesce(F.sum("bytes_saved"), F.lit(0)).alias("bytes_saved"), F.count_if("size_conflict").alias("conflicts"))
    diverged = sightings.select(ref, hash_).distinct().groupBy(ref).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("diverged"))
    return contents.join(F.broadcast(diverged))


def sighting_labels(sightings: DataFrame, order: str, hash_: str = "hash", ref: str = "ref") -> DataFrame:
    """Each sighting in arrival order as first (of its content), duplicate (a new source) or repeat.

    First arrivals are partial minima by content and by (content, source), so a content with very many
    copies isn't one task's window."""
    per = sightings.groupBy(hash_, ref).agg(F.min(order).alias("_source"))
    first = per.groupBy(hash_).agg(F.min("_source").alias("_first"))
    joined = sightings.join(per, [hash_, ref]).join(first, hash_)
    return joined.withColumn("label", F.when(F.col(order) == F.col("_first"), "first").when(F.col(order) == F.col("_source"), "duplicate").otherwise("repeat")).drop("_source", "_first")


def dedupe_decision(now: DataFrame, assets: DataFrame, bound: DataFrame) -> DataFrame:
    """(ref, hash, decision): sightings (ref, hash, size) against assets (hash, size) and bound sources (ref, hash)."""
    a = assets.select("hash", F.col("size").alias("_size"))
    b = bound.select("ref", F.col("hash").alias("_bound"))
    joined = now.join(a, "hash", "left").join(b, "ref", "left")
    decision = F.when(F.col("_bound").isNotNull() & (F.col("_bound") != F.col("hash")), "diverged").when(F.col("_size") != F.col("size"), "size-conflict").when(F.col("_bound") == F.col("hash"), "repeat").when(F.col("_size").isNotNull(), "duplicate").otherwise("first")
    return joined.select("ref", "hash", decision.alias("decision"))


def reconciliation(rows: DataFrame, status: Column, size: str) -> DataFrame:
    """(status, files, bytes): totals that add up to all rows."""
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def manifest_months(entries: DataFrame, captured_at: str) -> DataFrame:
    """(month, entries, timeline_entries): the UTC month is the text's first seven characters."""
    return entries.groupBy(F.substring(captured_at, 1, 7).alias("month")).agg(F.count("*").alias("entries"), F.count_if(F.col("kind") != "motion").alias("timeline_entries"))


def manifest_timeline(entries: DataFrame) -> DataFrame:
    return entries.where("kind <> 'motion'").orderBy(F.desc("capturedAt"), "hash")


def composite_digest(parts: DataFrame, group: str, order: str, content: Column) -> DataFrame:
    """(group, parts, digest): SHA-256 of the parts' digests one after another in order, as hex."""
    rows = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.sha2(content, 256).alias("d")))).alias("_p"))
    return rows.select(group, F.size("_p").alias("parts"), F.sha2(F.unhex(F.array_join(F.transform("_p", lambda p: p["d"]), "")), 256).alias("digest"))


def merge_packages(packages: DataFrame) -> DataFrame:
    """(name, version, requiredBy, licenseText): a row per package version; requiredBy is the sorted union, the text the first that isn't
    null, by the rows' ``seq``."""
    text = F.min_by(F.col("licenseText"), F.when(F.col("licenseText").isNotNull(), F.col("seq")))
    return packages.groupBy("name", "version").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("requiredBy")))).alias("requiredBy"), text.alias("licenseText"))


def first_copies(files: DataFrame, *keys: str, order: str) -> DataFrame:
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")
