"""Filters, joins, pages, upserts and counts over the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import Kind
from .ordered import running_sum


def timeline(assets: DataFrame, at: str, key: str, deleted: Column, limit: int = 150, offset: int = 0, motion: Column | None = None) -> DataFrame:
    """A page of what isn't deleted nor a motion component, newest first: a bounded heap per task. A table with the catalogue's
    ``kind`` column tells motion components by it; ``motion`` is another condition."""
    if motion is None and "kind" in assets.columns:
        motion = F.col("kind") == int(Kind.MOTION)
    live = assets.where(~deleted if motion is None else ~deleted & ~motion)
    return live.orderBy(F.desc(at), key).offset(offset).limit(limit) if offset else live.orderBy(F.desc(at), key).limit(limit)


def timeline_after(assets: DataFrame, at: str, key: str, last_at, last_key, limit: int = 150) -> DataFrame:
    """The page after a row: reads no earlier page again."""
    return assets.where((F.col(at) < last_at) | ((F.col(at) == last_at) & (F.col(key) > last_key))).orderBy(F.desc(at), key).limit(limit)


def candidate_filter(ranked: DataFrame, assets: DataFrame, key: str, *conditions: Column, members: DataFrame | None = None) -> DataFrame:
    """Ranked candidates whose asset meets every condition (and is in ``members``), rank kept."""
    allowed = assets.where(F.lit(True) if not conditions else _all(conditions)).select(key)
    if members is not None:
        allowed = allowed.join(members.select(key), key, "left_semi")
    return ranked.join(allowed, key, "left_semi")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def member_counts(albums: DataFrame, members: DataFrame, album_key: str, member_key: str, counted: str, title: str) -> DataFrame:
    """Every album with its number of members, 0 included. Members are counted before the join."""
    per = members.groupBy(F.col(member_key).alias("_k")).agg(F.count(counted).alias("members"))
    return albums.join(per, F.col(album_key) == F.col("_k"), "left").select(album_key, title, F.coalesce("members", F.lit(0)).alias("members"))


def contained_counts(groups: DataFrame, items: DataFrame, key: str, array: str) -> DataFrame:
    """Every group with the number of items whose array holds its key."""
    per = items.select(F.explode(F.array_distinct(array)).alias(key)).groupBy(key).agg(F.count("*").alias("items"))
    return groups.join(per, key, "left").withColumn("items", F.coalesce("items", F.lit(0)))


def insert_or_ignore(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old rows and the new ones whose key is new (one of each)."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows by key: the new one greatest by ``order``, else the old one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.struct("_new", *order)
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in rest)).select(*old.columns)


def enqueue_once(jobs: DataFrame, wanted: DataFrame, keys: Sequence[str], live: Column) -> DataFrame:
    """Wanted jobs without a live job of the same identity; null identities are equal."""
    open_ = jobs.where(live).select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return wanted.join(open_, _all([F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")


def sighting_class(seen: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Rows of ``now`` as new or known by ``key``."""
    known = seen.select(F.col(key).alias("_k")).distinct()
    return now.join(known, F.col(key) == F.col("_k"), "left").withColumn("status", F.when(F.col("_k").isNull(), "new").otherwise("known")).drop("_k")


def counts_with_zeros(df: DataFrame, column: str, values: Sequence, out: str = "n") -> DataFrame:
    """A row per value, with 0 for those absent."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} {df.schema[column].dataType.simpleString()}")
    return every.join(df.groupBy(column).agg(F.count("*").alias(out)), column, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def by_month(df: DataFrame, at: Column, value: str) -> DataFrame:
    return df.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("entries"), F.round(F.sum(value), 2).alias("total"))


def by_day(df: DataFrame, at: Column, key: str) -> DataFrame:
    """Sections of a timeline: a row per day with its size and its first and last key."""
    return df.groupBy(F.to_date(at).cast("string").alias("day")).agg(F.count("*").alias("items"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def lru_evictions(cache: DataFrame, key: str, size: str, used: str, cap: int, rows_per_bucket: int = 500_000) -> DataFrame:
    """Entries that go so that the rest fits ``cap``, least recently used first.

    The running total goes over sampled ranges of (``used``, ``key``), so that no task sorts the whole cache.
    """
    total, n = cache.agg(F.sum(size), F.count("*")).first()
    if not n or total <= cap:
        return cache.limit(0)
    summed = running_sum(cache, [], [used, key], size, "_earlier", max(1, n // rows_per_bucket))
    return summed.where(F.lit(total) - F.col("_earlier") > cap).select(*cache.columns)


def cache_total(cache: DataFrame, size: str) -> DataFrame:
    """(total): the bytes of a cache, 0 for an empty one."""
    return cache.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"))


def album_assets(assets: DataFrame, members: DataFrame, album, key: str = "hash") -> DataFrame:
    """Assets that are members of one album."""
    return assets.join(members.where(F.col("album_id") == album).select(key).distinct(), key, "left_semi")


def by_score(df: DataFrame, score: str, at: str, key: str, limit: int | None = None) -> DataFrame:
    """Best score first, the newest of equal ones, then by key."""
    out = df.orderBy(F.desc(score), F.desc(at), key)
    return out.limit(limit) if limit else out


def newest(df: DataFrame, key: str, limit: int = 100) -> DataFrame:
    """The last rows of an append-only log."""
    return df.orderBy(F.desc(key)).limit(limit)


def of_local_source(assets: DataFrame, local: DataFrame, local_id) -> DataFrame:
    """Assets that a local source is bound to."""
    return assets.join(local.where(F.col("local_id") == local_id).select("hash"), "hash", "left_semi")


def day_sections(df: DataFrame, at: Column, key: str, most: int = 1000) -> DataFrame:
    """(day, items, keys): a row per day, newest day first; keys are the day's first ``most`` items, newest first. They come
    from a partial top, so a day with very many items stays bounded."""
    rows = df.select(F.to_date(at).cast("string").alias("day"), at.alias("_at"), F.col(key).alias("_key"))
    cut = rows.withColumn("_r", F.row_number().over(Window.partitionBy("day", F.pmod(F.xxhash64("_key"), F.lit(16))).orderBy(F.desc("_at"), "_key"))).where(F.col("_r") <= most)
    kept = cut.withColumn("_r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("_at"), "_key"))).where(F.col("_r") <= most)
    keys = kept.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("_r", "_key"))).alias("_k")).select("day", F.transform("_k", lambda s: s["_key"]).alias("keys"))
    return rows.groupBy("day").agg(F.count("*").alias("items")).join(keys, "day").orderBy(F.desc("day"))


def natural_order(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Rows by the number at the end of their name, then by name (and ``keys``)."""
    from ..functions.expr import part_number

    return df.orderBy(part_number(F.col(name)).asc_nulls_first(), name, *keys)


def stale_models(vectors: DataFrame, key: str, model: str, current) -> DataFrame:
    """Keys with a vector of another model and none of the current one."""
    return vectors.where(F.col(model) != current).select(key).subtract(vectors.where(F.col(model) == current).select(key))


def stale_by_model(vectors: DataFrame, model: str, current) -> DataFrame:
    """(model, stale): vectors of every other model."""
    return vectors.where(F.col(model) != current).groupBy(F.col(model).alias("model")).agg(F.count("*").alias("stale"))
