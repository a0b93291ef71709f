"""Change logs: merge by last writer, cursors and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from ..schemas import schema
from .ordered import running_sum


def lww_merge(local: DataFrame, remote: DataFrame, key: str, mode: str = "documented") -> DataFrame:
    """Rows of both sides by key; both have ``updated_at``, ``deleted_at`` and ``version``.

    documented: a tombstone is final; else the greatest ``updated_at`` wins, the local row on equality, and the
    version is the greatest. It doesn't matter in which order records come. reference: remote records
    apply one by one in version order: a record replaces the row if it is a tombstone, strictly newer, or
    the row is a tombstone (which revives it); else only the version moves on.
    """
    columns = local.columns
    if mode == "documented":
        both = local.withColumn("_remote", F.lit(0)).unionByName(remote.withColumn("_remote", F.lit(1)))
        rank = F.struct(F.col("deleted_at").isNotNull().alias("t"), "updated_at", (1 - F.col("_remote")).alias("l"), F.when(F.col("_remote") == 1, F.col("version")).otherwise(0).alias("v"))
        rest = [c for c in columns if c not in (key, "version")]
        merged = both.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_v"), F.max("version").alias("version"))
        return merged.select(*(F.col(c) if c in (key, "version") else F.col(f"_v.{c}").alias(c) for c in columns))
    if mode != "reference":
        raise ValueError(mode)
    return _applied_in_order(local, remote, key).select(columns)


def _applied_in_order(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """What records of a key do one after another, as an associative merge: the local row counts as the first record.

    A run of records is summed up by its last tombstone, by the best record behind that, and by its last version. A tombstone replaces whatever
    was there, and the record behind it whatever its time; from there on a record replaces the row only if it is strictly newer, so the first of the newest
    behind the last tombstone stays, or the tombstone if nothing follows. Sums of runs merge like the runs, so both steps go as partial maxima before
    they are shuffled, and the records of a hot key stay with many tasks: none is gathered. ``updated_at`` (a number or a timestamp) isn't null.
    """
    fields = [c for c in local.columns if c != key]
    row = F.struct(*fields)
    every = local.select(F.col(key).alias("_key"), row.alias("row"), F.lit(0).alias("_side")).unionByName(remote.select(F.col(key).alias("_key"), row.alias("row"), F.lit(1).alias("_side")))
    every = every.withColumn("_order", F.struct("_side", F.col("row.version").alias("v"), F.col("row.updated_at").alias("u"), "row"))
    last_tombstone = every.where("row.deleted_at is not null").groupBy(F.col("_key").alias("_dead")).agg(F.max("_order").alias("_tomb"))
    behind = every.join(last_tombstone, F.col("_key").eqNullSafe(F.col("_dead")), "left").where("_tomb is null or _order >= _tomb")
    time = F.col("row.updated_at")
    time = F.unix_micros(time) if isinstance(local.schema["updated_at"].dataType, TimestampType) else time
    first_newest = F.struct(F.coalesce(F.col("_order") == F.col("_tomb"), F.lit(False)), -time, "_order")
    done = behind.groupBy("_key").agg(F.min_by("row", first_newest).alias("row"), F.max_by("row.version", "_order").alias("_version"))
    return done.select(F.col("_key").alias(key), *(F.col("_version").alias(c) if c == "version" else F.col(f"row.{c}").alias(c) for c in fields))


def lww_counters(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """(inserted, updated, tombstoned, kept) of one record per key."""
    r = remote.groupBy(key).agg(F.max(F.struct("version", "updated_at", "deleted_at")).alias("r"))
    joined = r.join(local.select(key, F.col("updated_at").alias("_u"), F.col("deleted_at").alias("_d"), F.lit(1).alias("_here")), key, "left")
    dead, here, gone = F.col("r.deleted_at").isNotNull(), F.col("_here").isNotNull(), F.col("_d").isNotNull()
    kept = here & (gone | (~dead & ~(F.col("r.updated_at") > F.col("_u"))))
    return joined.agg(F.count_if(~here).alias("inserted"), F.count_if(here & ~kept & ~dead).alias("updated"), F.count_if(here & ~kept & dead).alias("tombstoned"), F.count_if(kept).alias("kept"))


def delta_page(log: DataFrame, cursor: Sequence, version: str, key: str, limit: int = 500) -> DataFrame:
    """The next records after a cursor of (version, key), in order: a batch with one version isn't cut short."""
    v, k = cursor
    return log.where((F.col(version) > v) | ((F.col(version) == v) & (F.col(key) > k))).orderBy(version, key).limit(limit)


def route_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets, albums) of a change log whose rows have the fields of both: an asset has hash, kind and byteSize, an
    album id and title and no hash. Anything else is neither."""
    has = lambda *names: _every(F.col(n).isNotNull() for n in names)
    return records.where(has("hash", "kind", "byteSize")), records.where(has("id", "title") & F.col("hash").isNull())


def _every(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def asset_records(rows: DataFrame) -> DataFrame:
    """Records of the wire from rows of the assets table: camel-case names, favourite as a boolean; missing columns are null."""
    camel = lambda name: "".join(p if i == 0 else p.capitalize() for i, p in enumerate(name.split("_")))
    renamed = {"captured_at_src": "capturedAtSource"}
    fields = schema("assets")
    value = lambda f: F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
    favorite = lambda f: F.coalesce(value(f).cast("boolean"), F.lit(False)) if f.name == "favorite" else value(f)
    return rows.select(*(favorite(f).alias(renamed.get(f.name, camel(f.name))) for f in fields))


class PushError(ValueError):
    """A batch that may not be pushed."""


def push_batches(records: DataFrame, subject: str, first_version: int, most: int = 25) -> DataFrame:
    """Records (pk, sk, ...) in batches of at most ``most`` by sk, each under one version from ``first_version`` on; raises PushError if
    a record lies outside the subject's partition. Records are numbered over sampled ranges of sk, so a large push is many tasks."""
    foreign = records.where(~F.coalesce(F.col("pk") == f"U#{subject}", F.lit(False))).select("pk").first()
    if foreign is not None:
        raise PushError(f"{foreign[0]} is outside the partition U#{subject}")
    numbered = running_sum(records.withColumn("_one", F.lit(1)), [], ["sk"], "_one", "_nth")
    return numbered.withColumn("version", (F.lit(first_version) + F.call_function("div", F.col("_nth"), F.lit(most))).cast("long")).select(*records.columns, "version")


def stamp_versions(records: DataFrame, batch_version: int) -> DataFrame:
    return records.withColumn("version", F.lit(batch_version).cast("long"))


def pending_push(assets: DataFrame, limit: int = 25) -> DataFrame:
    return assets.where("version = 0").orderBy("updated_at", "hash").limit(limit)
