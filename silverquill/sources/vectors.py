"""Packed vectors: shards of Parquet, and the ``VEC1`` exchange format."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, ID_BYTES, DIMS, PER_SHARD = b"VEC1", 32, 256, 4096


class ShardError(ValueError):
    """Bytes that aren't a shard."""


def encode_shard(rows: list[tuple[bytes, np.ndarray]]) -> bytes:
    """Magic, number of rows, then an id of 32 bytes and 256 int8 numbers for each."""
    return MAGIC + struct.pack("<I", len(rows)) + b"".join(i[:ID_BYTES].ljust(ID_BYTES, b"\0") + np.asarray(v, np.int8).tobytes() for i, v in rows)


def decode_shard(data: bytes) -> list[tuple[bytes, np.ndarray]]:
    if data[:4] != MAGIC or len(data) < 8:
        raise ShardError("no VEC1 shard")
    (n,), width = struct.unpack_from("<I", data, 4), ID_BYTES + DIMS
    if len(data) != 8 + n * width:
        raise ShardError(f"{len(data)} bytes for {n} rows")
    return [(data[at : at + ID_BYTES], np.frombuffer(data, np.int8, DIMS, at + ID_BYTES)) for at in range(8, len(data), width)]


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, id, coarse) of the VEC1 files under ``path``, a file at a time in each task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = decode_shard(content)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([i for i, _ in rows], pa.binary()), pa.array([v.tolist() for _, v in rows], pa.list_(pa.int8()))], ["shard", "id", "coarse"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, "shard string, id binary, coarse array<tinyint>")


def backup(vectors: DataFrame, path: str, slot: str = "slot") -> None:
    """Shards of 4096 slots as partitions of one table."""
    vectors.withColumn("shard", F.floor(F.col(slot) / PER_SHARD).cast("int")).write.partitionBy("shard").mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    """The shards that are there; a filter on shard is a filter on folders."""
    every = spark.read.parquet(path)
    return every if shards is None else every.where(F.col("shard").isin(shards))


def bootstrap(spark: SparkSession, path: str) -> DataFrame:
    """The shards 0, 1, ... up to the first that is absent: what lies behind a gap isn't restored."""
    have = {r[0] for r in spark.read.parquet(path).select("shard").distinct().collect()}
    whole = next(k for k in range(len(have) + 1) if k not in have)
    return spark.read.parquet(path).where(F.col("shard") < whole)


def live_vectors(vectors: DataFrame, free: Sequence[int], slots: int, per_read: int = 16384) -> DataFrame:
    """(slot, coarse, read) of the slots in use, in slot order: the packed scan. ``read`` numbers runs of ``per_read`` slots. The free list
    is a few numbers of the header; fails where a slot below ``slots`` is neither there nor free."""
    listed = F.expr("array(" + ", ".join(f"{int(s)}L" for s in free) + ")") if free else F.array().cast("array<long>")
    live = vectors.where((F.col("slot") < slots) & ~F.array_contains(listed, F.col("slot").cast("long")))
    short = live.count() - (slots - len(set(free)))
    if short:
        raise ShardError(f"{-short} slots missing")
    return live.select("slot", "coarse", F.floor(F.col("slot") / per_read).cast("int").alias("read")).orderBy("slot")


def open_header(header: str | None, size: int, dims: int = DIMS, model: str = "", adopt_headerless: bool = False) -> dict:
    """The checked header (modelId, coarseDim, slotCount, freeSlots) of a packed buffer of ``size`` bytes.

    Without a header a new one is made for an empty buffer, or for one of whole slots with ``adopt_headerless``. Raises ShardError for
    another length or model, a free list that repeats a slot or leaves the range, or a buffer shorter than its slots.
    """
    if header is None:
        if size and not adopt_headerless:
            raise ShardError(f"{size} bytes without a header")
        if size % dims:
            raise ShardError(f"{size} bytes are no whole slots")
        return {"modelId": model, "coarseDim": dims, "slotCount": size // dims, "freeSlots": []}
    try:
        found = json.loads(header)
    except ValueError as e:
        raise ShardError("the header is no JSON") from e
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    free = found.get("freeSlots") if isinstance(found, dict) else None
    if not isinstance(found, dict) or not whole(found.get("slotCount")) or not isinstance(free, list):
        raise ShardError("the header lacks fields")
    if found.get("coarseDim") != dims or found.get("modelId") != model:
        raise ShardError(f"a buffer of {found.get('coarseDim')} dimensions by {found.get('modelId')!r}")
    if len(set(free)) != len(free) or not all(whole(s) and s < found["slotCount"] for s in free):
        raise ShardError("a bad free list")
    if size < found["slotCount"] * dims:
        raise ShardError(f"{found['slotCount']} slots in {size} bytes")
    return {k: found[k] for k in ("modelId", "coarseDim", "slotCount", "freeSlots")}


def check_slots(vectors: DataFrame, dims: int, model: str) -> DataFrame:
    """Rows that break the index: a slot taken twice, another model, another length, a component out of range."""
    twice = vectors.groupBy("slot").agg(F.count("*").alias("_n")).where("_n > 1").select("slot", F.lit("slot taken twice").alias("problem"))
    bad = F.when(F.col("model_id") != model, "another model").when(F.size("coarse") != dims, "another length").when(F.exists("coarse", lambda x: x.isNull()), "null component")
    return vectors.select("slot", bad.alias("problem")).where("problem is not null").unionByName(twice)
