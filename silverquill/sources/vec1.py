"""``VEC1`` shards as a Spark data source: a partition per run of rows of a file, read by byte range, pruned by pushed filters.

``spark.read.format("vec1").load(folder)`` after ``register(spark)`` gives (shard, row, id, coarse). The driver lists names and sizes; the tasks read their own ranges and check
the file's header against its size, so a short file is an error, not fewer rows. Files are opened by their URI's file system (local or mounted paths,
``hdfs://``, ``s3://``).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .vectors import DIMS, ID_BYTES, MAGIC, ShardError

WIDTH, HEAD = ID_BYTES + DIMS, 8
ROWS = 65_536
"""Rows of a partition (19 MB)."""
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Run(InputPartition):
    """Rows ``start`` to ``end`` of a file of ``size`` bytes."""

    path: str
    shard: str
    size: int
    start: int
    end: int


class Vec1Reader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows
        self.shards: set[str] | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]):
        """Take conditions on ``shard`` (which files) and ``row`` (which ranges); all others stay with Spark, and so do these, since ranges are only as fine as
        partitions."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if name == ("shard",) and isinstance(f, (EqualTo, In)):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.shards = given if self.shards is None else self.shards & given
            elif name == ("row",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = f.value + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            yield f

    def partitions(self) -> list[Run]:
        files, where = opened(self.path)
        out = []
        for info in sorted(files.get_file_info(fs.FileSelector(where, recursive=True)), key=lambda i: i.path):
            name = info.base_name
            if info.type == fs.FileType.File and not name.startswith((".", "_")) and (self.shards is None or name in self.shards):
                total = max(0, (info.size - HEAD) // WIDTH)
                cuts = range(0, max(total, 1), self.rows)
                out += [Run(info.path, name, info.size, k, min(total, k + self.rows)) for k in cuts if (self.high is None or k < self.high) and (not total or min(total, k + self.rows) > self.low)]
        return out or [Run("", "", 0, 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        if not run.path:
            return
        files, _ = opened(self.path)
        with files.open_input_file(run.path) as f:
            head = f.read(HEAD)
            if len(head) < HEAD or head[:4] != MAGIC:
                raise ShardError(f"{run.shard}: no VEC1 shard")
            (n,) = struct.unpack_from("<I", head, 4)
            if run.size != HEAD + n * WIDTH:
                raise ShardError(f"{run.shard}: {run.size} bytes for {n} rows")
            f.seek(HEAD + run.start * WIDTH)
            for at in range(run.start, run.end, 4096):
                rows = min(4096, run.end - at)
                data = f.read(rows * WIDTH)
                if len(data) != rows * WIDTH:
                    raise ShardError(f"{run.shard}: short read at row {at}")
                table = np.frombuffer(data, np.uint8).reshape(rows, WIDTH)
                ids = pa.array([bytes(x) for x in table[:, :ID_BYTES]], pa.binary())
                flat = pa.array(np.ascontiguousarray(table[:, ID_BYTES:]).view(np.int8).ravel())
                coarse = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * DIMS + 1, DIMS), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([run.shard] * rows), pa.array(np.arange(at, at + rows)), ids, coarse], ["shard", "row", "id", "coarse"])


class Vec1(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vec1"

    def schema(self) -> str:
        return "shard string, row long, id binary, coarse array<tinyint>"

    def reader(self, schema) -> DataSourceReader:
        return Vec1Reader(self.options["path"], int(self.options.get("rows", ROWS)))


def register(spark: SparkSession) -> None:
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Vec1)


def write(vectors: DataFrame, path: str, per_shard: int, slot: str = "slot") -> DataFrame:
    """Write (slot, id, coarse) as shards ``00000.bin``, ... of ``per_shard`` slots each, every shard by one task that streams its rows in slot order; returns
    (shard, rows, sha256). A shard is written under another name and renamed, so a task that runs again replaces its own file."""
    kinds = "shard string, rows long, sha256 string"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = opened(path)
        files.create_dir(where, recursive=True)
        now, held = None, []

        def put(number: int, rows: list[bytes]) -> pa.RecordBatch:
            body, name = MAGIC + struct.pack("<I", len(rows)) + b"".join(rows), f"{number:05d}.bin"
            hidden = f"{where}/.{uuid.uuid4().hex}"
            with files.open_output_stream(hidden) as out:
                out.write(body)
            files.move(hidden, f"{where}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([hashlib.sha256(body).hexdigest()])], ["shard", "rows", "sha256"])

        for b in batches:
            for number, key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if number != now:
                    if now is not None:
                        yield put(now, held)
                    now, held = number, []
                if len(v) != DIMS:
                    raise ShardError(f"{len(v)} dimensions")
                held.append(key[:ID_BYTES].ljust(ID_BYTES, b"\0") + np.asarray(v, np.int8).tobytes())
        if now is not None:
            yield put(now, held)

    number = F.call_function("div", F.col(slot), F.lit(per_shard)).alias("_shard")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = vectors.select(number, F.col("id").cast("binary").alias("id"), "coarse", slot).repartition(n, "_shard").sortWithinPartitions("_shard", slot).select("_shard", "id", "coarse")
    return dealt.mapInArrow(pack, kinds)
