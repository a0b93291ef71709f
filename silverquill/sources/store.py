"""An object store over any Hadoop file system: whole objects by key, checked before they become visible."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vec1 import opened


class StoreError(OSError):
    """An object that isn't there, or bytes that don't have the digest promised."""


class ObjectStore:
    """Keys under ``root``; what describes an object lies beside it under ``.meta``.

    ``put`` writes to a temporary name, compares the digest, and renames: a reader sees a whole object or none.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self._jvm, self._conf = root.rstrip("/"), spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway

    def _path(self, key: str, folder: str = "objects"):
        if not 1 <= len(key) <= 1024 or any(s in ("", ".", "..") for s in key.split("/")):
            raise StoreError(f"bad key {key!r}")
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}/{key}")
        return path.getFileSystem(self._conf), path

    def _write(self, fs, path, content: bytes) -> None:
        out = fs.create(path, True)
        out.write(bytearray(content))
        out.close()

    def _read(self, fs, path, start: int, size: int) -> bytes:
        source = fs.open(path)
        try:
            source.seek(start)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source, size))
        finally:
            source.close()

    def put(self, key: str, content: bytes, sha256: str | None = None, storage_class: str = "STANDARD", part_count: int = 1) -> dict:
        """Store an object; ``sha256`` (hex) is what its digest must be. Returns its head."""
        digest = hashlib.sha256(content).hexdigest()
        if sha256 is not None and digest != sha256.lower():
            raise StoreError(f"{key}: digest {digest}, not {sha256}")
        fs, path = self._path(key)
        _, temporary = self._path(uuid.uuid4().hex, ".tmp")
        self._write(fs, temporary, content)
        head = {"size": len(content), "etag": digest[:32], "storage_class": storage_class, "checksum_sha256": digest, "part_count": part_count}
        _, meta = self._path(key, ".meta")
        fs.mkdirs(path.getParent())
        self._replace(temporary, path)  # the object first: a head never tells of bytes that aren't there
        self._write(fs, meta, json.dumps(head).encode())
        return head

    def _replace(self, old, new) -> None:
        """Rename over what is there: a reader sees the object before or the one after."""
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self._conf).rename(old, new, options)

    def head(self, key: str) -> dict | None:
        fs, path = self._path(key)
        if not fs.exists(path):
            return None
        _, meta = self._path(key, ".meta")
        return json.loads(self._read(fs, meta, 0, fs.getFileStatus(meta).getLen()))

    def get(self, key: str, start: int = 0, end: int | None = None) -> bytes:
        """Bytes from ``start`` to ``end`` inclusive, cut at the object's end; an error where the start is past it."""
        fs, path = self._path(key)
        if not fs.exists(path):
            raise StoreError(f"{key}: no such object")
        size = fs.getFileStatus(path).getLen()
        if start < 0 or start >= max(size, 1) or (end is not None and end < start):
            raise StoreError(f"{key}: range {start}-{end} not satisfiable in {size} bytes")
        return self._read(fs, path, start, min(size, size if end is None else end + 1) - start)

    def delete(self, key: str) -> bool:
        fs, path = self._path(key)
        _, meta = self._path(key, ".meta")
        fs.delete(meta, False)
        return bool(fs.delete(path, False))


KEY = re.compile(r"(?!.*(?:^|/)\.{0,2}(?:/|$)).{1,1024}", re.S)
STORED = "key string, size long, sha256 string, problem string"


def put_all(objects: DataFrame, root: str) -> DataFrame:
    """(key, size, sha256, problem) after the objects (key, content, sha256: what the digest must be, or null) are stored under ``root``, each by the task that has
    it: written under another name, compared with its digest, then renamed over what was there. No bytes go through the driver. A bad key, null
    content or another digest is a ``problem``, and leaves what was there; of rows with one key one wins. Tasks that run again store the same bytes. Store
    the result: each reading of it stores the objects anew."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = opened(root)
        made = functools.lru_cache(4096)(lambda folder: files.create_dir(folder, recursive=True))
        own = f"{where}/.tmp/{uuid.uuid4().hex}"  # tasks that share one folder of unfinished objects wait for each other
        try:
            for b in batches:
                out = []
                for n, (key, content, promised) in enumerate(zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True)):
                    body = content.as_py()
                    digest = None if body is None else hashlib.sha256(body).hexdigest()
                    problem = "bad key" if key is None or not KEY.fullmatch(key) else "no content" if body is None else "another digest" if promised is not None and promised.lower() != digest else None
                    if problem is None:
                        target = f"{where}/objects/{key}"
                        hidden = f"{own}/{n}"
                        for folder in (own, target.rsplit("/", 1)[0]):
                            made(folder)
                        with files.open_output_stream(hidden) as f:
                            f.write(body)
                        files.move(hidden, target)
                    out.append((key, None if body is None else len(body), digest, problem))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["key", "size", "sha256", "problem"])
        finally:
            if files.get_file_info(own).type is FileType.Directory:
                files.delete_dir(own)

    return objects.select("key", "content", "sha256").mapInArrow(store, STORED)


def verify_all(heads: DataFrame, root: str) -> DataFrame:
    """(key, status) of stored objects (key, sha256), read and hashed by the tasks: ok, missing or corrupt."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = opened(root)
        for b in batches:
            found = []
            for key, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sum_ = hashlib.sha256()
                try:
                    with files.open_input_stream(f"{where}/objects/{key}") as f:
                        while part := f.read(1 << 20):
                            sum_.update(part)
                    found.append("ok" if sum_.hexdigest() == digest else "corrupt")
                except FileNotFoundError:
                    found.append("missing")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["key", "status"])

    return heads.select("key", "sha256").mapInArrow(check, "key string, status string")


def save_records(records: DataFrame, path: str) -> None:
    """Nested records as JSON lines."""
    records.write.mode("overwrite").json(path)


def load_records(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """Records of ``save_records``; ``default`` where nothing was saved. Malformed lines are errors."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return default if default is not None else spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def objects(spark: SparkSession, store: ObjectStore) -> DataFrame:
    """(key, size, content) of every object with bytes; content is read only where it is selected."""
    base = f"{store.root}/objects/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    return found.select(F.expr(f"url_decode(replace(substring_index(path, '{base.removeprefix('file:').removeprefix('//')}', -1), '+', '%2B'))").alias("key"), F.col("length").alias("size"), "content")
