"""Export folders, byte ranges and stores."""

from __future__ import annotations

import itertools
import os
import re
import stat
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.udf import exif_fields

HEAD_BYTES, MOST_BYTES = 128 * 1024, 16 << 20
FOLDERS = 256
ENTRIES = "part_index int, place binary"
SIZES = pa.schema([("part", pa.string()), ("part_index", pa.int32()), ("path", pa.string()), ("regular", pa.bool_()), ("byte_size", pa.int64()), ("mtime_ms", pa.float64())])


class ExportError(ValueError):
    """A folder that isn't an export."""


def natural_key(name: str) -> tuple[int, str]:
    found = re.search(r"(\d+)\s*$", name)
    return (int(found[1]) if found else -1, name)


def discover_parts(root: str) -> list[str]:
    """Part folders of an export in natural order: named ``takeout-...`` or holding a ``Takeout`` folder."""
    parts = [d.path for d in os.scandir(root) if d.is_dir() and (re.match(r"takeout[-_]", d.name, re.I) or os.path.isdir(os.path.join(d.path, "Takeout")))]
    if not parts:
        raise ExportError(f"no part of an export in {root}")
    names = [os.path.basename(p) for p in parts]
    if len(set(names)) < len(names):
        raise ExportError("two parts have one name")
    return sorted(parts, key=lambda p: natural_key(os.path.basename(p)))


def find_export_root(root: str, product: str) -> str:
    """The product's folder, else the only child, else the only one that starts with ``google ``."""
    children = sorted(d.name for d in os.scandir(root) if d.is_dir())
    if product in children:
        return os.path.join(root, product)
    if len(children) == 1:
        return os.path.join(root, children[0])
    google = [c for c in children if c.lower().startswith("google ")]
    if len(google) == 1:
        return os.path.join(root, google[0])
    raise ExportError(f"no export root in {root}")


def traverse(spark: SparkSession, parts: Sequence[str], product: str) -> DataFrame:
    """``scan`` of several unpacked parts as one export: paths count from the product's folder of each part, and files of a part that
    lie outside it have outside_export set and a source_path of their own (part and path), so parts never mix there."""
    if not parts:
        raise ExportError("no parts")
    names = [os.path.basename(os.path.abspath(p)) for p in parts]
    if len(set(names)) < len(names):
        raise ExportError("two parts have one name")
    rows = scan(spark, parts)
    inner = {}
    for name, p in zip(names, parts, strict=True):
        top = os.path.join(p, "Takeout") if os.path.isdir(os.path.join(p, "Takeout")) else p
        inner[name] = os.path.relpath(find_export_root(top, product), p)
    root = F.coalesce(*(F.when(F.col("part") == n, r) for n, r in inner.items()))
    inside = F.startswith("path", F.concat(root, F.lit("/")))
    rows = rows.withColumn("_root", root).withColumn("outside_export", ~inside)
    rows = rows.withColumn("path", F.when(F.col("outside_export"), F.col("path")).otherwise(F.expr("substring(path, length(_root) + 2)"))).drop("_root")
    rows = rows.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    return rows.withColumn("source_path", F.when(F.col("outside_export"), F.concat("part", F.lit("/"), "path")).otherwise(F.col("path")))


def scan(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(part, part_index, path, dir, name, kind, media_kind, byte_size, mtime_ms): whatever under the parts' roots is no folder, hidden and empty files too.

    Paths are in NFC. Folders and sizes are read by the tasks: some list the folders, then the names are dealt anew and their sizes taken by
    many, so that a large folder is many tasks. Links aren't followed: they and what else is no file are of unknown kind, without size and time.
    """
    bases = [os.path.abspath(r) for r in roots]
    names = [os.path.basename(b) for b in bases]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = os.lstat(os.path.join(os.fsencode(bases[i]), place))
                regular = stat.S_ISREG(s.st_mode)
                out.append((names[i], i, unicodedata.normalize("NFC", place.decode("utf-8", "replace")), regular, s.st_size if regular else 0, float(s.st_mtime_ns // 1_000_000) if regular else 0.0))
            yield pa.RecordBatch.from_pylist([dict(zip(SIZES.names, o, strict=True)) for o in out], SIZES)

    found = _entries(spark, bases).repartition("place").mapInArrow(sizes, "part string, part_index int, path string, regular boolean, byte_size long, mtime_ms double")
    named = found.withColumn("name", F.substring_index("path", "/", -1)).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    kind, media = expr.classify_file(F.col("name")), expr.media_kind(F.col("name"))
    return named.select("part", "part_index", "path", "dir", "name", F.when(F.col("regular"), kind).otherwise("unknown").alias("kind"), F.when(F.col("regular"), media).alias("media_kind"), "byte_size", "mtime_ms")


def _entries(spark: SparkSession, bases: list[str]) -> DataFrame:
    """(part_index, place): bytes of the paths, from the part's root on, of all that is no folder. The top folders are found level by level until there
    are ``FOLDERS`` of them, each of which one task walks with what lies below: the driver holds these only, no files."""
    above, level = [], [(i, b"") for i in range(len(bases))]
    while level and len(level) < FOLDERS:
        deeper = _walk(spark, bases, level, "folders").take(FOLDERS * 10 + 1)
        if len(deeper) > FOLDERS * 10:
            break
        above, level = above + level, [(r.part_index, bytes(r.place)) for r in deeper]
    shallow, deep = (_walk(spark, bases, folders, how) if folders else None for folders, how in ((above, "files"), (level, "tree")))
    return shallow.unionByName(deep) if shallow and deep else shallow or deep


def _walk(spark: SparkSession, bases: list[str], folders: list[tuple[int, bytes]], how: str) -> DataFrame:
    """(part_index, place) of what these folders hold: their ``folders``, their ``files``, or the files of their whole ``tree``."""

    def listed(i: int, place: bytes) -> Iterator[bytes]:
        below = [place]
        while below:
            at = below.pop()
            with os.scandir(os.path.join(os.fsencode(bases[i]), at)) as entries:
                for e in entries:
                    inner = e.is_dir(follow_symlinks=False)
                    if inner and how == "tree":
                        below.append(os.path.join(at, e.name))
                    if inner == (how == "folders"):
                        yield os.path.join(at, e.name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                places = listed(i, place)
                while some := list(itertools.islice(places, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(some), pa.int32()), pa.array(some, pa.binary())], ["part_index", "place"])

    rows = spark.createDataFrame(spark.sparkContext.parallelize(folders, min(len(folders), FOLDERS)), ENTRIES)
    return rows.mapInArrow(run, ENTRIES)


def sidecar_fields(text: Column) -> Column:
    """(title, photo_taken_ms, creation_ms, archived, trashed, problems) of a sidecar's JSON; never fails."""
    s = F.from_json(text, "title string, photoTakenTime struct<timestamp:string>, creationTime struct<timestamp:string>, archived boolean, trashed boolean")
    taken, made = expr.sidecar_millis(s["photoTakenTime"]["timestamp"]), expr.sidecar_millis(s["creationTime"]["timestamp"])
    problems = F.array_compact(F.array(F.when(F.get_json_object(text, "$").isNull(), "not JSON"), F.when(taken.isNull(), "no photoTakenTime")))
    return F.struct(s["title"].alias("title"), taken.alias("photo_taken_ms"), made.alias("creation_ms"), F.coalesce(s["archived"], F.lit(False)).alias("archived"), F.coalesce(s["trashed"], F.lit(False)).alias("trashed"), problems.alias("problems"))


def media_sidecars(media: DataFrame, pairing: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Media (dir, name, ...) with the sidecar they are paired with (dir, name, sidecar) and its times and flags, from sidecar
    files (dir, name, text): null and false without one."""
    fields = sidecars.select("dir", F.col("name").alias("sidecar"), sidecar_fields(F.col("text")).alias("_f"))
    joined = media.join(pairing.select("dir", "name", "sidecar"), ["dir", "name"], "left").join(fields, ["dir", "sidecar"], "left")
    flags = {f: F.coalesce(F.col(f"_f.{f}"), F.lit(False)).alias(f) for f in ("archived", "trashed")}
    return joined.select(*(c for c in media.columns if c not in flags), "sidecar", F.col("_f.photo_taken_ms").alias("photo_taken_ms"), F.col("_f.creation_ms").alias("creation_ms"), *flags.values())


def album_metadata(text: Column) -> Column:
    m = F.from_json(text, "title string, date struct<timestamp:string>")
    return F.struct(F.nullif(F.trim(m["title"]), F.lit("")).alias("title"), expr.sidecar_millis(m["date"]["timestamp"]).alias("album_date_ms"))


def exif(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with (captured_ms, offset_minutes) of their EXIF. The head of a file is enough for most; the first 16 MiB of those whose EXIF the head cuts
    are read again, and only their bytes go to the function a second time."""
    head = files.withColumn("_x", exif_fields(F.substring(F.col(content), 1, HEAD_BYTES)))
    more = F.when(F.col("_x.cut") & (F.length(content) > HEAD_BYTES), F.substring(F.col(content), 1, MOST_BYTES))
    again = head.withColumn("_y", exif_fields(more)).withColumn("_again", more.isNotNull())
    rows = again.withColumn("_x", F.when(F.col("_again"), F.col("_y")).otherwise(F.col("_x"))).drop("_y", "_again")
    offset = expr.exif_offset_minutes(F.col("_x.offset_time_original"))
    return rows.withColumn("offset_minutes", offset).withColumn("captured_ms", expr.exif_millis(F.col("_x.date_time_original"), F.col("offset_minutes"))).drop("_x")


def byte_range(content: Column, start: int, end: int | None = None) -> Column:
    """Bytes from ``start`` to ``end`` inclusive, cut at the object's end; null where the start is past it."""
    size = F.length(content)
    last = size - 1 if end is None else F.least(F.lit(end), size - 1)
    return F.when(F.lit(start) < size, F.substring(content, F.lit(start + 1), (last - start + 1).cast("int")))


def synthetic_library(spark: SparkSession, n: int, start_ms: int = 1_600_000_000_000) -> DataFrame:
    """A library of ``n`` assets: every 15th a video, sizes by index, two cameras, every 10th in an album."""
    i = F.col("id")
    video = i % 15 == 0
    size = F.when(video, 15_000_000 + i % 10 * 1_000_000).otherwise(2_500_000 + i % 20 * 100_000)
    return spark.range(n).select(F.sha2(F.concat(F.lit("asset-"), i.cast("string")), 256).alias("hash"), F.when(video, 1).otherwise(0).alias("kind"), size.alias("byte_size"), (F.lit(start_ms) + i * 60_000).alias("captured_at"), F.when(i % 2 == 0, "Apple").otherwise("Sony").alias("camera_make"), F.when(i % 10 == 0, "album-0").alias("album_id"))
