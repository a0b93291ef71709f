"""Table schemas, enumerations and bit masks of the archive catalogue."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1


ASSETS = "hash string, kind int, byte_size long, mime string, width int, height int, duration_ms long, captured_at long, captured_at_src int, tz_offset_min int, lat double, lon double, camera_make string, camera_model string, orientation int, thumbhash binary, live_pair_hash string, variant_of_hash string, favorite boolean, deleted_at long, remote_state int, local_state int, tier_state int, derivative_mask int, updated_at long, version long"
LOCAL_ASSETS = "local_id string, hash string, platform int, hash_state int, first_seen long, last_seen long"
ALBUMS = "id string, title string, created_at long, updated_at long, deleted_at long, version long"
ALBUM_MEMBERS = "album_id string, hash string, position int"
VECTORS = "hash string, model_id string, raw array<float>, coarse array<tinyint>"
POSTINGS = "token string, hash string, tf int"
DOCS = "hash string, token_count int"
JOBS = "id long, kind int, hash string, local_id string, priority int, state int, attempts int, next_attempt_at long, last_error string, created_at long"
PURGE_AUDIT = "id long, hash string, local_id string, remote_key string, remote_etag string, byte_size long, verify_method int, verified_at long, purge_requested_at long, purge_confirmed_at long, outcome int"
THUMB_CACHE = "key string, bytes long, last_accessed long"
MANIFEST = "hash string, file string, kind string, bytes long, capturedAt string, capturedAtSource string, lat double, lon double, camera string, albums array<string>, livePairHash string, variantOfHash string"
FILES = "part string, part_index int, path string, dir string, name string, kind string, media_kind int, byte_size long, mtime_ms double, outside_export boolean, source_path string"
SIDECARS = "dir string, name string, title string, photo_taken_s long, creation_s long, archived boolean, trashed boolean"
ALL = {"assets": ASSETS, "local_assets": LOCAL_ASSETS, "albums": ALBUMS, "album_members": ALBUM_MEMBERS, "vectors": VECTORS, "postings": POSTINGS, "docs": DOCS, "jobs": JOBS, "purge_audit": PURGE_AUDIT, "thumb_cache": THUMB_CACHE, "manifest": MANIFEST, "files": FILES, "sidecars": SIDECARS}


# Stored numbers of the enumerations.
class Kind(IntEnum):
    IMAGE = 0
    VIDEO = 1
    MOTION = 2


class CapturedAt(IntEnum):
    EXIF = 0
    SIDECAR = 1
    MTIME = 2
    USER = 3


class Remote(IntEnum):
    LOCAL_ONLY = 0
    UPLOADING = 1
    VERIFIED = 2
    FAILED = 3


class Local(IntEnum):
    ABSENT = 0
    PRESENT = 1
    PURGE_ELIGIBLE = 2
    PURGED = 3


class Tier(IntEnum):
    INSTANT = 0
    COLD = 1
    RESTORING = 2


class HashState(IntEnum):
    PENDING = 0
    DONE = 1
    UNREADABLE = 2


class Job(IntEnum):
    PENDING = 0
    RUNNING = 1
    DONE = 2
    FAILED = 3
    DEAD = 4


class Stage(IntEnum):
    SCAN = 0
    HASH = 1
    EXTRACT_META = 2
    DERIVE = 3
    EMBED = 4
    OCR = 5
    UPLOAD_ORIGINAL = 6
    UPLOAD_DERIVATIVES = 7
    VERIFY = 8
    TRANSCODE = 9
    MANIFEST_APPEND = 10
    SYNC_PUSH = 11


class Derivative(IntEnum):
    THUMBHASH = 1
    THUMB = 2
    PREVIEW = 4
    VIDEO = 8


PURGE_REQUIRED = int(Derivative.THUMB | Derivative.PREVIEW)


def schema(name: str) -> T.StructType:
    """The StructType of a catalogue table."""
    return T.StructType.fromDDL(ALL[name])


def assert_unique(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that break a key: empty where the key holds."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def assert_foreign(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """Child rows whose non-null ``column`` has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(column).distinct(), column, "left_anti")
