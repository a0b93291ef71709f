"""Scalar functions: Column to Column, all of them evaluated in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PURGE_REQUIRED, Local, Remote

MIB = 1 << 20
# Names and extensions of an export.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "heic", "heif", "png", "gif", "webp", "tif", "tiff", "bmp", "dng")
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "avi", "mkv", "3gp", "mpg", "mpeg", "wmv", "webm")
ACCOUNT_FILES = ("print-subscriptions.json", "shared_album_comments.json", "user-generated-memory-titles.json")
EDITED_SUFFIXES = ("-edited", "-bearbeitet", "-modifié", "-editado")
PHOTO_WORDS = ("photo", "photos", "image", "images")
VIDEO_WORDS = ("video", "videos", "movie", "movies", "clip")
CLOUD_WORDS = ("cloud", "backed", "synced", "s3", "archived")
LOCAL_WORDS = ("local", "device", "unbacked", "pending")


# Hashes and keys ------------------------------------------------------------------------------------


def is_content_hash(h: Column) -> Column:
    return F.coalesce(h.rlike("^[0-9a-f]{64}$"), F.lit(False))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def checked_hash(h: Column) -> Column:
    """The hash itself; fails the job if it isn't one."""
    return F.when(F.assert_true(is_content_hash(h), F.lit("not a content hash")).isNull(), h)


def object_key(kind: str, prefix: Column, h: Column) -> Column:
    """Keys of an original (orig), a thumbnail (th), a preview (pv) or a 720p video (vid)."""
    layout = {"orig": ("orig", ""), "th": ("th", ".webp"), "pv": ("pv", ".webp"), "vid": ("vid", "/720p.mp4")}
    folder, tail = layout[kind]
    return F.concat(prefix, F.lit(f"/{folder}/"), h, F.lit(tail))


def shard_key(prefix: Column, model: Column, shard: Column) -> Column:
    return F.concat(prefix, F.lit("/vec/"), model, F.lit("/"), F.lpad(shard.cast("string"), 5, "0"), F.lit(".bin"))


def manifest_key(prefix: Column, month: Column) -> Column:
    return F.concat(prefix, F.lit("/manifest/"), month, F.lit(".ndjson"))


def is_object_key(key: Column) -> Column:
    """1 to 1024 characters; segments of letters, digits and ``!_.*'()=@-``, none empty, ``.`` or ``..``."""
    segments = F.split(key, "/")
    return F.coalesce(F.length(key).between(1, 1024) & F.forall(segments, lambda s: s.rlike(r"^[A-Za-z0-9!_.*'()=@-]+$") & ~s.isin(".", "..")), F.lit(False))


def hex_to_base64(h: Column) -> Column:
    return F.base64(F.unhex(h))


def base64_to_hex(b: Column) -> Column:
    return F.lower(F.hex(F.unbase64(b)))


def source_ref(kind: Column, platform: Column, ident: Column) -> Column:
    return F.when(kind == "device", F.concat(F.lit("device:"), platform, F.lit(":"), ident)).otherwise(F.concat(F.lit("takeout:"), ident))


def album_id(folder_path: Column) -> Column:
    return F.concat(F.lit("takeout-album:"), F.sha2(folder_path.cast("binary"), 256))


# File names -----------------------------------------------------------------------------------------


def extension(name: Column) -> Column:
    """After the last dot, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def stem(name: Column) -> Column:
    """Before the last dot; the whole name where the only dot is its first character."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def own_extension(name: Column) -> Column:
    """What ``stem`` leaves out, without the dot."""
    return F.regexp_extract(name, r"(?<=.)\.([^.]*)$", 1)


def basename(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def classify_file(name: Column) -> Column:
    low, ext = F.lower(name), extension(name)
    return (
        F.when(low == "metadata.json", "album-metadata")
        .when(low == "archive_browser.html", "archive-browser")
        .when(low.isin(*ACCOUNT_FILES), "account-metadata")
        .when(ext == "json", "sidecar")
        .when(ext.isin(*IMAGE_EXTENSIONS) | ext.isin(*VIDEO_EXTENSIONS), "media")
        .otherwise("unknown")
    )


def media_kind(name: Column) -> Column:
    """0 image, 1 video, null for anything that isn't media."""
    ext = extension(name)
    return F.when(classify_file(name) == "media", F.when(ext.isin(*IMAGE_EXTENSIONS), 0).otherwise(1))


def edited_base(name: Column) -> Column:
    """The stem before an edited suffix, composed or decomposed; null where there is none or nothing before it."""
    endings = dict.fromkeys(form for s in EDITED_SUFFIXES for form in (s, unicodedata.normalize("NFD", s)))
    found = F.regexp_extract(stem(name), "(?iu)^(.+)(?:" + "|".join(endings) + ")$", 1)
    return F.nullif(found, F.lit(""))


def disambiguator_probe(name: Column) -> Column:
    """``a(1).jpg`` to ``a.jpg(1).json``; null where there is no counter."""
    pattern = r"^(.*)\((\d+)\)\.([^.]+)$"
    return F.when(name.rlike(pattern), F.regexp_replace(name, pattern, "$1.$3($2).json"))


def year_bucket(folder: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(folder), r"^photos from (\d{4})$", 1), F.lit("")).cast("int")


def folder_role(folder: Column, has_metadata: Column) -> Column:
    low = F.lower(folder)
    return F.when(year_bucket(folder).isNotNull(), "year-bucket").when(has_metadata, "album").when(low == "archive", "archive").when(low.isin("trash", "bin"), "trash").otherwise("other")


def part_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)\s*$", 1).try_cast("long")


# Times ----------------------------------------------------------------------------------------------


def exif_offset_minutes(offset: Column) -> Column:
    """``+02:00`` to 120; null if it isn't an offset of up to 14 hours."""
    pattern = r"^([+-])(\d{2}):(\d{2})$"
    hours, minutes = F.regexp_extract(offset, pattern, 2).try_cast("int"), F.regexp_extract(offset, pattern, 3).try_cast("int")
    total = hours * 60 + minutes
    return F.when(offset.rlike(pattern) & (minutes < 60) & (total <= 14 * 60), F.when(F.substring(offset, 1, 1) == "-", -total).otherwise(total))


def exif_millis(value: Column, offset_minutes: Column) -> Column:
    """``2019:06:01 08:00:00`` as epoch milliseconds; a missing offset is UTC, an impossible date null."""
    pattern = r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}):(\d{2}):(\d{2})$"
    instant = F.try_to_timestamp(F.regexp_replace(value, pattern, "$1-$2-$3 $4:$5:$6"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(value.rlike(pattern), F.unix_millis(instant) - F.coalesce(offset_minutes, F.lit(0)) * 60_000)


def sidecar_millis(seconds: Column) -> Column:
    """Epoch seconds as text or number; 0 means missing."""
    return F.nullif(seconds.cast("string").try_cast("long"), F.lit(0).cast("long")) * 1000


def captured_at(sidecar_ms: Column, exif_ms: Column, exif_offset: Column, mtime_ms: Column) -> Column:
    """(captured_at, source, tz_offset_min, overruled): sidecar before EXIF before file time."""
    at = F.coalesce(sidecar_ms, exif_ms, mtime_ms)
    source = F.when(sidecar_ms.isNotNull(), "sidecar").when(exif_ms.isNotNull(), "exif").otherwise("mtime")
    others = F.array(F.struct(F.lit("sidecar").alias("s"), sidecar_ms.alias("t")), F.struct(F.lit("exif").alias("s"), exif_ms.alias("t")), F.struct(F.lit("mtime").alias("s"), mtime_ms.alias("t")))
    overruled = F.transform(F.filter(others, lambda o: o["t"].isNotNull() & (o["s"] != source) & (o["t"] != at)), lambda o: o["s"])
    return F.struct(at.alias("captured_at"), source.alias("source"), F.when(exif_ms == at, exif_offset).alias("tz_offset_min"), overruled.alias("overruled"))


def iso_utc(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# Vectors --------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_int8(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once in each row: inside a lambda it would be computed for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalised(v: Column) -> Column:
    """Unit length; null for a vector of length under 1e-12."""
    return bound(norm(v), lambda n: F.when(n >= 1e-12, F.transform(v, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a length product is under 1e-12."""
    return bound(norm(a) * norm(b), lambda under: F.when(under < 1e-12, 0.0).otherwise(dot(a, b) / under))


def quantize(v: Column) -> Column:
    """int8 by truncation of 128 times each component."""
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), (x.cast("double") * 128).cast("int"))).cast("tinyint"))


def quantize_round(v: Column) -> Column:
    """int8 by rounding 127 times each component."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") * 127 + 0.5).cast("int"))).cast("tinyint"))


def pseudo_embedding(text: Column, dims: int = 256) -> Column:
    """Demonstration vector: for each dimension d the sum of sin(code x (d + 1) x 31 / 1000) over the characters."""
    codes = F.transform(F.split(F.lower(text), ""), lambda c: F.ascii(c))
    return normalised(F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda d: F.aggregate(codes, F.lit(0.0), lambda s, c: s + F.sin(c * d * 31 / 1000))))


# States, plans and text -----------------------------------------------------------------------------


def has_bits(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.lit(bits)) == bits


def add_bits(mask: Column, bits: int) -> Column:
    return mask.bitwiseOR(F.lit(bits))


def remove_bits(mask: Column, bits: int) -> Column:
    return mask.bitwiseAND(F.bitwise_not(F.lit(bits)))


def purge_reason(remote: Column, mask: Column) -> Column:
    """Why an asset may not be purged; null where it may."""
    return F.when(remote != int(Remote.VERIFIED), F.concat(F.lit("remote state "), remote.cast("string"))).when(~has_bits(mask, PURGE_REQUIRED), F.concat(F.lit("derivative mask "), mask.cast("string")))


def after_purge_check(remote: Column, mask: Column, local: Column) -> Column:
    return F.when(purge_reason(remote, mask).isNull() & (local == int(Local.PRESENT)), int(Local.PURGE_ELIGIBLE)).otherwise(local)


def backoff_ceiling(attempts: Column, base: int = 1000, most: int = 300_000) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.greatest(F.floor(attempts) - 1, F.lit(0))))


def backoff_delay(attempts: Column, draw: Column, base: int = 1000, most: int = 300_000) -> Column:
    """Half the ceiling and a share ``draw`` (0 to 1) of the other half; at least 1."""
    half = backoff_ceiling(attempts, base, most) / 2
    unit = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), draw)), F.lit(0.0))
    return F.greatest(F.lit(1), F.least((half * 2), F.floor(half + unit * half + 0.5))).cast("long")


def multipart(size: Column, least_part: int = 5 * MIB, most_parts: int = 10_000) -> Column:
    """(part_size, part_count, last_part_size): the smallest parts, on a grid of 1 MiB, that are few enough; null for no bytes."""
    grid = min(MIB, least_part)
    part = F.greatest(F.lit(least_part), F.ceil(F.ceil(size / most_parts) / grid) * grid).cast("long")
    count = F.ceil(size / part).cast("long")
    return F.when(size > 0, F.struct(part.alias("part_size"), count.alias("part_count"), (size - part * (count - 1)).alias("last_part_size")))


def uses_multipart(size: Column, threshold: int = 8 * MIB) -> Column:
    return size > threshold


def verify_method(has_checksum: Column, has_composite: Column, parts: Column) -> Column:
    return F.when(parts > 1, F.when(has_composite, "composite").otherwise("full")).otherwise(F.when(has_checksum, "checksum").otherwise("full"))


def backpressure(thermal: Column, battery: Column, charging: Column, metered: Column, opted_in: Column) -> Column:
    """Why ingest pauses: heat, then battery, then a metered network; null where it goes on."""
    return F.when(thermal.isin("serious", "critical"), "thermal_throttle").when((battery < 0.2) & ~charging, "battery_low").when(metered & ~opted_in, "metered_network")


def monthly_cost(stored: Column, egress: Column, per_gb: float = 0.004, free_gb: float = 10.0, egress_per_gb: float = 0.09, ceiling: float = 3.0, alarm_gb: float = 70.0) -> Column:
    gb = lambda c: c.cast("double") / (1 << 30)
    storage, transfer = F.round(gb(stored) * per_gb, 4), F.round(F.greatest(F.lit(0.0), gb(egress) - free_gb) * egress_per_gb, 4)
    total = F.round(storage + transfer, 4)
    return F.struct(storage.alias("storage_cost"), transfer.alias("egress_cost"), total.alias("total_cost"), (total <= ceiling).alias("within_ceiling"), (gb(egress) >= alarm_gb).alias("egress_alarm"))


def format_bytes(n: Column) -> Column:
    """Whole bytes in units of 1024, to two places without closing zeros. Places are whole numbers: halves go to the even hundredth, and what is near a half isn't one."""
    n = n.cast("long")
    power = F.when(n > 0, F.least(F.floor(F.log(1024.0, n.cast("double")) + 1e-12), F.lit(4))).otherwise(0).cast("int")
    unit = F.element_at(F.array(*(F.lit(1 << 10 * p) for p in range(5))).cast("array<long>"), power + 1)
    div = lambda a, b: F.call_function("div", a, b)
    part = n % unit * 100
    cut, rest = div(part, unit), part % unit * 2
    places = cut + F.when((rest > unit) | ((rest == unit) & (cut % 2 == 1)), 1).otherwise(0)
    number = F.concat((div(n, unit) + div(places, F.lit(100))).cast("string"), F.lit("."), F.lpad((places % 100).cast("string"), 2, "0"))
    return F.concat(F.regexp_replace(number, r"\.?0+$", ""), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), power + 1))


def fit_long_edge(width: Column, height: Column, most: int) -> Column:
    """Size scaled down so that the longer side is at most ``most``."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.floor(width * scale + 0.5)).cast("int").alias("width"), F.greatest(F.lit(1), F.floor(height * scale + 0.5)).cast("int").alias("height"))


def oriented(width: Column, height: Column, orientation: Column) -> Column:
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def snippet(text: Column, token: str, around: int = 20) -> Column:
    at = F.locate(token, F.lower(text))
    first = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.concat(F.lit("…"), F.trim(F.substring(text, first, at + len(token) + around - first)), F.lit("…")))


def text_score(tokens: Sequence[str], query: str, ocr: Column, tags: Column, filename: Column, place: Column) -> Column:
    """(text_score, metadata_score): 50 for each token in the text; 25 for each tag and token one of which
    holds the other, 30 and 40 for the whole query in the file name and the place."""
    words = [t.lower() for t in tokens]
    hit = lambda column, word: F.coalesce(F.lower(column).contains(word), F.lit(False)).cast("int")
    text = sum((hit(ocr, w) * 50 for w in words), F.lit(0))
    tagged = F.aggregate(F.coalesce(tags, F.array().cast("array<string>")), F.lit(0), lambda s, t: s + sum(((F.lower(t).contains(w) | F.contains(F.lit(w), F.lower(t))).cast("int") * 25 for w in words), F.lit(0)))
    return F.struct(text.alias("text_score"), (tagged + hit(filename, query.lower()) * 30 + hit(place, query.lower()) * 40).alias("metadata_score"))


def concept_score(tokens: Sequence[str], synonyms: dict[str, Sequence[str]], tags: Column, ocr: Column, filename: Column, place: Column, camera: Column) -> Column:
    """15 for each tag and concept one of which holds the other (concepts: the tokens and their synonyms), and for each token
    25 in the text, 10 in the file name, 20 in the place and 15 in the camera's name."""
    words = [t.lower() for t in tokens]
    concepts = list(dict.fromkeys([*words, *(s for w in words for s in synonyms.get(w, ()))]))
    hit = lambda column, word: F.coalesce(F.lower(column).contains(word), F.lit(False)).cast("int")
    tagged = F.aggregate(F.coalesce(tags, F.array().cast("array<string>")), F.lit(0), lambda s, t: s + sum(((F.lower(t).contains(c) | F.contains(F.lit(c), F.lower(t))).cast("int") * 15 for c in concepts), F.lit(0)))
    return tagged + sum((hit(ocr, w) * 25 + hit(filename, w) * 10 + hit(place, w) * 20 + hit(camera, w) * 15 for w in words), F.lit(0))


def hard_filter(kind: Column | None = None, camera: tuple[Column, str] | None = None, album: tuple[Column, str] | None = None, at: Column | None = None, since: int | None = None, until: int | None = None, ocr: Column | None = None) -> Column:
    """The web's filter: a kind or favourite condition, part of a camera's name, an album, days from ``since`` to
    ``until`` whole, and text."""
    holds = F.lit(True) if kind is None else kind
    if camera:
        holds = holds & F.coalesce(F.lower(camera[0]).contains(camera[1].lower()), F.lit(False))
    if album:
        holds = holds & F.coalesce(F.array_contains(album[0], album[1]), F.lit(False))
    if since is not None:
        holds = holds & (at >= since)
    if until is not None:
        holds = holds & (at <= until + 86_400_000)
    if ocr is not None:
        holds = holds & (F.length(F.trim(F.coalesce(ocr, F.lit("")))) > 0)
    return holds


def keyword_filter(terms: Sequence[str], filename: Column, is_video: Column, created: Column, backed_up: Column) -> Column:
    """Whether every term holds: words for kinds and places of storage are predicates, any other is a part of
    the file name, extension, date or status."""
    name, ext = F.lower(F.coalesce(filename, F.lit(""))), extension(F.coalesce(filename, F.lit("")))
    date = F.coalesce(F.lower(F.concat(F.date_format(created, "yyyy MMMM MMM d "), F.date_format(created, "M/d/yyyy"))), F.lit(""))
    status = F.when(backed_up, "backed up cloud s3 synced archive").otherwise("local device pending unbacked")
    holds = F.lit(True)
    for term in (t.lower() for t in terms):
        if term in PHOTO_WORDS:
            one = ~is_video
        elif term in VIDEO_WORDS:
            one = is_video
        elif term in CLOUD_WORDS:
            one = backed_up
        elif term in LOCAL_WORDS:
            one = ~backed_up
        else:
            one = name.contains(term) | ext.contains(term) | date.contains(term) | status.contains(term)
        holds = holds & one
    return holds


def export_trailer(content: Column, metadata: Column) -> Column:
    """Bytes with a JSON comment after them."""
    return F.concat(content, F.encode(F.concat(F.lit("\n/* EXPORT_METADATA: "), F.to_json(metadata), F.lit(" */")), "UTF-8"))


def part_range(plan: Column, part: Column) -> Column:
    """Inclusive byte range of a part, counted from 1."""
    start = (part - 1) * plan["part_size"]
    return F.struct(start.alias("start"), (start + F.when(part == plan["part_count"], plan["last_part_size"]).otherwise(plan["part_size"]) - 1).alias("end"))
