"""Media columns: Matroska packet tables over binary columns, and text kept as a lossless audio track."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matroska
from .common import table

UNIT = 192
PACKET = "array<struct<track:int,timestamp_ns:long,offset:long,size:long,lacing:string,keyframe:boolean,cluster_offset:long,cued:boolean,encoding:string,stripped:binary>>"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and them with spaces up to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def feature(media: matroska.Media) -> str:
    """Codec, and counts of clusters, blocks, packets by lacing and cues, with the last packet's time."""
    laces = Counter(p[4] for p in media.packets)
    track = media.tracks[0] if media.tracks else {}
    return ";".join([str(track.get("codec")), f"tracks={len(media.tracks)}", f"clusters={media.clusters}", f"blocks={media.blocks}", f"packets={len(media.packets)}", *(f"{k}={laces[k]}" for k in sorted(laces)), f"cues={len(media.cues)}", f"last_ms={max((p[1] for p in media.packets), default=0) // 1_000_000}"])


def packet_table(media: DataFrame, content: str = "media") -> DataFrame:
    """One row per packet of the Matroska files in the binary column ``content``, beside their other columns.

    Adds packet (from 0), track, timestamp_ns, offset and size (byte range in the file), lacing, keyframe,
    cluster_offset, cued (the packet's cluster is in the cues), encoding (of the stored bytes: "none", "header", "zlib", "bzip2", "lzo",
    "encrypted", joined by commas in the order applied) and stripped (bytes that stood before the stored ones; null without header stripping);
    ``parse_error`` holds what is wrong with a file that gives no packets (null content: "null"; empty: "no segment"). Parsing is a map over
    rows: no shuffle. Columns of the input with those names are replaced.
    """
    names = ["track", "timestamp_ns", "offset", "size", "lacing", "keyframe", "cluster_offset", "cued", "encoding", "stripped"]
    made = ["packets", "parse_error", "packet", *names]

    @F.pandas_udf(f"packets {PACKET}, parse_error string")
    def read(blobs):
        import pandas as pd

        rows, errors = [], []
        for blob in blobs:
            found, error = None, None
            try:
                if blob is None:
                    raise matroska.MatroskaError("null")
                m = matroska.parse(bytes(blob))
                cued = {c[2] for c in m.cues}
                heads = {p[6] for p in m.packets}
                near = {h: any(h - k in cued for k in range(5, 13)) for h in heads}
                coded = {t: (",".join(n for n, _ in e), b"".join(b for n, b in reversed(e) if n == "header") or None) for t, e in matroska.encodings_of(m).items()}
                found = [(*p, near[p[6]], *coded.get(p[0], ("none", None))) for p in m.packets]
            except matroska.MatroskaError as e:
                error = str(e)
            rows.append([dict(zip(names, p, strict=True)) for p in found] if found is not None else None)
            errors.append(error)
        return pd.DataFrame({"packets": rows, "parse_error": errors})

    kept = [c for c in media.columns if c not in made]
    boxed = media.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), read(F.col(f"`{content}`")).alias("m"))
    return boxed.select("row", F.col("m.parse_error").alias("parse_error"), F.posexplode_outer("m.packets").alias("packet", "p")).select("row.*", "parse_error", "packet", "p.*")


def text_media(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as a Matroska file (null text: as empty)."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, blobs = zip(*((n, matroska.mux(p)) for n, p in map(payload_of, b.column(1).to_pylist())), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], [id_col, "n_bytes", "media"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(store, f"{id_col} {kind}, n_bytes long, media binary")


def text_media_digest(documents: DataFrame) -> DataFrame:
    """Each text stored as Matroska, read back from the stored bytes, and described.

    The payload is the text's UTF-8 bytes (null: none) with spaces up to a positive multiple of 192; an
    empty text gives 192 spaces. Ids may be of any type. Equal texts give equal rows but for doc_id; repeated rows stay. Work is a
    map over record batches, so tasks hold one batch and no rows move.
    """
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out: list[list] = [[] for _ in range(7)]
                for text in b.column(1).to_pylist():
                    n, payload = payload_of(text)
                    blob = matroska.mux(payload)
                    media = matroska.parse(blob)
                    back = matroska.read_track(blob, media)
                    row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(media))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [f.split()[0] for f in schema.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(digest, schema)


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media_digest(table(spark, sf_dir, "documents"))
