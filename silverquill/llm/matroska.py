"""Matroska: write and parse EBML, clusters, lacing and cues (pure functions on bytes).

``mux`` writes one audio track of 8-bit PCM; ``parse`` reads any Matroska or WebM byte string into
tracks, packets (track, timestamp, byte range, lacing) and cues.
"""

from __future__ import annotations

import bz2
import struct
import zlib
from dataclasses import dataclass, field

# Fixed values of the format: element ids, master elements.
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, VIDEO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0xE0
CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS = 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TIMESTAMP_SCALE, DURATION, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, SAMPLING, CHANNELS, BIT_DEPTH, FLAG_LACING = 0x23E383, 0xB5, 0x9F, 0x6264, 0x9C
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA1, 0x9B, 0xFB
CUE_TIME, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xB3, 0xF7, 0xF1, 0xF0
ENCODINGS, ENCODING, ENCODING_ORDER, ENCODING_SCOPE, ENCODING_TYPE, COMPRESSION, COMP_ALGO, COMP_SETTINGS = 0x6D80, 0x6240, 0x5031, 0x5032, 0x5033, 0x5034, 0x4254, 0x4255
COMPRESSIONS = ("zlib", "bzip2", "lzo", "header")
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION, VOID = 0x4282, 0x4287, 0x4285, 0xEC
LACINGS = ("none", "xiph", "fixed", "ebml")
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}


class MatroskaError(ValueError):
    """The bytes break the format at the offset given."""


@dataclass
class Media:
    doc_type: str = ""
    timestamp_scale: int = 1_000_000
    duration: float | None = None
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, str, bool, int]] = field(default_factory=list)
    """(track, timestamp in ns, offset, size, lacing, keyframe, offset of the cluster)"""
    cues: list[tuple[int, int, int, int | None]] = field(default_factory=list)
    """(track, timestamp in ns, offset of the cluster, offset of the block or null)"""
    clusters: int = 0
    blocks: int = 0


def vint(value: int, length: int | None = None) -> bytes:
    """A size as a variable-length integer; all ones means unknown and is never written."""
    n = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def signed_vint(value: int) -> bytes:
    n = next(n for n in range(1, 9) if abs(value) < (1 << (7 * n - 1)))
    return vint(value + (1 << (7 * n - 1)) - 1, n)


def read_vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """The integer at ``at`` (None: unknown size) and the place after it."""
    if at >= end:
        raise MatroskaError(f"no integer at {at}")
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > end:
        raise MatroskaError(f"bad integer at {at}")
    raw = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return raw, at + length
    value = raw ^ (1 << 7 * length)
    return (None if value == (1 << 7 * length) - 1 else value), at + length


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _uint(eid: int, value: int) -> bytes:
    return element(eid, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], mode: str) -> bytes:
    """Lace count and sizes, then the frames (nothing before a single unlaced frame)."""
    if mode == "none":
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if mode == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif mode == "ebml":
        head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes[:-1], sizes[1:-1], strict=False))
    return head + b"".join(frames)


def mux(payload: bytes, frame_bytes: int = 192, laces: int = 32, blocks_per_cluster: int = 16, rate: int = 8000) -> bytes:
    """``payload`` as one track of 8-bit PCM: frames laced into SimpleBlocks (lacing modes take turns),
    clusters, and a cue for each cluster. Equal payloads give equal bytes."""
    frames = [payload[i : i + frame_bytes] for i in range(0, len(payload), frame_bytes)]
    header = element(EBML, element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", rate)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, frame_bytes * 1_000_000_000 // rate) + audio
    body = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues, ms = sum(map(len, body)), [], frame_bytes * 1000 / rate
    for c in range(0, len(frames), laces * blocks_per_cluster):
        start = round(c * ms)
        blocks = [_uint(CLUSTER_TIME, start)]
        for k, b in enumerate(range(c, min(c + laces * blocks_per_cluster, len(frames)), laces)):
            some = frames[b : b + laces]
            mode = LACINGS[k % 3 + 1] if len(some) > 1 else "none"
            if mode == "fixed" and len({len(f) for f in some}) > 1:
                mode = "xiph"
            head = vint(1) + struct.pack(">hB", round(b * ms) - start, 0x80 | LACINGS.index(mode) << 1)
            blocks.append(element(SIMPLE_BLOCK, head + lace(some, mode)))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, start) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at) + _uint(CUE_RELATIVE, len(blocks[0])))))
        body.append(element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    return header + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def _children(data: bytes, at: int, end: int):
    """(id, start, end) of each child; an unknown size ends at the next top-level element or the parent's end."""
    while at < end:
        eid, body = read_vint(data, at, end, keep_marker=True)
        size, body = read_vint(data, body, end)
        if size is None:
            stop = end if eid == SEGMENT else _unknown_end(data, body, end)
        else:
            stop = body + size
            if stop > end:
                raise MatroskaError(f"element at {at} passes the end of its parent")
        yield eid, body, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        eid, body = read_vint(data, at, end, keep_marker=True)
        if eid in TOP_LEVEL:
            return at
        size, body = read_vint(data, body, end)
        if size is None or body + size > end:
            raise MatroskaError(f"bad size in an element of unknown size at {at}")
        at = body + size
    return end


def _num(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise MatroskaError(f"a number of {b - a} bytes at {a}")
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def lace_sizes(data: bytes, at: int, end: int, mode: int) -> tuple[list[int], int]:
    """Sizes of the frames of a laced block whose lace head is at ``at``; and the first frame's place."""
    if mode == 0:
        return [end - at], at
    if at >= end:
        raise MatroskaError(f"no lace count at {at}")
    n, at = data[at] + 1, at + 1
    if mode == 2:
        if (end - at) % n:
            raise MatroskaError(f"fixed-size laces at {at} don't divide {end - at} bytes")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    if mode == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError(f"lace sizes pass the block's end at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            start = at
            value, at = read_vint(data, at, end, keep_marker=True)
            length = at - start
            value ^= 1 << 7 * length
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << (7 * length - 1)) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise MatroskaError(f"lace sizes at {at} pass the block's end")
    return [*sizes, last], at


def _block(data: bytes, a: int, b: int, when: int, cluster: int, media: Media, durations: dict[int, int], keyframe: bool | None) -> None:
    track, at = read_vint(data, a, b)
    if track is None or at + 3 > b:
        raise MatroskaError(f"short block at {a}")
    offset, flags = struct.unpack_from(">hB", data, at)
    mode, scale = flags >> 1 & 3, media.timestamp_scale
    sizes, at = lace_sizes(data, at + 3, b, mode)
    start, step, key = (when + offset) * scale, durations.get(track, 0), bool(flags & 0x80) if keyframe is None else keyframe
    if abs(start) + (len(sizes) + 1) * step >= 1 << 63:
        raise MatroskaError(f"a time beyond 64 bits at {a}")
    media.blocks += 1
    name, packets = LACINGS[mode], media.packets
    for i, size in enumerate(sizes):
        packets.append((track, start + i * step, at, size, name, key, cluster))
        at += size


def parse(data: bytes) -> Media:
    """Everything in ``data``; raises MatroskaError where it breaks the format. Offsets count from its start."""
    media, durations, segments = Media(), {}, 0
    for eid, a, b in _children(data, 0, len(data)):
        if eid == EBML:
            media.doc_type = next((data[x:y].rstrip(b"\0").decode("ascii", "replace") for e, x, y in _children(data, a, b) if e == DOC_TYPE), "")
        elif eid == SEGMENT:
            segments += 1
            _segment(data, a, b, media, durations)
    if not segments:
        raise MatroskaError("no segment")
    return media


def _segment(data: bytes, a: int, b: int, media: Media, durations: dict[int, int]) -> None:
    for eid, x, y in _children(data, a, b):
        if eid == INFO:
            for e, p, q in _children(data, x, y):
                if e == TIMESTAMP_SCALE:
                    media.timestamp_scale = _num(data, p, q)
                elif e == DURATION:
                    media.duration = _float(data, p, q)
        elif eid == TRACKS:
            for e, p, q in _children(data, x, y):
                if e == TRACK_ENTRY:
                    media.tracks.append(_track(data, p, q))
                    durations[media.tracks[-1].get("number", 0)] = media.tracks[-1].get("default_duration", 0)
        elif eid == CLUSTER:
            media.clusters += 1
            when, head = 0, x
            for e, p, q in _children(data, x, y):
                if e == CLUSTER_TIME:
                    when = _num(data, p, q)
                elif e == SIMPLE_BLOCK:
                    _block(data, p, q, when, head, media, durations, None)
                elif e == BLOCK_GROUP:
                    inner = list(_children(data, p, q))
                    key = all(c != REFERENCE_BLOCK for c, _, _ in inner)
                    for c, m, n in inner:
                        if c == BLOCK:
                            _block(data, m, n, when, head, media, durations, key)
        elif eid == CUES:
            for e, p, q in _children(data, x, y):
                if e == CUE_POINT:
                    inner = list(_children(data, p, q))
                    time = next((_num(data, m, n) for c, m, n in inner if c == CUE_TIME), 0)
                    for c, m, n in inner:
                        if c == CUE_POSITIONS:
                            got = {k: _num(data, s, t) for k, s, t in _children(data, m, n) if k in (CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE)}
                            media.cues.append((got.get(CUE_TRACK, 0), time * media.timestamp_scale, a + got.get(CUE_CLUSTER, 0), got.get(CUE_RELATIVE)))


def _track(data: bytes, a: int, b: int) -> dict:
    track: dict = {}
    for e, p, q in _children(data, a, b):
        if e == TRACK_NUMBER:
            track["number"] = _num(data, p, q)
        elif e == TRACK_TYPE:
            track["type"] = _num(data, p, q)
        elif e == CODEC_ID:
            track["codec"] = data[p:q].rstrip(b"\0").decode("ascii", "replace")
        elif e == DEFAULT_DURATION:
            track["default_duration"] = _num(data, p, q)
        elif e == ENCODINGS:
            track["encodings"] = [found for _, found in sorted((_encoding(data, m, n) for c, m, n in _children(data, p, q) if c == ENCODING), key=lambda x: x[0])]
        elif e == AUDIO:
            for c, m, n in _children(data, p, q):
                if c == SAMPLING:
                    track["rate"] = _float(data, m, n)
                elif c in (CHANNELS, BIT_DEPTH):
                    track["channels" if c == CHANNELS else "bits"] = _num(data, m, n)
    return track


def _encoding(data: bytes, a: int, b: int) -> tuple[int, tuple[str, bytes]]:
    """Order, and name with settings, of one encoding of a track's frames."""
    order, scope, kind, algo, settings = 0, 1, 0, 0, b""
    for e, p, q in _children(data, a, b):
        if e == ENCODING_ORDER:
            order = _num(data, p, q)
        elif e == ENCODING_SCOPE:
            scope = _num(data, p, q)
        elif e == ENCODING_TYPE:
            kind = _num(data, p, q)
        elif e == COMPRESSION:
            for c, m, n in _children(data, p, q):
                if c == COMP_ALGO:
                    algo = _num(data, m, n)
                elif c == COMP_SETTINGS:
                    settings = data[m:n]
    if not scope & 1:  # not of the frames
        return order, ("none", b"")
    name = "encrypted" if kind else COMPRESSIONS[algo] if algo < len(COMPRESSIONS) else "unknown"
    return order, (name, settings if name == "header" else b"")


def encodings_of(media: Media) -> dict[int, list[tuple[str, bytes]]]:
    """The encodings of each track's frames, in the order in which they were applied; tracks without any are left out."""
    found = {t.get("number", 0): [e for e in t.get("encodings", []) if e[0] != "none"] for t in media.tracks}
    return {t: e for t, e in found.items() if e}


def decode_frame(frame: bytes, encodings: list[tuple[str, bytes]]) -> bytes:
    """The frame as it was before its track's encodings."""
    for name, settings in reversed(encodings):
        try:
            if name == "header":
                frame = settings + bytes(frame)
            elif name == "zlib":
                frame = zlib.decompress(frame)
            elif name == "bzip2":
                frame = bz2.decompress(frame)
            else:
                raise MatroskaError(f"frames are encoded by {name}")
        except (zlib.error, OSError, ValueError) as e:
            raise e if isinstance(e, MatroskaError) else MatroskaError(f"a frame is no {name} data") from e
    return bytes(frame)


def read_track(data: bytes, media: Media, track: int = 1) -> bytes:
    """The track's frames, decoded, joined in file order."""
    view, encodings = memoryview(data), encodings_of(media).get(track)
    frames = [view[at : at + size] for t, _, at, size, *_ in media.packets if t == track]
    return b"".join([decode_frame(f, encodings) for f in frames] if encodings else frames)
