import hashlib
import random
import zlib

import pytest

from silverquill.llm import matroska as mk
from silverquill.llm.media import op1_matroska, packet_table, payload_of, text_media, text_media_digest

from ..oracle import DATA


@pytest.mark.parametrize("mode", ["xiph", "ebml", "fixed"])
def test_lacing_round_trip(mode):
    rnd = random.Random(1)
    for _ in range(50):
        n = rnd.randrange(2, 60)
        frames = [bytes([i]) * (rnd.choice([0, 1, 254, 255, 256, 700, 20_000]) if mode != "fixed" else 33) for i in range(n)]
        block = mk.lace(frames, mode)
        sizes, at = mk.lace_sizes(block, 0, len(block), mk.LACINGS.index(mode))
        assert sizes == [len(f) for f in frames]
        got = []
        for s in sizes:
            got.append(block[at : at + s])
            at += s
        assert got == frames


def test_integers():
    for v in [0, 1, 126, 127, 128, 16382, 16383, 1 << 30, (1 << 56) - 2]:
        assert mk.read_vint(mk.vint(v), 0, 8) == (v, len(mk.vint(v)))
    assert mk.read_vint(b"\xff", 0, 1) == (None, 1)
    for bad in (b"", b"\x00", b"\x40"):
        with pytest.raises(mk.MatroskaError):
            mk.read_vint(bad, 0, len(bad))


@pytest.mark.parametrize("size", [192, 384, 192 * 33, 192 * 512, 192 * 700])
def test_payload_round_trip(size):
    payload = random.Random(size).randbytes(size)
    data = mk.mux(payload)
    media = mk.parse(data)
    assert mk.read_track(data, media) == payload and data == mk.mux(payload)
    assert len(media.packets) == size // 192 and media.clusters == len(media.cues) == -(-size // (192 * 512))
    assert [p[1] for p in media.packets] == sorted(p[1] for p in media.packets)
    for _, _, cluster, relative in media.cues:
        assert data[cluster : cluster + 4] == mk.CLUSTER.to_bytes(4, "big")
    assert all(data[p[2] : p[2] + p[3]] in payload for p in media.packets[:5])


def test_unknown_sizes_and_block_groups():
    ebml = mk.element(mk.EBML, mk.element(mk.DOC_TYPE, b"webm"))
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, mk.vint(2) + b"\x00\x05\x00" + b"abc") + mk._uint(mk.BLOCK_DURATION, 9) + mk.element(mk.REFERENCE_BLOCK, b"\xff"))
    cluster = mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + mk._uint(mk.CLUSTER_TIME, 100) + group
    data = ebml + mk.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + mk.element(mk.INFO, mk._uint(mk.TIMESTAMP_SCALE, 1000)) + mk.element(mk.VOID, b"12") + cluster + cluster
    media = mk.parse(data)
    assert media.doc_type == "webm" and media.clusters == 2
    assert [(p[0], p[1], p[3], p[5]) for p in media.packets] == [(2, 105_000, 3, False)] * 2
    assert mk.read_track(data, media, 2) == b"abcabc"


def test_broken_bytes_never_crash():
    """Whatever is wrong, it is a MatroskaError."""
    data = mk.mux(bytes(192 * 40))
    for cut in range(0, len(data), 97):
        with pytest.raises(mk.MatroskaError):
            mk.parse(data[:cut])
    rnd = random.Random(2)
    for k in range(4000):
        broken = bytearray(data)
        for _ in range(1 + k % 3):
            broken[rnd.randrange(200 if k % 2 else len(broken))] = rnd.randrange(256)
        try:
            media = mk.parse(bytes(broken))
            mk.read_track(bytes(broken), media)
            assert all(-(1 << 63) <= p[1] < 1 << 63 for p in media.packets)
        except mk.MatroskaError:
            pass


def _track_file(entry=b"", info=b"", blocks=b""):
    tracks = mk.element(mk.TRACKS, mk.element(mk.TRACK_ENTRY, mk._uint(mk.TRACK_NUMBER, 1) + entry))
    return mk.element(mk.EBML, b"") + mk.element(mk.SEGMENT, mk.element(mk.INFO, info) + tracks + mk.element(mk.CLUSTER, mk._uint(mk.CLUSTER_TIME, 0) + blocks))


def test_odd_numbers_are_parse_errors(spark):
    bad = [_track_file(info=mk.element(mk.DURATION, b"\x01\x02")), _track_file(info=mk._uint(mk.TIMESTAMP_SCALE, 1 << 62), blocks=mk.element(mk.SIMPLE_BLOCK, b"\x81\x00\x05\x00abc")), _track_file(blocks=mk.element(mk.SIMPLE_BLOCK, b"\xff\x00\x05\x00abc"))]
    rows = packet_table(spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bad)], "id long, media binary")).collect()
    assert len(rows) == 3 and all(r["parse_error"] and r["packet"] is None for r in rows)


def test_content_encodings(spark):
    """Header stripping, zlib, and both: byte ranges are of the stored bytes, the table says what stood before them."""

    def coded(*encodings):
        every = b""
        for order, (algo, settings) in enumerate(encodings):
            every += mk.element(mk.ENCODING, mk._uint(mk.ENCODING_ORDER, order) + mk.element(mk.COMPRESSION, mk._uint(mk.COMP_ALGO, algo) + (mk.element(mk.COMP_SETTINGS, settings) if settings else b"")))
        return mk.element(mk.ENCODINGS, every)

    block = lambda body: mk.element(mk.SIMPLE_BLOCK, b"\x81\x00\x00\x80" + body)
    frames = [b"HEADone", b"HEADtwo"]
    files = {
        "header": _track_file(coded((3, b"HEAD")), blocks=b"".join(block(f[4:]) for f in frames)),
        "zlib": _track_file(coded((0, b"")), blocks=b"".join(block(zlib.compress(f)) for f in frames)),
        "header,zlib": _track_file(coded((3, b"HEAD"), (0, b"")), blocks=b"".join(block(zlib.compress(f[4:])) for f in frames)),
    }
    for data in files.values():
        assert mk.read_track(data, mk.parse(data)) == b"".join(frames)
    rows = packet_table(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "name string, media binary")).collect()
    assert all(r["encoding"] == r["name"] and (r["stripped"] == b"HEAD") == ("header" in r["name"]) for r in rows) and len(rows) == 6
    first = next(r for r in rows if r["name"] == "header" and r["packet"] == 0)
    assert files["header"][first["offset"] : first["offset"] + first["size"]] == b"one"
    encrypted = _track_file(mk.element(mk.ENCODINGS, mk.element(mk.ENCODING, mk._uint(mk.ENCODING_TYPE, 1))), blocks=block(b"x"))
    with pytest.raises(mk.MatroskaError):
        mk.read_track(encrypted, mk.parse(encrypted))


def test_digest(spark):
    """Every column by hand: hashes of the payload and of the stored file, for equal, empty, null and long texts."""
    rows = [(1, "abc"), (2, None), (3, ""), (1, "abc"), (None, "é" * 5000), (5, "x" * 192), (6, "long text " * 60_000)]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id long, text string, feature string, n_bytes int")
    got = text_media_digest(df).collect()
    assert len(got) == 7
    for r, (i, t) in zip(got, rows, strict=True):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        stored = mk.mux(payload)
        assert tuple(r)[:7] == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert f"packets={len(payload) // 192};" in r["feature"]
    assert got[0]["media_sha256"] == got[3]["media_sha256"] and got[1][1:] == got[2][1:]
    assert text_media_digest(df.limit(0)).count() == 0
    assert text_media_digest(spark.createDataFrame([("a", "b")], "doc_id string, text string")).first()["doc_id"] == "a"


def test_digest_of_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op1_matroska(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        n, payload = payload_of(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_sha256"], r["media_sha256"]) == (n, hashlib.sha256(payload).hexdigest(), hashlib.sha256(mk.mux(payload)).hexdigest())


def test_packet_table(spark):
    df = text_media(spark.createDataFrame([(1, "a" * 7000), (2, None)], "doc_id long, text string"))
    rows = packet_table(df.unionByName(spark.createDataFrame([(3, 0, None), (4, 0, bytearray(b"oops"))], "doc_id long, n_bytes long, media binary"))).collect()
    assert sum(r["size"] for r in rows if r["doc_id"] == 1) == 7104 and all(r["cued"] for r in rows if r["doc_id"] == 1)
    assert {r["doc_id"]: r["parse_error"] is None for r in rows} == {1: True, 2: True, 3: False, 4: False}
