import itertools
import random

import pytest
from pyspark.sql import functions as F

from silverquill.functions import expr
from silverquill.functions.udf import decode_vector, encode_float16, project, random_matrix, read_exif, scan_exif, tokens
from silverquill.operators import catalog, fusion, jobs, lifecycle, relational, resolve, sync, text, vector
from silverquill.plans import catalogue, fixtures as fx
from silverquill.schemas import ALL, assert_foreign, assert_unique, schema


def one(df):
    return df.first()[0]


def scalar(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_schemas(spark):
    for name in ALL:
        assert len(schema(name)) > 1
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert assert_unique(df, "a").count() == 1 and assert_unique(df, "b").count() == 0
    assert assert_foreign(df, df.where("b = 2").select("b"), "b").count() == 1


# Expected steps of the 17 files of the export.
STEPS = {
    "IMG_1234.jpg": "exact", "IMG_1234(1).jpg": "disambiguator-swap", "2019-06-08_family_reunion_backyard_barbecue_photo.jpg": "truncated",
    "IMG_2001.HEIC": "exact", "IMG_2001.MOV": "unique-basename", "IMG_2002.jpg": "exact", "IMG_2002-edited.jpg": "unpaired",
    "IMG_3001.jpg": "exact", "IMG_3001-bearbeitet.jpg": "exact", "IMG_3002.jpg": "exact", "IMG_3002-modifié.jpg": "unpaired",
    "IMG_3002-editado.jpg": "unpaired", "IMG_0042.JPG": "unique-basename", "VID_20210704_121314.mp4": "unpaired",
    "IMG_7777.jpg": "exact", "IMG_5001.jpg": "exact", "IMG_8001.jpg": "exact",
}


def export(spark):
    """(media, sidecars) of the one archive that the cases come from."""
    rows = lambda cases, names: spark.sql(f"SELECT * FROM {fx.values(cases, names)}")
    return rows(fx.MEDIA, "part, dir, name, archived, trashed"), rows(fx.SIDECARS, "dir, name")


def test_pairing_of_the_export(spark):
    got = {r["name"]: r for r in resolve.pair_sidecars(*export(spark)).collect() if r["dir"] != "Edge cases"}
    assert {n: r["step"] for n, r in got.items()} == STEPS
    assert got["IMG_2001.MOV"]["shared"] and not got["IMG_2001.HEIC"]["shared"]


def test_pairing_edge_cases(spark):
    got = {r["name"]: r for r in resolve.pair_sidecars(*export(spark)).collect() if r["dir"] == "Edge cases"}
    assert got["A.png"]["reason"] == got["A.mov"]["reason"] == "contested-sidecar"
    assert got["C.gif"]["reason"] == "ambiguous-basename" and got["D.jpg"]["reason"] == "no-candidate"


def test_variants_and_live_pairs(spark):
    links = {r["name"]: (r["base"], r["matched_by"]) for r in resolve.link_variants(export(spark)[0]).collect()}
    assert links["IMG_3002-modifié.jpg"] == ("IMG_3002.jpg", "same-name") and links["D-edited.webp"] == (None, "ambiguous-base")
    pairs = {r["stem"]: (r["still"], r["motion"], r["status"]) for r in resolve.live_pairs(export(spark)[0], resolve.pair_sidecars(*export(spark))).collect()}
    assert pairs["IMG_2001"] == ("IMG_2001.HEIC", "IMG_2001.MOV", "paired")
    assert pairs["B"] == ("B.heic", "B.MOV", "paired") and pairs["E"][2] == "ambiguous"


def test_dispositions(spark):
    media = export(spark)[0]
    folders = media.select("dir").distinct().select("dir", F.col("dir").alias("folder"), F.col("dir").isin("Iceland 2019", "Familienurlaub 2020").alias("has_metadata"))
    rows = {r["name"]: r for r in resolve.dispositions(media, folders).withColumn("archived_by", F.array_join("archived_by", ",")).collect()}
    assert not rows["IMG_8001.jpg"]["imported"] and rows["IMG_5001.jpg"]["archived_by"] == "folder,sidecar"
    assert len(fx.MEDIA) == len({(m[1], m[2]) for m in fx.MEDIA})


def test_rrf_golden(spark):
    lists = [spark.createDataFrame([(h, i + 1) for i, h in enumerate(x)], "h string, rank int") for x in (["hA", "hB", "hC"], ["hB", "hD", "hA"])]
    order = [r["h"] for r in fusion.rrf(lists, "h").orderBy(F.desc("score"), "h").collect()]
    assert order[:2] == ["hB", "hA"]
    swapped = {r["h"]: r["score"] for r in fusion.rrf(lists[::-1], "h").collect()}
    assert all(abs(swapped[r["h"]] - r["score"]) < 1e-15 for r in fusion.rrf(lists, "h").collect())


def test_tokens_and_search(spark):
    docs = spark.createDataFrame([("d1", "Café receipt 4417"), ("d2", "cafe parking"), ("d3", "SFO -> NRT: Gate 42 boarding"), ("d4", "whiteboard"), ("d5", "渋谷駅 sign"), ("d6", " ")], "h string, t string")
    assert docs.where("h = 'd3'").select(tokens(F.col("t"))).first()[0] == ["sfo", "nrt", "gate", "42", "boarding"]
    find = lambda q, **k: [r["h"] for r in text.search(docs, "h", "t", q, **k).collect()]
    assert sorted(find("café")) == sorted(find("cafe")) == ["d1", "d2"]
    assert find("board*", prefixes=True) == ["d3"] and find("渋谷", cjk_split=True) == ["d5"] and find("渋谷") == []
    assert find("4417") == ["d1"] and find("") == [] and find("nothing here") == []


def test_indexed_and_unindexed_search_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index, lengths = text.postings(docs, "doc_id", "text").cache(), text.document_lengths(docs, "doc_id", "text")
    for q in ("the of", "th* and", "de"):
        a, b = (df.select("doc_id", F.round("score", 9)).collect() for df in (text.bm25(index, lengths, "doc_id", text.parse_query(q)), text.search(docs, "doc_id", "text", q, prefixes=True)))
        assert a == b and a


def test_index_upsert_keeps_blank(spark):
    index = text.postings(spark.createDataFrame([("a", "one two"), ("b", "three")], "h string, t string"), "h", "t")
    after = text.index_upsert(index, spark.createDataFrame([("a", "four"), ("b", " ")], "h string, t string"), "h", "t")
    assert sorted((r["h"], r["token"]) for r in after.collect()) == [("a", "four"), ("b", "three")]


def test_two_stage_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    hits = 0
    for q in (3, 99, 250):
        query = vector.vector_of(v, "vec_id", q, "embedding")
        exact = {r["vec_id"] for r in vector.exact_topk(v, "vec_id", "embedding", query, 10).collect()}
        hits += len(exact & {r["vec_id"] for r in vector.two_stage(v, "vec_id", "embedding", query, 50, 10).collect()})
    assert hits >= 0.95 * 30


def test_projection_and_float16(spark):
    df = spark.createDataFrame([(1, [float(i % 7 - 3) for i in range(512)])], "id int, v array<float>")
    p = df.select(project(F.col("v"), random_matrix(512, 256))).first()[0]
    assert len(p) == 256 and abs(sum(x * x for x in p) - 1) < 1e-9
    back = df.select(decode_vector(encode_float16(F.col("v"))).alias("b"), "v").select(expr.cosine(F.col("b"), F.col("v"))).first()[0]
    assert back > 0.999


def test_quantize_truncates(spark):
    assert scalar(spark, expr.quantize(F.array(F.lit(0.999), F.lit(-0.999), F.lit(1.0), F.lit(-1.0), F.lit(0.0078)))) == [127, -127, 127, -128, 0]


@pytest.mark.parametrize("seed", range(3))
def test_lww_is_order_free(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, rnd.randrange(20), rnd.choice([None, None, 5]), v, float(v)) for v, k in enumerate(rnd.choices(range(5), k=30), 1)]
    ddl = "key long, updated_at long, deleted_at long, version long, payload double"
    local = spark.createDataFrame([(0, 3, None, 0, -1.0)], ddl)
    want = sorted(map(tuple, sync.lww_merge(local, spark.createDataFrame(rows, ddl), "key").collect()))
    rnd.shuffle(rows)
    step = sync.lww_merge(sync.lww_merge(local, spark.createDataFrame(rows[:15], ddl), "key"), spark.createDataFrame(rows, ddl), "key")
    assert sorted(map(tuple, step.collect())) == want


def test_lww_reference_mode_revives(spark):
    ddl = "key long, updated_at long, deleted_at long, version long, payload double"
    local = spark.createDataFrame([(1, 10, 10, 1, 1.0), (2, 10, None, 1, 1.0)], ddl)
    remote = spark.createDataFrame([(1, 5, None, 2, 2.0), (2, 5, None, 2, 2.0), (3, 1, None, 2, 3.0)], ddl)
    ref = {r["key"]: (r["payload"], r["version"], r["deleted_at"]) for r in sync.lww_merge(local, remote, "key", "reference").collect()}
    assert ref == {1: (2.0, 2, None), 2: (1.0, 2, None), 3: (3.0, 2, None)}
    doc = {r["key"]: (r["payload"], r["deleted_at"]) for r in sync.lww_merge(local, remote, "key").collect()}
    assert doc[1] == (1.0, 10)


def test_queue(spark):
    ev = [(1, 0, "enqueue", 0), (1, 10, "claim", 0), (1, 20, "complete", 1), (2, 0, "enqueue", 0), (2, 10, "claim", 0), (2, 20, "fail", 1), (2, 25, "claim", 0), (2, 5000, "claim", 0), (2, 6000, "complete", 1), (3, 0, "enqueue", 0), (3, 5, "claim", 0), (3, 5 + 60_000, "claim", 0)]
    df = spark.createDataFrame([(i, at, e, a, k) for k, (i, at, e, a) in enumerate(ev)], "id long, at long, event string, attempt int, seq int")
    got = {r["id"]: (r["state"], r["attempts"]) for r in jobs.reduce_events(df).collect()}
    assert got == {1: (2, 1), 2: (1, 2), 3: (1, 2)}


def test_claim_takes_the_lowest_priority_number(spark):
    df = spark.createDataFrame([(1, 0, 5, 0, 0), (2, 0, 1, 50, 0), (3, 1, 0, 10, 1), (4, 1, 0, 10, 5)], "id long, state int, priority int, next_attempt_at long, attempts int")
    assert [r["id"] for r in jobs.claim(df, 100, 4).collect()] == [2, 1, 3]
    assert {r["id"]: r["state"] for r in jobs.reap(df, 100).collect()}[4] == 4


def test_lru_matches_a_walk(spark):
    rows = [(i, (i * 37) % 11 + 1, i // 3) for i in range(200)]
    cache = spark.createDataFrame(rows, "k int, b long, u long")
    running, out = sum(b for _, b, _ in rows), []
    for k, b, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if running <= 500:
            break
        running -= b
        out.append(k)
    assert sorted(r["k"] for r in relational.lru_evictions(cache, "k", "b", "u", 500, 20).collect()) == sorted(out)
    assert relational.lru_evictions(cache, "k", "b", "u", 1 << 40).count() == 0


def test_upsert_and_counts(spark):
    old, new = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), spark.createDataFrame([(2, 9), (2, 7), (3, 3)], "k int, v int")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"], ["v"]).collect())) == [(1, 1), (2, 9), (3, 3)]
    assert sorted(map(tuple, relational.counts_with_zeros(new, "k", [2, 5]).collect())) == [(2, 2), (5, 0)]
    assert sorted(map(tuple, relational.insert_or_ignore(old, new, "k").collect()))[:2] == [(1, 1), (2, 2)]


def test_pages_follow_one_another(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(20)], "k int, t int")
    first = relational.timeline(df, "t", "k", F.lit(False), 7).collect()
    second = relational.timeline_after(df, "t", "k", first[-1]["t"], first[-1]["k"], 7).collect()
    assert [r["k"] for r in first + second] == [r["k"] for r in df.orderBy(F.desc("t"), "k").limit(14).collect()]


def test_merge_parts(spark):
    files = spark.createDataFrame([("a", 1, "p1", 0), ("a", 1, "p2", 1), ("a", 2, "p3", 2), ("b", 1, "p3", 2)], "path string, byte_size long, part string, part_index int")
    got = {(r["path"], r["byte_size"]): (r["source_path"], r["copies"], r["conflict"]) for r in resolve.merge_parts(files).collect()}
    assert got == {("a", 1): ("a", 2, True), ("a", 2): ("p3/a", 1, True), ("b", 1): ("b", 1, False)}


def test_dedupe_labels(spark):
    s = spark.createDataFrame([(1, "h", "a", 5), (2, "h", "b", 5), (3, "h", "a", 5), (4, "g", "c", 7)], "i int, hash string, ref string, size long")
    assert [r["label"] for r in catalog.sighting_labels(s, "i").orderBy("i").collect()] == ["first", "duplicate", "repeat", "first"]
    assert tuple(catalog.dedupe_ledger(s).first()) == (2, 3, 5, 0, 0)
    decided = catalog.dedupe_decision(s.select("ref", "hash", "size"), spark.createDataFrame([("h", 5)], "hash string, size long"), spark.createDataFrame([("a", "h"), ("c", "z")], "ref string, hash string"))
    assert {(r["ref"], r["decision"]) for r in decided.collect()} == {("a", "repeat"), ("b", "duplicate"), ("c", "diverged")}


@pytest.mark.parametrize(("column", "want"), [
    (lambda: expr.multipart(F.lit(50 << 30))["part_size"], 6 << 20), (lambda: expr.multipart(F.lit(0)), None), (lambda: expr.disambiguator_probe(F.lit("a.b(12).jpg")), "a.b.jpg(12).json"),
    (lambda: expr.edited_base(F.lit("-edited.jpg")), None), (lambda: expr.edited_base(F.lit("X-Bearbeitet.jpg")), "X"), (lambda: expr.exif_offset_minutes(F.lit("-03:30")), -210),
    (lambda: expr.exif_offset_minutes(F.lit("+15:00")), None), (lambda: expr.exif_millis(F.lit("2019:02:30 00:00:00"), F.lit(0)), None), (lambda: expr.sidecar_millis(F.lit("0")), None),
    (lambda: expr.is_object_key(F.lit("a/../b")), False), (lambda: expr.is_object_key(F.lit("a/b.c")), True), (lambda: expr.is_content_hash(F.lit("A" * 64)), False),
    (lambda: expr.format_bytes(F.lit(1536)), "1.5 KB"), (lambda: expr.format_bytes(F.lit(0)), "0 B"), (lambda: expr.has_bits(F.lit(6), 6), True), (lambda: expr.remove_bits(F.lit(7), 2), 5),
    (lambda: expr.backoff_delay(F.lit(1), F.lit(0.0)), 500), (lambda: expr.backoff_delay(F.lit(50), F.lit(1.0)), 300_000), (lambda: expr.stem(F.lit(".hidden")), ".hidden"),
    (lambda: expr.base64_to_hex(expr.hex_to_base64(F.lit("00ff"))), "00ff"), (lambda: expr.year_bucket(F.lit("Photos from 2019")), 2019), (lambda: expr.fit_long_edge(F.lit(4000), F.lit(3000), 1000)["height"], 750),
    (lambda: expr.part_number(F.lit("takeout-003")), 3), (lambda: expr.verify_method(F.lit(True), F.lit(False), F.lit(3)), "full"),
])
def test_scalars(spark, column, want):
    assert scalar(spark, column()) == want


def test_cost_and_purge(spark):
    c = scalar(spark, expr.monthly_cost(F.lit(50 << 30), F.lit(5 << 30)))
    assert c["within_ceiling"] and not c["egress_alarm"] and scalar(spark, expr.monthly_cost(F.lit(0), F.lit(75 << 30)))["egress_alarm"]
    a = spark.createDataFrame([("a", 2, 6, 1), ("b", 2, 4, 1), ("c", 1, 6, 1), ("d", 2, 7, 2)], "hash string, remote_state int, derivative_mask int, local_state int")
    got = {r["hash"]: (r["eligible"], r["next_local_state"]) for r in lifecycle.purge_eligibility(a).collect()}
    assert got == {"a": (True, 2), "b": (False, 1), "c": (False, 1), "d": (True, 2)}
    audit, after = lifecycle.purge_batch(a, spark.createDataFrame([("d", 0), ("a", 0)], "hash string, outcome int"))
    assert [r["hash"] for r in audit.collect()] == ["d"] and one(after.where("hash = 'd'").select("local_state")) == 3


def test_exif_of_a_tiff():
    import struct

    def ifd(entries):
        return struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0" * 4

    text_at = 8 + 18 + 30
    data = b"II*\0" + struct.pack("<I", 8) + ifd([(0x8769, 4, 1, 26)]) + ifd([(0x9003, 2, 20, text_at), (0x9011, 2, 7, text_at + 20)]) + b"2019:06:01 08:00:00\0+02:00\0"
    assert read_exif(data) == ("2019:06:01 08:00:00", "+02:00")
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data
    assert scan_exif(b"\xff\xd8\xff\x01\xff\xff" + jpeg[2:])[0] == "2019:06:01 08:00:00"
    for cut in range(len(jpeg)):  # a value is whole or not given, and the bytes say that they end too early
        got = scan_exif(jpeg[:cut])
        assert got[:2] == (None, None) and (got[2] or cut < 2)
    for cut in range(9, len(data)):
        date, offset, short = scan_exif(data[:cut])
        assert date in (None, "2019:06:01 08:00:00") and offset in (None, "+02:00") and (short or (date and offset))
    assert read_exif(b"") == (None, None) and read_exif(b"\xff\xd8\xff\xe1") == (None, None)
    assert read_exif(jpeg)[0] == "2019:06:01 08:00:00"
    for cut in range(len(jpeg)):
        read_exif(jpeg[:cut])


def test_ranking_agreement(spark):
    a, b = (spark.createDataFrame([(1, k, i) for i, k in enumerate(x)], "q int, k int, rank int") for x in ([1, 2, 3], [1, 3, 2]))
    assert tuple(fusion.ranking_agreement(a, b, "q", "k").first()) == (1, True, False)
    assert list(itertools.chain(*fusion.retrieval_quality(a.withColumnRenamed("rank", "rank"), spark.createDataFrame([(1, 1, 1), (1, 9, 1), (1, 3, -1)], "q int, k int, grade int"), "q", "k").select("recall", "forbidden").collect())) == [0.5, 1]
