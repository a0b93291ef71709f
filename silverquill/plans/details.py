"""More queries of the engine: codecs, readers, plans, queues and lists, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.udf import decode_vector, encode_float16_floor, token_totals
from ..operators import catalog, fusion, ingest, lifecycle, relational, resolve, sync, vector
from ..sources import files, manifest
from ..session import table
from . import fixtures as fx
from .registry import query

# Codecs and keys -------------------------------------------------------------------------------------


@query("SELECT doc_id, to_base64(unhex(sha256(text))) AS base64, sha256(text) AS back, TRUE AS same FROM documents")
def digest_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = expr.checked_hash(expr.content_hash(F.col("text")))
    coded = table(spark, sf_dir, "documents").select("doc_id", h.alias("h"), expr.hex_to_base64(h).alias("base64"))
    return coded.select("doc_id", "base64", expr.base64_to_hex(F.col("base64")).alias("back"), (expr.base64_to_hex(F.col("base64")) == F.col("h")).alias("same"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('device:', event_type, ':', user_id) ELSE concat('takeout:', user_id) END AS ref FROM events")
def source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "device").otherwise("takeout")
    return table(spark, sf_dir, "events").select("event_id", expr.source_ref(kind, F.col("event_type"), F.col("user_id").cast("string")).alias("ref"))


@query("""SELECT doc_id, sha256(concat(text, chr(10), '/* EXPORT_METADATA: {"id":', doc_id, ',"source":"', source, '"} */')) AS digest FROM documents""")
def export_trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(expr.export_trailer(F.col("text").cast("binary"), F.struct(F.col("doc_id").alias("id"), "source")), 256).alias("digest"))


@query(r"""WITH n AS (SELECT doc_id, n_chars * (doc_id * doc_id * 7919 % 100000007) AS n FROM documents), p AS (SELECT *, CASE WHEN n > 0 THEN least(4, floor(ln(n) / ln(1024) + 1e-12)) ELSE 0 END::int AS p FROM n)
SELECT doc_id, concat(regexp_replace(printf('%.2f', n / 1024.0::double ** p), '\.?0+$', ''), ' ', ['B', 'KB', 'MB', 'GB', 'TB'][p + 1]) AS size FROM p""")
def byte_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars") * (F.col("doc_id") * F.col("doc_id") * 7919 % 100000007)
    return table(spark, sf_dir, "documents").select("doc_id", expr.format_bytes(n).alias("size"))


@query("""WITH s AS (SELECT p_partkey, p_size * 97 AS w, (p_partkey * 37 % 4000 + 1)::int AS h, p_partkey % 10 AS o FROM part), t AS (SELECT *, CASE WHEN o BETWEEN 5 AND 8 THEN h ELSE w END AS ow, CASE WHEN o BETWEEN 5 AND 8 THEN w ELSE h END AS oh FROM s), u AS (SELECT *, least(1.0::double, 2048.0::double / greatest(ow, oh)) AS k FROM t)
SELECT p_partkey, greatest(1, floor(ow * k + 0.5))::int AS width, greatest(1, floor(oh * k + 0.5))::int AS height FROM u""")
def fitted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 97, (F.col("p_partkey") * 37 % 4000 + 1).cast("int")
    turned = table(spark, sf_dir, "part").select("p_partkey", expr.oriented(w, h, F.col("p_partkey") % 10).alias("o"))
    return turned.select("p_partkey", expr.fit_long_edge(F.col("o.width"), F.col("o.height"), 2048).alias("f")).select("p_partkey", "f.*")


@query("SELECT o_orderkey, concat('u1/manifest/', strftime(o_orderdate, '%Y-%m'), '.ndjson') AS key FROM orders")
def manifest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", expr.manifest_key(F.lit("u1"), F.date_format("o_orderdate", "yyyy-MM")).alias("key"))


@query("""WITH o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'object not found' END AS gone, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'checksum' ELSE 'full' END AS method, doc_id % 9 = 0 AS wrong FROM documents)
SELECT doc_id, method, gone IS NULL AND NOT wrong AS verified, coalesce(gone, CASE WHEN wrong THEN concat(method, ' mismatch') END) AS problem FROM o""")
def verify_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, h = F.col("doc_id"), F.sha2("text", 256)
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 9 == 0, F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(h).alias("hash"), F.when(i % 7 != 0, F.col("text").cast("binary")).alias("content"), F.when(i % 3 == 0, expr.hex_to_base64(h)).alias("checksum"), F.lit(None).cast("string").alias("composite"), (1 + i % 2).alias("part_count"))
    return lifecycle.verify_objects(d).select("doc_id", "method", "verified", "problem")


# Vectors ---------------------------------------------------------------------------------------------


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::double * 127 + 0.5)::int))), ',') AS coarse FROM embeddings")
def vector_web_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(expr.quantize_round(F.col("embedding")), lambda x: x.cast("string")), ",").alias("coarse"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
f AS (SELECT vec_id, list_transform(v, lambda x: sign(x) * floor(abs(x) * 2.0::DOUBLE ** (10 - floor(log2(greatest(abs(x), 2.0::DOUBLE ** -14))))) * 2.0::DOUBLE ** (floor(log2(greatest(abs(x), 2.0::DOUBLE ** -14))) - 10)) AS h FROM v)
SELECT vec_id, len(h) * 8 AS numbers, round(8 * list_sum(h), 6) AS total, round(h[1], 9) AS first, round(h[len(h)], 9) AS last FROM f""")
def vector_half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half precision, cut off towards zero, and back: 512 numbers are 1024 bytes."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.flatten(F.array_repeat("embedding", 8)).alias("v"), F.size("embedding").alias("n"))
    back = v.select("vec_id", "n", decode_vector(encode_float16_floor(F.col("v"))).alias("b"))
    total = F.aggregate("b", F.lit(0.0), lambda a, x: a + x.cast("double"))
    at = lambda k: F.round(F.element_at("b", k).cast("double"), 9)
    return back.select("vec_id", F.size("b").cast("long").alias("numbers"), F.round(total, 6).alias("total"), at(1).alias("first"), at(-1).alias("last"))


@query("""WITH c AS (SELECT p_partkey, list_transform([1, 2, 3, 4, 5, 6], lambda d: list_sum(list_transform(string_split(lower(p_name), ''), lambda c: sin(ascii(c) * d * 31 / 1000.0::double)))) AS v FROM part)
SELECT p_partkey, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[6] / sqrt(list_dot_product(v, v)), 6) AS last FROM c""")
def pseudo_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").select("p_partkey", expr.pseudo_embedding(F.col("p_name"), 6).alias("v"))
    return v.select("p_partkey", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 6), 6).alias("last"))


@query("""WITH old AS (SELECT vec_id AS hash, vec_id // 2 AS slot FROM embeddings WHERE vec_id % 2 = 0 AND label <> 3), n AS (SELECT vec_id AS hash, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings WHERE vec_id % 2 = 1 OR label = 3), f AS (SELECT [9, 7, 5] AS free, (SELECT max(vec_id) FROM embeddings) AS top)
SELECT slot, hash FROM old UNION ALL SELECT CASE WHEN n < 3 THEN free[n + 1] ELSE n - 3 + top END, hash FROM n, f""")
def slot_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    index = v.where("vec_id % 2 = 0 and label <> 3").select(F.expr("vec_id div 2").alias("slot"), F.col("vec_id").alias("hash"))
    return vector.allocate_slots(index, [5, 7, 9], v.agg(F.max("vec_id")).first()[0], v.select(F.col("vec_id").alias("hash")))[0]


# Readers ---------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN NOT bad THEN concat('T', doc_id) END AS title, CASE WHEN NOT bad AND doc_id % 10 <> 0 THEN doc_id * 1000 END AS photo_taken_ms, NOT bad AND doc_id % 3 = 0 AS archived, NOT bad AND doc_id % 4 = 0 AS trashed,
concat_ws(',', CASE WHEN bad THEN 'not JSON' END, CASE WHEN bad OR doc_id % 10 = 0 THEN 'no photoTakenTime' END) AS problems FROM (SELECT doc_id, doc_id % 17 = 0 AS bad FROM documents)""")
def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    good = F.to_json(F.struct(F.concat(F.lit("T"), i.cast("string")).alias("title"), F.struct(F.when(i % 10 == 0, "0").otherwise(i.cast("string")).alias("timestamp")).alias("photoTakenTime"), F.when(i % 3 == 0, True).alias("archived"), (i % 4 == 0).alias("trashed")))
    rows = table(spark, sf_dir, "documents").select("doc_id", files.sidecar_fields(F.when(i % 17 == 0, "{no json").otherwise(good)).alias("s"))
    return rows.select("doc_id", "s.title", "s.photo_taken_ms", "s.archived", "s.trashed", F.array_join("s.problems", ",").alias("problems"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN concat('Album ', doc_id) END AS title, CASE WHEN doc_id > 0 THEN doc_id * 1000 END AS album_date_ms FROM documents")
def album_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.to_json(F.struct(F.when(i % 4 == 0, "  ").otherwise(F.concat(F.lit(" Album "), i.cast("string"), F.lit(" "))).alias("title"), F.struct(i.cast("string").alias("timestamp")).alias("date")))
    return table(spark, sf_dir, "documents").select("doc_id", files.album_metadata(text).alias("m")).select("doc_id", "m.*")


_ENTRY = "e AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'xyz' ELSE sha256(text) END AS hash, CASE WHEN doc_id % 13 = 0 THEN '' ELSE concat('f', doc_id, '.jpg') END AS file, CASE WHEN doc_id % 5 = 0 THEN 'audio' WHEN doc_id % 3 = 0 THEN 'motion' ELSE 'image' END AS kind, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE n_chars END AS bytes, CASE WHEN doc_id % 17 = 0 THEN 'then' ELSE concat('2020-0', 1 + doc_id % 9, '-01T00:00:00.000Z') END AS taken FROM documents)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda n, bad, good: F.when(i % n == 0, bad).otherwise(good)
    kind = F.when(i % 5 == 0, "audio").when(i % 3 == 0, "motion").otherwise("image")
    at = F.concat(F.lit("2020-0"), (1 + i % 9).cast("string"), F.lit("-01T00:00:00.000Z"))
    return table(spark, sf_dir, "documents").select("doc_id", pick(11, "xyz", F.sha2("text", 256)).alias("hash"), pick(13, "", F.concat(F.lit("f"), i.cast("string"), F.lit(".jpg"))).alias("file"), kind.alias("kind"), pick(7, -1, F.col("n_chars")).alias("bytes"), pick(17, "then", at).alias("capturedAt"))


@query(f"""WITH {_ENTRY} SELECT doc_id, concat('{{"hash":"', hash, '","file":"', file, '","kind":"', kind, '","bytes":', bytes, ',"capturedAt":"', taken, '"}}') AS line,
concat_ws(',', CASE WHEN hash = 'xyz' THEN 'hash' END, CASE WHEN file = '' THEN 'file' END, CASE WHEN kind = 'audio' THEN 'kind' END, CASE WHEN bytes < 0 THEN 'bytes' END, CASE WHEN taken = 'then' THEN 'capturedAt' END) AS problems FROM e""")
def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as they are written, and what their reader finds wrong with each field."""
    lines = _entries(spark, sf_dir).select("doc_id", manifest.format_line(F.struct("hash", "file", "kind", "bytes", "capturedAt")).alias("value"))
    checked = manifest.parse_lines(lines.withColumn("value", F.concat(F.expr("substring(value, 1, length(value) - 1)"), F.lit(',"camera":"'), F.col("doc_id").cast("string"), F.lit('"}'))))
    problems = checked.select(F.col("camera").cast("long").alias("doc_id"), F.array_join("problems", ",").alias("problems"))
    return lines.withColumnRenamed("value", "line").join(problems, "doc_id")


@query(f"WITH {_ENTRY} SELECT hash, taken FROM e WHERE kind <> 'motion' AND hash <> 'xyz' ORDER BY taken DESC, hash LIMIT 200")
def manifest_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.manifest_timeline(_entries(spark, sf_dir).where("hash <> 'xyz'")).limit(200).select("hash", F.col("capturedAt").alias("taken"))


@query(f"WITH {_ENTRY} SELECT taken[1:7] AS month, count(*) AS entries, count(*) FILTER (kind <> 'motion') AS timeline_entries FROM e WHERE taken <> 'then' GROUP BY 1")
def manifest_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.manifest_months(_entries(spark, sf_dir).where("capturedAt <> 'then'"), "capturedAt")


@query(r"""WITH t AS (SELECT doc_id, lower(strip_accents(concat(text, ' 漢字x語 ', doc_id))) AS t FROM documents), l AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(t, '([一-鿿])', ' \1 ', 'g'), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS l FROM t)
SELECT doc_id, len(l) AS tokens, len(list_distinct(l)) AS distinct_tokens FROM l""")
def cjk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = token_totals(F.concat(F.coalesce("text", F.lit("")), F.lit(" 漢字x語 "), F.col("doc_id").cast("string")), cjk_split=True)
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", "t.*")


# Export folders --------------------------------------------------------------------------------------

_FILES = f"fl AS (SELECT dir, name, concat('part-', part) AS part, 'media' AS kind FROM {fx.MEDIA_SQL} UNION ALL SELECT dir, name, 'part-1', 'sidecar' FROM {fx.SIDECAR_SQL} UNION ALL SELECT dir, 'metadata.json', 'part-3', 'album-metadata' FROM {fx.METADATA_SQL})"


@query(f"""WITH {_FILES} SELECT dir, coalesce(string_agg(DISTINCT name, '|' ORDER BY name) FILTER (kind = 'media'), '') AS media, coalesce(string_agg(DISTINCT name, '|' ORDER BY name) FILTER (kind = 'sidecar'), '') AS sidecars, string_agg(DISTINCT part, '|' ORDER BY part) AS parts, bool_or(kind = 'album-metadata') AS has_metadata FROM fl GROUP BY dir""")
def folder_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.media(spark, sf_dir).select("dir", "name", F.concat(F.lit("part-"), F.col("part").cast("string")).alias("part"))
    rows = rows.unionByName(fx.sidecars(spark, sf_dir).select("dir", "name", F.lit("part-1").alias("part"))).unionByName(fx.metadata_folders(spark, sf_dir).select("dir", F.lit("metadata.json").alias("name"), F.lit("part-3").alias("part")))
    return resolve.folders(rows.withColumn("kind", expr.classify_file(F.col("name")))).select("dir", *(F.array_join(c, "|").alias(c) for c in ("media", "sidecars", "parts")), "has_metadata")


def _media_sidecars_sql() -> str:
    from .catalogue import _PAIR

    return f"WITH {_PAIR} SELECT dir, name, sidecar, length(sidecar) * 1000 AS photo_taken_ms, coalesce(length(sidecar) % 2 = 0, FALSE) AS archived, FALSE AS trashed FROM pairing"


def media_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media with the times and flags of the sidecar they are paired with."""
    media, sidecars = fx.media(spark, sf_dir).select("dir", "name").distinct(), fx.sidecars(spark, sf_dir).select("dir", "name").distinct()
    n = F.length("name")
    text = F.to_json(F.struct(F.struct(n.cast("string").alias("timestamp")).alias("photoTakenTime"), (n % 2 == 0).alias("archived")))
    out = files.media_sidecars(media, resolve.pair_sidecars(media, sidecars), sidecars.withColumn("text", text))
    return out.select("dir", "name", "sidecar", "photo_taken_ms", "archived", "trashed")


_DATE = "TIMESTAMP '2019-01-01 03:04:05' + to_days((doc_id % 3000)::INT) + to_seconds(doc_id % 86400)"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN epoch_ms({_DATE}) - CASE WHEN doc_id % 2 = 0 THEN 330 ELSE -90 END * 60000 END AS captured_ms, CASE WHEN doc_id % 4 <> 3 THEN (CASE WHEN doc_id % 2 = 0 THEN 330 ELSE -90 END)::INT END AS offset_minutes FROM documents""")
def exif_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture times from files made of the documents: TIFFs, JPEGs, JPEGs with fill bytes, lone markers and long comments before their EXIF (some longer than the head
    that is read first), and JPEGs without EXIF."""
    at = F.expr("timestampadd(SECOND, doc_id % 86400, timestampadd(DAY, doc_id % 3000, TIMESTAMP_NTZ '2019-01-01 03:04:05'))")
    zone = F.when(F.col("doc_id") % 2 == 0, "+05:30").otherwise("-01:30")
    entry = lambda tag, kind, size, value: "".join(n.to_bytes(w, "little").hex() for n, w in ((tag, 2), (kind, 2), (size, 4), (value, 4)))
    head = "49492a0008000000" + "0100" + entry(0x8769, 4, 1, 26) + "00000000" + "0200" + entry(0x9003, 2, 20, 56) + entry(0x9011, 2, 7, 76) + "00000000"
    raw = lambda text: F.unhex(F.lit(text))
    tiff = F.concat(raw(head), F.date_format(at, "yyyy:MM:dd HH:mm:ss").cast("binary"), raw("00"), zone.cast("binary"), raw("00"))
    segment = F.concat(raw("ffe1"), F.unhex(F.lpad(F.hex(F.length(tiff) + 8), 4, "0")), raw("457869660000"), tiff)
    comment = F.concat(raw("fffffffeea60"), F.repeat(F.lit("x"), 59_998).cast("binary"))
    long = F.when(F.col("doc_id") % 8 == 2, F.concat(comment, comment, comment)).otherwise(comment)
    kind = F.col("doc_id") % 4
    content = F.when(kind == 0, tiff).when(kind == 1, F.concat(raw("ffd8"), segment, raw("ffd9"))).when(kind == 2, F.concat(raw("ffd8ff01"), long, raw("ffff"), segment, raw("ffd9"))).otherwise(raw("ffd8ffda0002ffd9"))
    made = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return files.exif(made).select("doc_id", "captured_ms", "offset_minutes")


# Ingest and jobs -------------------------------------------------------------------------------------

_LOCAL = "l AS (SELECT c_custkey::varchar AS local_id, CASE WHEN c_custkey % 3 = 1 THEN sha256(c_name) END AS hash, (c_custkey % 3)::int AS hash_state FROM customer)"


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("local_id"), F.when(k % 3 == 1, F.sha2("c_name", 256)).alias("hash"), (k % 3).cast("int").alias("hash_state"))


@query(f"WITH {_LOCAL} SELECT local_id, hash_state FROM l WHERE hash_state = 0")
def unhashed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.unhashed(_local(spark, sf_dir)).select("local_id", "hash_state")


@query(f"WITH {_LOCAL} SELECT local_id FROM l JOIN customer ON hash = sha256(c_name) WHERE c_nationkey % 4 = 2")
def backed_up_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "customer").select(F.sha2("c_name", 256).alias("hash"), (F.col("c_nationkey") % 4).alias("remote_state"))
    return ingest.backed_up(_local(spark, sf_dir), assets).select("local_id")


@query(f"WITH {_LOCAL} SELECT local_id, CASE WHEN local_id::bigint % 2 = 0 THEN sha256(concat('original ', local_id::bigint // 10)) ELSE hash END AS hash, CASE WHEN local_id::bigint % 2 = 0 THEN 1 ELSE hash_state END AS hash_state FROM l")
def originals_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = _local(spark, sf_dir)
    fetched = local.where("cast(local_id AS bigint) % 2 = 0").select("local_id", F.expr("cast(concat('original ', cast(local_id AS bigint) div 10) AS binary)").alias("content"))
    none = spark.createDataFrame([], "hash string, byte_size long, updated_at long")
    return ingest.materialise_originals(fetched, none, local, 5)[1].select("local_id", "hash", "hash_state")


@query(f"WITH {_LOCAL} SELECT sha256(concat('original ', local_id::bigint // 10)) AS hash, max(length(concat('original ', local_id::bigint // 10))) AS byte_size, 5::bigint AS updated_at FROM l WHERE local_id::bigint % 2 = 0 GROUP BY 1")
def originals_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset for each content, however many sources bring it."""
    local = _local(spark, sf_dir)
    fetched = local.where("cast(local_id AS bigint) % 2 = 0").select("local_id", F.expr("cast(concat('original ', cast(local_id AS bigint) div 10) AS binary)").alias("content"))
    none = spark.createDataFrame([], "hash string, byte_size long, updated_at long")
    return ingest.materialise_originals(fetched, none, local, 5)[0]


@query("""WITH o AS (SELECT o_orderkey AS hash, (o_orderkey % 4)::int AS remote_state, round(o_totalprice * 100)::bigint AS n FROM orders), p AS (SELECT *, greatest(5242880, ceil(ceil(n / 10000) / 1048576) * 1048576)::bigint AS s FROM o)
SELECT hash, CASE WHEN n > 8388608 THEN ceil(n / s)::bigint ELSE 1 END AS parts FROM p WHERE remote_state IN (0, 3)""")
def upload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), (F.col("o_orderkey") % 4).cast("int").alias("remote_state"), F.round(F.col("o_totalprice") * 100).cast("long").alias("byte_size"))
    return ingest.upload_plan(o).select("hash", "parts")


@query("""WITH s AS (SELECT doc_id AS ref, sha256(text) AS hash, n_chars AS size FROM documents), a AS (SELECT DISTINCT sha256(text) AS hash, n_chars + CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END AS known FROM documents WHERE n_chars % 2 = 0 OR n_chars % 5 = 0),
b AS (SELECT doc_id AS ref, CASE WHEN doc_id % 6 = 0 THEN sha256('other') ELSE sha256(text) END AS bound FROM documents WHERE doc_id % 3 = 0)
SELECT s.ref, s.hash, CASE WHEN bound <> s.hash THEN 'diverged' WHEN known <> size THEN 'size-conflict' WHEN bound = s.hash THEN 'repeat' WHEN known IS NOT NULL THEN 'duplicate' ELSE 'first' END AS decision FROM s LEFT JOIN a USING (hash) LEFT JOIN b USING (ref)""")
def dedupe_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.sha2("text", 256).alias("hash"), F.col("n_chars").alias("size"))
    assets = d.where("size % 2 = 0 or size % 5 = 0").select("hash", F.expr("size + CASE WHEN size % 5 = 0 THEN 1 ELSE 0 END").alias("size")).distinct()
    bound = d.where("ref % 3 = 0").select("ref", F.when(F.col("ref") % 6 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("hash")).alias("hash"))
    return catalog.dedupe_decision(d, assets, bound)


@query("WITH m AS (SELECT vec_id // 2 AS hash, label % 2 AS model FROM embeddings), s AS (SELECT hash FROM m WHERE model <> 1 EXCEPT SELECT hash FROM m WHERE model = 1) SELECT hash::varchar AS hash, 4 AS kind, 10 AS priority, 0 AS state, 0 AS attempts, 77::bigint AS next_attempt_at FROM s")
def migration_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").cast("string").alias("hash"), (F.col("label") % 2).alias("model_id"))
    jobs = spark.createDataFrame([], "id long, kind int, hash string, priority int, state int, attempts int, next_attempt_at long, created_at long")
    return ingest.migration_jobs(jobs, m, 1, 77, 1).select("hash", "kind", "priority", "state", "attempts", "next_attempt_at")


# Sync ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS hash, epoch_ms(o_orderdate) AS updated_at FROM orders WHERE o_orderkey % 3 = 0 ORDER BY 2, 1 LIMIT 25")
def pending_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_at"), (F.col("o_orderkey") % 3).alias("version"))
    return sync.pending_push(o).select("hash", "updated_at")


@query("SELECT o_orderkey, 100 + (row_number() OVER (ORDER BY lpad(o_orderkey::varchar, 12, '0')) - 1) // 25 AS version FROM orders WHERE o_orderstatus = 'P'")
def push_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.lit("U#me").alias("pk"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("sk"))
    return sync.push_batches(o, "me", 100).select("o_orderkey", "version")


@query("SELECT 'asset' AS type, o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'album', o_orderkey FROM orders WHERE o_orderkey % 3 = 1")
def record_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    log = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 != 1, k.cast("string")).alias("hash"), F.when(k % 3 == 0, 0).alias("kind"), F.lit(5).alias("byteSize"), F.when(k % 3 == 1, k.cast("string")).alias("id"), F.when(k % 3 != 2, "t").otherwise(none).alias("title"))
    assets, albums = sync.route_records(log)
    return assets.select(F.lit("asset").alias("type"), F.col("o_orderkey").alias("id")).unionByName(albums.select(F.lit("album").alias("type"), F.col("o_orderkey").alias("id")))


@query("SELECT o_orderkey::varchar AS hash, round(o_totalprice)::bigint AS byteSize, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN TRUE WHEN o_orderkey % 3 = 1 THEN FALSE END, FALSE) AS favorite, epoch_ms(o_orderdate) AS capturedAt, (o_orderkey % 2)::int AS capturedAtSource, NULL::varchar AS cameraMake FROM orders")
def asset_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("hash"), F.round("o_totalprice").cast("long").alias("byte_size"), F.when(k % 3 == 0, 1).when(k % 3 == 1, 0).alias("favorite"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("captured_at"), (k % 2).alias("captured_at_src"))
    return sync.asset_records(rows).select("hash", "byteSize", "favorite", "capturedAt", "capturedAtSource", "cameraMake")


# Lists, pages and sets -------------------------------------------------------------------------------


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS items, array_to_string(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey)[1:3], ',') AS keys FROM orders GROUP BY 1")
def day_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.day_sections(table(spark, sf_dir, "orders"), F.col("o_orderdate"), "o_orderkey", 3)
    return out.withColumn("keys", F.array_join(F.transform("keys", lambda k: k.cast("string")), ","))


@query("SELECT o_orderkey, (o_orderkey % 3)::int AS kind FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 150")
def timeline_without_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("kind", (F.col("o_orderkey") % 3).cast("int"))
    return relational.timeline(o, "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "P").select("o_orderkey", "kind")


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(expr.hard_filter(F.col("lang") == "en")).select("doc_id")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def audit_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.newest(table(spark, sf_dir, "events"), "event_id").select("event_id", "event_type")


@query("SELECT coalesce(sum(n_chars), 0)::bigint AS total FROM documents")
def cache_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.cache_total(table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT c_custkey AS hash, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def album_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hash"), "c_name")
    members = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("album_id"), F.col("o_custkey").alias("hash"))
    return relational.album_assets(assets, members, "1-URGENT")


@query("SELECT c_custkey AS hash FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey = 7)")
def assets_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hash"))
    return relational.of_local_source(assets, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("local_id"), F.col("o_custkey").alias("hash")), 7)


@query("SELECT p_partkey, p_size % 5 AS score FROM part ORDER BY p_size % 5 DESC, p_retailprice DESC, p_partkey LIMIT 100")
def best_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.by_score(table(spark, sf_dir, "part").withColumn("score", F.col("p_size") % 5), "score", "p_retailprice", "p_partkey", 100).select("p_partkey", "score")


@query("SELECT event_id, concat(event_type, '-', user_id % 40) AS name FROM events ORDER BY user_id % 40, concat(event_type, '-', user_id % 40), event_id LIMIT 300")
def natural_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("-"), (F.col("user_id") % 40).cast("string")).alias("name"))
    return relational.natural_order(e, "name", "event_id").limit(300)


@query("SELECT p_brand AS name, p_size::varchar AS version, array_to_string(list_sort(list(DISTINCT x)), ',') AS \"requiredBy\", arg_min(text, p_partkey) FILTER (text IS NOT NULL) AS \"licenseText\" FROM (SELECT *, unnest([p_type[1:3], concat('app', p_partkey % 4)]) AS x, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS text FROM part) GROUP BY 1, 2")
def merged_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("version"), F.array(F.substring("p_type", 1, 3), F.concat(F.lit("app"), (k % 4).cast("string"))).alias("requiredBy"), F.when(k % 3 == 0, F.col("p_name")).alias("licenseText"), k.alias("seq"))
    return catalog.merge_packages(p).withColumn("requiredBy", F.array_join("requiredBy", ","))


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN NOT fav ELSE fav END AS favorite, array_to_string(CASE WHEN o_orderkey <> 7 THEN ids WHEN fav THEN list_filter(ids, lambda x: x <> 'favorites') ELSE list_append(ids, 'favorites') END, ',') AS album_ids FROM (SELECT o_orderkey, o_orderkey % 2 = 1 AS fav, CASE WHEN o_orderkey % 2 = 1 THEN [o_orderpriority, 'favorites'] ELSE [o_orderpriority] END AS ids FROM orders)")
def toggled_favorite(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("o_orderkey") % 2 == 1
    o = table(spark, sf_dir, "orders").select("o_orderkey", odd.alias("favorite"), F.when(odd, F.array("o_orderpriority", F.lit("favorites"))).otherwise(F.array("o_orderpriority")).alias("album_ids"))
    return lifecycle.toggle_favorite(o, "o_orderkey", 7).withColumn("album_ids", F.array_join("album_ids", ","))


@query("SELECT sha256(concat('asset-', i)) AS hash, CASE WHEN i % 15 = 0 THEN 1 ELSE 0 END AS kind, CASE WHEN i % 15 = 0 THEN 15000000 + i % 10 * 1000000 ELSE 2500000 + i % 20 * 100000 END AS byte_size, CASE WHEN i % 2 = 0 THEN 'Apple' ELSE 'Sony' END AS camera_make FROM (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS i) r")
def synthetic_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library as large as the table of orders."""
    return files.synthetic_library(spark, table(spark, sf_dir, "orders").count()).select("hash", "kind", "byte_size", "camera_make")


@query("WITH q AS (SELECT vec_id % 7 AS query, vec_id AS item, row_number() OVER (PARTITION BY vec_id % 7 ORDER BY label DESC, vec_id) AS rank FROM embeddings) SELECT query, count(*) FILTER (rank <= 20 AND item % 3 = 0) / count(*) FILTER (item % 3 = 0) AS recall, count(*) FILTER (rank = 1 AND item % 3 = 0) AS top1, count(*) FILTER (rank <= 20 AND item % 3 = 1) AS forbidden FROM q GROUP BY 1")
def graded_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, top-1 and forbidden hits against graded items."""
    from pyspark.sql import Window

    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("query"), F.col("vec_id").alias("item"), "label")
    ranked = v.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("label"), "item"))).where("rank <= 20")
    grades = v.where("item % 3 <> 2").select("query", "item", F.when(F.col("item") % 3 == 0, 1).otherwise(-1).alias("grade"))
    return fusion.retrieval_quality(ranked, grades, "query", "item")
