"""Every query of the engine with the SQL that an independent engine answers alike.

Each operator is bound to the nearest table at hand: orders are assets, customers albums, documents texts and
contents, events logs, page urls paths, conversations the parts of an object.
"""

from __future__ import annotations

import zlib
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.udf import projection_matrix, token_totals
from ..operators import catalog, fusion, ingest, jobs, lifecycle, relational, resolve, sync, text, vector
from ..session import scratch_folder, table
from . import archives, details, registry  # noqa: F401
from . import queues
from . import fixtures as fx
from .registry import Query, query

FLAGSHIP = "hybrid_search"
_INDEXED: set[str] = set()


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


# Timeline, albums, filters ---------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 150")
def timeline_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = relational.timeline(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "P")
    return page.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 150 OFFSET 300")
def timeline_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.timeline(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "P", 150, 300).select("o_orderkey")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS items, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def timeline_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.by_day(table(spark, sf_dir, "orders"), F.col("o_orderdate"), "o_orderkey")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS entries, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def manifest_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.by_month(table(spark, sf_dir, "orders"), F.col("o_orderdate"), "o_totalprice")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS members FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def album_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.member_counts(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderkey", "c_name")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT p_partkey FROM part WHERE p_brand ILIKE '%brand#1%' AND p_retailprice >= 1000 AND p_retailprice <= 1500 AND p_size IN (SELECT DISTINCT p_size FROM part WHERE p_size % 3 = 0)""")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ranked = part.select("p_partkey", "p_size", F.col("p_partkey").alias("rank"))
    kept = relational.candidate_filter(ranked, part, "p_partkey", F.col("p_brand").ilike("%brand#1%"), F.col("p_retailprice") >= 1000, F.col("p_retailprice") <= 1500)
    return kept.join(part.where("p_size % 3 = 0").select("p_size").distinct(), "p_size", "left_semi").select("p_partkey")


@query("""WITH t AS (SELECT p_partkey, lower(p_name) AS name, p_size % 2 = 0 AS video, p_partkey % 3 = 0 AS backed FROM part)
SELECT p_partkey FROM t WHERE NOT video AND backed AND (contains(name, 'part') OR contains('backed up cloud s3 synced archive', 'part'))""")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    holds = expr.keyword_filter(["photo", "cloud", "part"], F.col("p_name"), F.col("p_size") % 2 == 0, F.lit(None).cast("timestamp"), F.col("p_partkey") % 3 == 0)
    return part.where(holds).select("p_partkey")


@query("""SELECT p_partkey, 50 * (contains(lower(p_type), 'steel')::int + contains(lower(p_type), 'brass')::int) AS text_score,
25 * ((contains(lower(p_brand), 'steel') OR contains('steel', lower(p_brand)))::int + (contains(lower(p_brand), 'brass') OR contains('brass', lower(p_brand)))::int) + 30 * contains(lower(p_name), 'steel brass')::int AS metadata_score FROM part""")
def search_text_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = expr.text_score(["steel", "brass"], "steel brass", F.col("p_type"), F.array("p_brand"), F.col("p_name"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", s["text_score"].alias("text_score"), s["metadata_score"].alias("metadata_score"))


@query("""WITH e AS (SELECT event_id, event_type, value, user_id FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'thermal_throttle' WHEN value < 0.2 AND user_id % 2 <> 0 THEN 'battery_low' WHEN user_id % 3 = 0 AND user_id % 5 <> 0 THEN 'metered_network' END AS reason FROM e""")
def backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    thermal = F.when(F.col("event_type") == "error", "serious").otherwise("nominal")
    return table(spark, sf_dir, "events").select("event_id", expr.backpressure(thermal, F.col("value"), u % 2 == 0, u % 3 == 0, u % 5 == 0).alias("reason"))


# Vectors ---------------------------------------------------------------------------------------------

_Q7 = "q AS (SELECT list_transform(embedding, lambda x: x::double) AS q FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings)"


def _query_vector(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vector.vector_of(vectors, "vec_id", 7, "embedding")


@query(f"WITH {_Q7} SELECT vec_id, round(list_cosine_similarity(e, q), 9) AS cosine FROM v, q ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 20")
def vector_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q = _query_vector(spark, sf_dir)
    return vector.exact_topk(vectors, "vec_id", "embedding", q, 20).withColumn("cosine", F.round("cosine", 9))


_COARSE = "u AS (SELECT vec_id, label, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS n FROM v), c AS (SELECT vec_id, label, e, list_transform(n, lambda x: greatest(-128, least(127, trunc(x * 128)::int))) AS c FROM u)"


@query(f"WITH {_Q7}, {_COARSE} SELECT vec_id, array_to_string(c, ',') AS coarse FROM c")
def vector_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", F.array_join(F.transform("coarse", lambda x: x.cast("string")), ",").alias("coarse"))


_DOTS = "d AS (SELECT c.vec_id, c.label, c.e, list_sum(list_transform(list_zip(c.c, k.c), lambda p: p[1] * p[2]))::int AS score FROM c, c k WHERE k.vec_id = 7)"


@query(f"WITH {_Q7}, {_COARSE}, {_DOTS} SELECT vec_id, score FROM d ORDER BY score DESC, vec_id LIMIT 50")
def vector_coarse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q = _query_vector(spark, sf_dir)
    return vector.coarse_topk(vector.quantized(vectors, "vec_id", "embedding"), "vec_id", vector.quantize_query(q), 50)


@query(f"WITH {_Q7}, {_COARSE}, {_DOTS}, best AS (SELECT * FROM d ORDER BY score DESC, vec_id LIMIT 50) SELECT vec_id, round(list_cosine_similarity(e, q), 9) AS cosine FROM best, q ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 10")
def vector_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q = _query_vector(spark, sf_dir)
    return vector.two_stage(vectors, "vec_id", "embedding", q, 50, 10).withColumn("cosine", F.round("cosine", 9))


_PROJECTED = f"""m AS (SELECT list_transform(range(0, 32), lambda c: list_transform(range(0, 64), lambda r: (cos(radians((r * 31 + c * 17) % 360)) / 8)::float::double)) AS m),
pr AS (SELECT vec_id, e, list_transform(m, lambda w: list_dot_product(e, w)) AS p FROM v, m), c AS (SELECT vec_id, e, list_transform(p, lambda x: greatest(-128, least(127, trunc(x / sqrt(list_dot_product(p, p)) * 128)::int))) AS c FROM pr),
d AS (SELECT c.vec_id, c.e, list_sum(list_transform(list_zip(c.c, k.c), lambda p: p[1] * p[2]))::int AS score FROM c, c k WHERE k.vec_id = 7)"""


@query(f"WITH {_Q7}, {_PROJECTED}, best AS (SELECT * FROM d ORDER BY score DESC, vec_id LIMIT 500) SELECT vec_id, round(list_cosine_similarity(e, q), 9) AS cosine FROM best, q ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 100")
def vector_projected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection, quantisation, 500 candidates, 100 results."""
    vectors, q = _query_vector(spark, sf_dir)
    return vector.two_stage(vectors, "vec_id", "embedding", q, 500, 100, matrix=projection_matrix(64, 32)).withColumn("cosine", F.round("cosine", 9))


@query(f"WITH {_Q7}, best AS (SELECT vec_id, label, row_number() OVER (ORDER BY round(list_cosine_similarity(e, q), 9) DESC, vec_id) AS rank FROM v, q QUALIFY rank <= 200) SELECT vec_id, rank FROM best WHERE label % 2 = 0")
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 nearest that a predicate allows, with their ranks."""
    vectors, q = _query_vector(spark, sf_dir)
    near = vector.exact_topk(vectors, "vec_id", "embedding", q, 200).withColumn("cosine", F.round("cosine", 9))
    return relational.candidate_filter(fusion.rank_list(near, F.desc("cosine"), "vec_id"), vectors, "vec_id", F.col("label") % 2 == 0).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_Q7}, {_COARSE}, {_DOTS}, best AS (SELECT * FROM d WHERE label % 2 = 1 ORDER BY score DESC, vec_id LIMIT 50) SELECT vec_id, round(list_cosine_similarity(e, q), 9) AS cosine FROM best, q ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 10")
def vector_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q = _query_vector(spark, sf_dir)
    return vector.two_stage(vectors, "vec_id", "embedding", q, 50, 10, predicate=F.col("label") % 2 == 1).withColumn("cosine", F.round("cosine", 9))


@query(f"""WITH {_Q7}, m AS (SELECT list_transform(range(0, 32), lambda c: list_transform(range(0, 64), lambda r: (cos(radians((r * 31 + c * 17) % 360)) / 8)::float::double)) AS m),
p AS (SELECT vec_id, list_transform(m, lambda w: list_dot_product(e, w)) AS p FROM v, m)
SELECT vec_id, round(p[1] / sqrt(list_dot_product(p, p)), 6) AS first, round(p[32] / sqrt(list_dot_product(p, p)), 6) AS last FROM p""")
def vector_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.udf import project

    rows = table(spark, sf_dir, "embeddings").select("vec_id", project(F.col("embedding"), projection_matrix(64, 32)).alias("p"))
    return rows.select("vec_id", F.round(F.element_at("p", 1), 6).alias("first"), F.round(F.element_at("p", 32), 6).alias("last"))


@query(f"""WITH {_Q7}, few AS (SELECT * FROM v WHERE vec_id % 50 = 0), s AS (SELECT a.vec_id AS query, b.vec_id AS item, list_cosine_similarity(a.e, b.e) AS c FROM few a, v b),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, item) AS r FROM s)
SELECT round(avg(c) FILTER (query = item), 9) AS matched, round(avg(c) FILTER (query <> item), 9) AS mismatched, round(avg(c) FILTER (query = item) - avg(c) FILTER (query <> item), 9) AS separation,
count(*) FILTER (query = item AND r = 1) / count(DISTINCT query) AS top1, 1 / count(DISTINCT query) AS chance FROM r""")
def cross_modal_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    out = vector.probe_blocks(v.where("vec_id % 50 = 0"), v, "vec_id", "vec_id", "embedding")
    return out.select(*(F.round(c, 9).alias(c) for c in ("matched", "mismatched", "separation")), "top1", "chance")


@query(f"""WITH {_Q7}, s AS (SELECT a.vec_id AS query, a.label AS want, b.vec_id AS item, b.label AS got, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, item) AS r FROM s)
SELECT query, count(*) FILTER (r <= 10 AND want = got) / count(*) FILTER (want = got) AS recall, count(*) FILTER (r = 1 AND want = got) AS top1, count(*) FILTER (r <= 10 AND got = (want + 1) % 10) AS forbidden FROM r GROUP BY query HAVING count(*) FILTER (want = got) > 0""")
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0")
    top = vector.batch_topk(asked, v, "vec_id", "vec_id", "embedding", 11, digits=9).where("query <> item")
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where("rank <= 10")
    want, labels = asked.select(F.col("vec_id").alias("query"), "label"), v.select(F.col("vec_id").alias("item"), "label")
    return fusion.retrieval_by_label(ranked, want, labels, "query", "item", lambda label: (label + 1) % 10)


# Text ------------------------------------------------------------------------------------------------

_TOK = r"tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS token FROM documents), post AS (SELECT token, doc_id, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT doc_id, count(*) AS token_count FROM tok GROUP BY 1)"


def _bm25_sql(conditions: list[str], limit: int = 100) -> str:
    cases = " UNION ALL ".join(f"SELECT doc_id, {i} AS atom, sum(tf) AS tf FROM post WHERE {c} GROUP BY 1" for i, c in enumerate(conditions))
    return f"""{_TOK}, hits AS ({cases}), corpus AS (SELECT count(*) AS n, avg(token_count) AS av FROM len), df AS (SELECT atom, count(*) AS df FROM hits GROUP BY 1),
w AS (SELECT atom, av, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, corpus),
bm AS (SELECT doc_id, -sum(idf * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * token_count / av))) AS score FROM hits JOIN w USING (atom) JOIN len USING (doc_id) GROUP BY doc_id HAVING count(*) = {len(conditions)} ORDER BY 2, 1 LIMIT {limit})"""


@query(f"WITH {_TOK} SELECT doc_id, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens FROM tok GROUP BY 1")
def fts_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_totals("text").alias("t")).select("doc_id", "t.*").where("tokens > 0")


@query(f"WITH {_TOK} SELECT token, count(*) AS df FROM post GROUP BY 1")
def fts_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.document_frequency(text.postings(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query(f"WITH {_bm25_sql([repr('license') + ' = token', repr('the') + ' = token'])} SELECT doc_id, round(score, 9) AS score FROM bm")
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search(table(spark, sf_dir, "documents"), "doc_id", "text", "License THE").withColumn("score", F.round("score", 9))


@query(f"WITH {_bm25_sql(['starts_with(token, ' + repr('licen') + ')', 'token = ' + repr('the')])} SELECT doc_id, round(score, 9) AS score FROM bm")
def fts_bm25_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search(table(spark, sf_dir, "documents"), "doc_id", "text", "licen* the", prefixes=True).withColumn("score", F.round("score", 9))


@query("SELECT doc_id, concat('…', trim(substr(text, greatest(1, strpos(lower(text), 'license') - 20), strpos(lower(text), 'license') + 27 - greatest(1, strpos(lower(text), 'license') - 20))), '…') AS snippet FROM documents WHERE contains(lower(text), 'license')")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", expr.snippet(F.col("text"), "license").alias("snippet")).where("snippet is not null")


# Fusion ----------------------------------------------------------------------------------------------

_LISTS = f"{_Q7}, {_COARSE}, {_DOTS}, l0 AS (SELECT vec_id, row_number() OVER (ORDER BY round(list_cosine_similarity(e, q), 9) DESC, vec_id) AS rank FROM v, q QUALIFY rank <= 30), l1 AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) AS rank FROM v QUALIFY rank <= 40)"


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors, q = _query_vector(spark, sf_dir)
    near = vector.exact_topk(vectors, "vec_id", "embedding", q, 30).withColumn("cosine", F.round("cosine", 9))
    top = vectors.orderBy(F.desc("label"), "vec_id").limit(40)
    return fusion.rank_list(near, F.desc("cosine"), "vec_id"), fusion.rank_list(top, F.desc("label"), "vec_id")


@query(f"WITH {_LISTS} SELECT vec_id, round(coalesce(1.0::double / (60 + l0.rank), 0) + coalesce(1.0::double / (60 + l1.rank), 0), 12) AS score, l0.rank AS rank_0, l1.rank AS rank_1 FROM l0 FULL JOIN l1 USING (vec_id)")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(_two_lists(spark, sf_dir), "vec_id").withColumn("score", F.round("score", 12)).withColumns({c: F.col(c).cast("long") for c in ("rank_0", "rank_1")})


@query(f"WITH {_LISTS}, t AS (SELECT vec_id, rank, CASE WHEN vec_id % 2 = 0 THEN 50 ELSE 0 END AS ts FROM l1) SELECT vec_id, round((coalesce(1.2::double / (60 + l0.rank), 0) + coalesce(1.5::double / (60 + CASE WHEN l0.rank IS NULL AND ts <= 0 THEN 200 ELSE t.rank END), 0)) * 100, 3) AS score FROM l0 FULL JOIN t USING (vec_id)")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, top = _two_lists(spark, sf_dir)
    return fusion.weighted_rrf(near, top.withColumn("text_score", F.when(F.col("vec_id") % 2 == 0, 50).otherwise(0)), "vec_id")


def _hybrid_sql(before: bool) -> str:
    """Both branches and their fusion; the language filters items before the cuts or what is fused."""
    en = "SELECT doc_id FROM documents WHERE lang = 'en'"
    cut, kept = (f"WHERE vec_id IN ({en})", f"AND doc_id IN ({en})") if before else ("", "")
    words = _bm25_sql(["token = 'the'", "token = 'of'"]).replace("HAVING count(*) = 2", f"HAVING count(*) = 2 {kept}")
    return f"""WITH {_Q7}, {_COARSE}, {_DOTS}, best AS (SELECT * FROM d {cut} ORDER BY score DESC, vec_id LIMIT 200), near AS (SELECT vec_id, row_number() OVER (ORDER BY round(list_cosine_similarity(e, q), 9) DESC, vec_id) AS r FROM best, q QUALIFY r <= 100),
{words}, words AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9), doc_id) AS r FROM bm),
f AS (SELECT coalesce(vec_id, doc_id) AS id, coalesce(1.0::double / (60 + near.r), 0) + coalesce(1.0::double / (60 + words.r), 0) AS score FROM near FULL JOIN words ON vec_id = doc_id)
SELECT id, round(f.score, 12) AS score FROM f JOIN documents ON id = doc_id WHERE lang = 'en' ORDER BY f.score DESC, id LIMIT 50"""


def _text_index(spark: SparkSession, sf_dir: str) -> str:
    """The stored index of the documents' texts; written once in a session."""
    folder = f"{scratch_folder(spark)}/text-index-{zlib.crc32(sf_dir.encode())}"
    if folder not in _INDEXED:
        text.write_index(table(spark, sf_dir, "documents"), "doc_id", "text", folder)
        _INDEXED.add(folder)
    return folder


def _branches(spark: SparkSession, sf_dir: str, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The two ranked lists of the hybrid search, each cut after ``allowed``."""
    vectors, q = _query_vector(spark, sf_dir)
    pool = vectors if allowed is None else vectors.join(allowed.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left_semi")
    near = vector.two_stage(pool, "vec_id", "embedding", q, 200, 100).select(F.col("vec_id").alias("id"), F.round("cosine", 9).alias("cosine"))
    words = text.search_index(spark, _text_index(spark, sf_dir), "doc_id", "the of", allowed=allowed).select(F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    return fusion.rank_list(near, F.desc("cosine"), "id"), fusion.rank_list(words, F.col("score"), "id")


@query(_hybrid_sql(True))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector branch and stored text index, each filtered by the document's metadata before its cut, fused."""
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return fusion.hybrid(*_branches(spark, sf_dir, english), "id").withColumn("score", F.round("score", 12))


@query(_hybrid_sql(False))
def hybrid_search_filtered_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the filter after the cuts: a selective one leaves fewer results."""
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return fusion.hybrid(*_branches(spark, sf_dir, None), "id", english).withColumn("score", F.round("score", 12))


@query(f"WITH {_bm25_sql(['token = ' + repr('license'), 'token = ' + repr('the')])} SELECT doc_id, round(score, 9) AS score FROM bm")
def fts_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search_index(spark, _text_index(spark, sf_dir), "doc_id", "License THE").withColumn("score", F.round("score", 9))


@query(f"WITH {_bm25_sql(['starts_with(token, ' + repr('licen') + ')', 'token = ' + repr('the')])} SELECT doc_id, round(score, 9) AS score FROM bm")
def fts_index_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search_index(spark, _text_index(spark, sf_dir), "doc_id", "licen* the", prefixes=True).withColumn("score", F.round("score", 9))


query(queues._changed_sql())(queues.index_maintenance)


@query(f"WITH {_Q7}, n AS (SELECT count(*) AS n FROM v) SELECT least(n, 500) AS candidates_evaluated, least(n, 50) AS final_ranked FROM n")
def search_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q = _query_vector(spark, sf_dir)
    best = vector.coarse_topk(vector.quantized(vectors, "vec_id", "embedding"), "vec_id", vector.quantize_query(q))
    return fusion.search_counts(best, vector.two_stage(vectors, "vec_id", "embedding", q, 500, 50))


@query(f"""WITH {_Q7}, {_COARSE}, pairs AS (SELECT a.vec_id AS query, b.vec_id AS item, list_cosine_similarity(a.e, b.e) AS x, list_sum(list_transform(list_zip(a.c, b.c), lambda p: p[1] * p[2])) AS y FROM c a, c b WHERE a.vec_id % 50 = 0),
r AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY round(x, 9) DESC, item) AS rx, row_number() OVER (PARTITION BY query ORDER BY y DESC, item) AS ry FROM pairs),
g AS (SELECT query, list(item ORDER BY rx) FILTER (rx <= 5) AS a, list(item ORDER BY ry) FILTER (ry <= 5) AS b FROM r GROUP BY query)
SELECT query, list_sort(a) = list_sort(b) AS same_set, a = b AS same_order FROM g""")
def ranking_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    coarse = vector.quantized(v, "vec_id", "embedding")
    asked = "vec_id % 50 = 0"
    exact = vector.batch_topk(v.where(asked), v, "vec_id", "vec_id", "embedding", 5, digits=9)
    rough = vector.batch_topk(coarse.where(asked), coarse, "vec_id", "vec_id", "coarse", 5, whole=True)
    return fusion.ranking_agreement(exact, rough, "query", "item")


# Catalogue -------------------------------------------------------------------------------------------

_SIGHT = "s AS (SELECT doc_id, sha256(text) AS hash, concat(source, ':', doc_id % 50) AS ref, n_chars AS size FROM documents)"


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("hash"), F.concat("source", F.lit(":"), (F.col("doc_id") % 50).cast("string")).alias("ref"), F.col("n_chars").alias("size"))


@query(f"""WITH {_SIGHT}, p AS (SELECT hash, ref, min(size) AS lo, max(size) AS hi FROM s GROUP BY ALL), c AS (SELECT hash, count(*) AS n, (count(*) - 1) * min(lo) AS saved, min(lo) <> max(hi) AS bad FROM p GROUP BY 1)
SELECT count(*) AS contents, sum(n)::bigint AS sources, sum(saved)::bigint AS bytes_saved, count(*) FILTER (bad) AS conflicts, (SELECT count(*) FROM (SELECT ref FROM s GROUP BY 1 HAVING count(DISTINCT hash) > 1)) AS diverged FROM c""")
def dedupe_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dedupe_ledger(_sightings(spark, sf_dir))


@query(f"WITH {_SIGHT} SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1 THEN 'first' WHEN row_number() OVER (PARTITION BY hash, ref ORDER BY doc_id) = 1 THEN 'duplicate' ELSE 'repeat' END AS label FROM s")
def dedupe_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sighting_labels(_sightings(spark, sf_dir), "doc_id").select("doc_id", "label")


_PAGES = r"f AS (SELECT regexp_extract(url, '://([^?#]*)', 1) AS path, strlen(html)::bigint AS byte_size, concat('part-', page_id % 3) AS part, page_id AS part_index FROM pages UNION ALL SELECT regexp_extract(url, '://([^?#]*)', 1), strlen(html) + page_id % 2, concat('part-', (page_id + 1) % 3), page_id + 100000 FROM pages WHERE page_id % 7 = 0)"


@query(f"""WITH {_PAGES}, g AS (SELECT path, byte_size, min((part_index, part)) AS k, count(*) AS copies FROM f GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k, byte_size) AS ordinal, count(*) OVER (PARTITION BY path) > 1 AS conflict FROM g)
SELECT path, byte_size, k[2] AS part, k[1] AS part_index, copies, ordinal, conflict, CASE WHEN ordinal > 1 THEN concat(k[2], '/', path) ELSE path END AS source_path FROM o""")
def part_merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), F.octet_length("html").cast("long").alias("n"))
    files = p.select("path", F.col("n").alias("byte_size"), F.concat(F.lit("part-"), (F.col("page_id") % 3).cast("string")).alias("part"), F.col("page_id").alias("part_index"))
    more = p.where("page_id % 7 = 0").select("path", F.expr("n + page_id % 2").alias("byte_size"), F.concat(F.lit("part-"), ((F.col("page_id") + 1) % 3).cast("string")).alias("part"), (F.col("page_id") + 100000).alias("part_index"))
    return resolve.merge_parts(files.unionByName(more)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT CASE WHEN n_chars < 300 THEN 'skipped' WHEN doc_id % 10 = 0 THEN 'degraded' ELSE 'imported' END AS status, count(*) AS files, sum(n_chars)::bigint AS bytes FROM documents GROUP BY 1")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("n_chars") < 300, "skipped").when(F.col("doc_id") % 10 == 0, "degraded").otherwise("imported")
    return catalog.reconciliation(table(spark, sf_dir, "documents"), status, "n_chars")


@query("SELECT conv_id, count(*)::int AS parts, sha256(unhex(string_agg(sha256(text), '' ORDER BY turn))) AS digest FROM conversations GROUP BY 1")
def composite_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.composite_digest(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"))


@query("SELECT doc_id, concat('u1/orig/', sha256(text)) AS orig, concat('u1/th/', sha256(text), '.webp') AS thumb, concat('u1/pv/', sha256(text), '.webp') AS preview, concat('u1/vid/', sha256(text), '/720p.mp4') AS video, concat('u1/vec/m1/', lpad((doc_id // 4096)::varchar, 5, '0'), '.bin') AS shard, TRUE AS valid FROM documents")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, u = F.sha2("text", 256), F.lit("u1")
    keys = {"orig": "orig", "thumb": "th", "preview": "pv", "video": "vid"}
    shard = expr.shard_key(u, F.lit("m1"), F.expr("doc_id div 4096"))
    return table(spark, sf_dir, "documents").select("doc_id", *(expr.object_key(k, u, h).alias(n) for n, k in keys.items()), shard.alias("shard"), (expr.is_content_hash(h) & expr.is_object_key(shard)).alias("valid"))


# Export resolution -----------------------------------------------------------------------------------

_FX = f"m AS (SELECT DISTINCT dir, name FROM {fx.MEDIA_SQL}), sc AS (SELECT DISTINCT dir, name AS sidecar FROM {fx.SIDECAR_SQL})"
_PAIR = rf"""{_FX}, cand AS (SELECT m.dir, m.name, sc.sidecar, CASE WHEN sidecar = name || '.json' THEN 0 WHEN sidecar = name || '.supplemental-metadata.json' THEN 1
WHEN sidecar <> '.json' AND starts_with(name, regexp_replace(sidecar, '\.json$', '')) THEN 2
WHEN regexp_matches(name, '^(.*)\((\d+)\)\.([^.]+)$') AND sidecar = regexp_replace(name, '^(.*)\((\d+)\)\.([^.]+)$', '\1.\3(\2).json') THEN 3
WHEN split_part(sidecar, '.', 1) = split_part(name, '.', 1) AND (SELECT count(*) FROM sc s2 WHERE s2.dir = m.dir AND split_part(s2.sidecar, '.', 1) = split_part(name, '.', 1)) = 1 THEN 4 END AS step FROM m JOIN sc USING (dir)),
best AS (SELECT * FROM cand WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir, name ORDER BY step, CASE WHEN step = 2 THEN -length(sidecar) ELSE 0 END, sidecar) = 1),
cl AS (SELECT dir, sidecar, count(*) FILTER (step < 4) AS own, count(*) FILTER (step = 4) AS weak FROM best GROUP BY ALL),
j AS (SELECT best.*, own, (own > 1 OR (own = 0 AND weak > 1)) AS contested FROM best JOIN cl USING (dir, sidecar)),
pairing AS (SELECT m.dir, m.name, CASE WHEN NOT contested THEN sidecar END AS sidecar, CASE WHEN NOT contested THEN ['exact', 'exact', 'truncated', 'disambiguator-swap', 'unique-basename'][step + 1] ELSE 'unpaired' END AS step,
coalesce(NOT contested AND step = 4 AND own > 0, FALSE) AS shared, CASE WHEN NOT contested THEN NULL WHEN contested THEN 'contested-sidecar'
WHEN (SELECT count(*) FROM sc WHERE sc.dir = m.dir AND split_part(sc.sidecar, '.', 1) = split_part(m.name, '.', 1)) > 1 THEN 'ambiguous-basename' ELSE 'no-candidate' END AS reason FROM m LEFT JOIN j USING (dir, name))"""


def _pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.pair_sidecars(fx.media(spark, sf_dir), fx.sidecars(spark, sf_dir))


@query(f"WITH {_PAIR} SELECT * FROM pairing")
def sidecar_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairing(spark, sf_dir)


query(details._media_sidecars_sql())(details.media_sidecars)

_STEMS = r"st AS (SELECT dir, name, regexp_replace(name, '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(name, '\.([^.]*)$', 1)) AS ext, regexp_extract(name, '\.([^.]*)$', 1) AS raw FROM m), k AS (SELECT *, CASE WHEN ext IN ('mp4', 'mov', 'm4v', 'avi', 'mkv', '3gp', 'mpg', 'mpeg', 'wmv', 'webm') THEN 1 ELSE 0 END AS kind, nullif(regexp_extract(stem, '(?i)^(.+)(?:-edited|-bearbeitet|-modifié|-editado)$', 1), '') AS bs FROM st)"


@query(f"""WITH {_FX}, {_STEMS}, same AS (SELECT e.dir, e.name, p.name AS base FROM k e JOIN k p ON e.dir = p.dir AND p.bs IS NULL AND p.name = e.bs || '.' || e.raw WHERE e.bs IS NOT NULL),
stems AS (SELECT e.dir, e.name, count(*) AS n, min(p.name) AS sole FROM k e JOIN k p ON e.dir = p.dir AND p.bs IS NULL AND p.stem = e.bs AND p.kind = e.kind WHERE e.bs IS NOT NULL GROUP BY ALL)
SELECT k.dir, k.name, coalesce(same.base, CASE WHEN n = 1 THEN sole END) AS base, CASE WHEN same.base IS NOT NULL THEN 'same-name' WHEN n = 1 THEN 'same-stem' WHEN n > 1 THEN 'ambiguous-base' ELSE 'no-base' END AS matched_by
FROM k LEFT JOIN same ON k.dir = same.dir AND k.name = same.name LEFT JOIN stems ON k.dir = stems.dir AND k.name = stems.name WHERE k.bs IS NOT NULL""")
def variant_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.link_variants(fx.media(spark, sf_dir))


@query(f"""WITH {_PAIR}, {_STEMS}, x AS (SELECT k.dir, k.stem, k.name, p.sidecar, p.shared, CASE WHEN ext IN ('heic', 'heif', 'jpg', 'jpeg') THEN 's' WHEN ext = 'mov' THEN 'm' END AS role FROM k JOIN pairing p ON k.dir = p.dir AND k.name = p.name),
mo AS (SELECT dir, stem, count(*) AS n, min((name, sidecar, shared)) AS mm FROM x WHERE role = 'm' GROUP BY ALL),
y AS (SELECT x.dir, x.stem, any_value(n) AS n, any_value(mm) AS mm, count(*) AS s, min(x.name) AS sole, count(*) FILTER (mm[3] AND NOT shared AND sidecar = mm[2]) AS o, min(x.name) FILTER (mm[3] AND NOT shared AND sidecar = mm[2]) AS owner FROM x JOIN mo ON x.dir = mo.dir AND x.stem = mo.stem WHERE role = 's' GROUP BY ALL),
z AS (SELECT *, CASE WHEN n = 1 THEN CASE WHEN s = 1 THEN sole WHEN o = 1 THEN owner END END AS still FROM y)
SELECT dir, stem, still, CASE WHEN still IS NOT NULL THEN mm[1] END AS motion, coalesce(still IS NOT NULL AND o = 1 AND owner = still, FALSE) AS sidecar_shared, CASE WHEN still IS NOT NULL THEN 'paired' ELSE 'ambiguous' END AS status FROM z""")
def live_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.live_pairs(fx.media(spark, sf_dir), _pairing(spark, sf_dir))


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.media(spark, sf_dir).select("dir", "folder").distinct().select("dir", "folder", F.col("folder").isin("Iceland 2019", "Familienurlaub 2020").alias("has_metadata"), F.when(F.col("folder") == "Iceland 2019", " Iceland ").alias("title"))


@query(f"""WITH r AS (SELECT *, CASE WHEN regexp_matches(lower(folder), '^photos from [0-9]{{4}}$') THEN 'year-bucket' WHEN folder IN ('Iceland 2019', 'Familienurlaub 2020') THEN 'album' WHEN lower(folder) = 'archive' THEN 'archive' WHEN lower(folder) IN ('trash', 'bin') THEN 'trash' ELSE 'other' END AS role FROM {fx.MEDIA_SQL})
SELECT dir, name, role, (role = 'archive' OR archived) AS archived, concat_ws(',', CASE WHEN role = 'archive' THEN 'folder' END, CASE WHEN archived THEN 'sidecar' END) AS archived_by, (role = 'trash' OR trashed) AS in_trash, concat_ws(',', CASE WHEN role = 'trash' THEN 'folder' END, CASE WHEN trashed THEN 'sidecar' END) AS in_trash_by, NOT (role = 'trash' OR trashed) AS imported FROM r""")
def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.dispositions(fx.media(spark, sf_dir).drop("folder"), _folders(spark, sf_dir).drop("title"))
    return out.withColumn("archived_by", F.array_join("archived_by", ",")).withColumn("in_trash_by", F.array_join("in_trash_by", ","))


@query(f"WITH m AS (SELECT DISTINCT dir, folder, name FROM {fx.MEDIA_SQL}) SELECT concat('takeout-album:', sha256(dir)) AS id, dir, CASE WHEN folder = 'Iceland 2019' THEN 'Iceland' ELSE folder END AS title, string_agg(name, '|' ORDER BY name) AS members FROM m WHERE folder IN ('Iceland 2019', 'Familienurlaub 2020') GROUP BY dir, folder")
def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.albums(_folders(spark, sf_dir), fx.media(spark, sf_dir).select("dir", "name").distinct()).withColumn("members", F.array_join("members", "|"))


@query("""WITH me AS (SELECT source AS album_id, lpad(doc_id::varchar, 8, '0') AS path, CASE WHEN doc_id % 11 <> 0 THEN sha256(text) END AS hash FROM documents),
j AS (SELECT *, CASE WHEN hash IS NULL THEN 'unresolved' WHEN row_number() OVER (PARTITION BY album_id, hash ORDER BY path) = 1 THEN 'kept' ELSE 'duplicate' END AS status FROM me)
SELECT album_id, path, hash, status, CASE WHEN status = 'kept' THEN (sum((status = 'kept')::int) OVER (PARTITION BY album_id ORDER BY path) - 1)::int END AS position FROM j""")
def album_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("album_id"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("path"), "doc_id", F.sha2("text", 256).alias("hash"))
    return resolve.album_members(d.select("album_id", "path"), d.where("doc_id % 11 <> 0").select("path", "hash"))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), l AS (SELECT doc_id AS path, doc_id + 3 AS target FROM d WHERE doc_id % 4 = 0)
SELECT path, a.h AS hash, CASE WHEN b.h <> a.h THEN b.h END AS target_hash, CASE WHEN b.h <> a.h THEN 'resolved' ELSE 'unresolved' END AS status FROM l LEFT JOIN d a ON a.doc_id = path LEFT JOIN d b ON b.doc_id = target""")
def link_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return resolve.resolve_links(d.where("path % 4 = 0").select("path", (F.col("path") + 3).alias("target")), d)


@query(rf"""WITH t AS (SELECT * FROM {fx.TIMES_SQL}), c AS (SELECT name, nullif(try_cast(sidecar_s AS bigint), 0) * 1000 AS s,
(epoch_ms(try_strptime(exif, '%Y:%m:%d %H:%M:%S')) - coalesce(o, 0) * 60000)::bigint AS e, o, mtime_ms FROM (SELECT *, CASE WHEN regexp_matches(exif_offset, '^[+-]\d\d:\d\d$') THEN (CASE WHEN exif_offset[1] = '-' THEN -1 ELSE 1 END) * (exif_offset[2:3]::int * 60 + exif_offset[5:6]::int) END AS o FROM t)),
a AS (SELECT *, coalesce(s, e, mtime_ms) AS t0, CASE WHEN s IS NOT NULL THEN 'sidecar' WHEN e IS NOT NULL THEN 'exif' ELSE 'mtime' END AS source FROM c)
SELECT name, t0::bigint AS captured_at, source, CASE WHEN e = t0 THEN o END AS tz_offset_min, concat_ws(',', CASE WHEN source <> 'sidecar' AND s <> t0 THEN 'sidecar' END, CASE WHEN source <> 'exif' AND e <> t0 THEN 'exif' END, CASE WHEN source <> 'mtime' AND mtime_ms <> t0 THEN 'mtime' END) AS overruled FROM a""")
def captured_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.times(spark, sf_dir).withColumn("o", expr.exif_offset_minutes(F.col("exif_offset")))
    c = expr.captured_at(expr.sidecar_millis(F.col("sidecar_s")), expr.exif_millis(F.col("exif"), F.col("o")), F.col("o"), F.col("mtime_ms"))
    return t.select("name", c.alias("c")).select("name", "c.captured_at", "c.source", "c.tz_offset_min", F.array_join("c.overruled", ",").alias("overruled"))


@query(r"""SELECT page_id, CASE WHEN ext IN ('jpg', 'html') THEN CASE WHEN ext = 'html' THEN 'unknown' ELSE 'media' END WHEN ext = 'json' THEN 'sidecar' ELSE 'unknown' END AS kind
FROM (SELECT page_id, lower(regexp_extract(n, '\.([^.]*)$', 1)) AS ext FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat(page_id, '.JPG') WHEN 1 THEN concat(page_id, '.jpg.json') ELSE concat(page_id, '.html') END AS n FROM pages))""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    name = F.concat(i.cast("string"), F.when(i % 3 == 0, ".JPG").when(i % 3 == 1, ".jpg.json").otherwise(".html"))
    return table(spark, sf_dir, "pages").select("page_id", expr.classify_file(name).alias("kind"))


# Sync ------------------------------------------------------------------------------------------------

_LOG = "log AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS updated_at, CASE WHEN event_type = 'error' THEN epoch_us(ts) // 1000 END AS deleted_at, event_id AS version, value AS payload FROM events), loc AS (SELECT * FROM log WHERE version % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY version) = 1), rem AS (SELECT * FROM log WHERE version % 2 = 1)"


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), at.alias("updated_at"), F.when(F.col("event_type") == "error", at).alias("deleted_at"), F.col("event_id").alias("version"), F.col("value").alias("payload"))
    local = catalog.first_copies(log.where("version % 2 = 0"), "key", order="version")
    return local, log.where("version % 2 = 1")


@query(f"""WITH {_LOG}, b AS (SELECT *, 1 AS l FROM loc UNION ALL SELECT *, 0 FROM rem), w AS (SELECT key, updated_at, deleted_at, payload FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY deleted_at IS NOT NULL DESC, updated_at DESC, l DESC, version DESC) = 1), v AS (SELECT key, max(version) AS version FROM b GROUP BY 1)
SELECT key, updated_at, deleted_at, version, payload FROM w JOIN v USING (key)""")
def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.lww_merge(*_log(spark, sf_dir), "key")


@query(f"""WITH {_LOG}, r AS (SELECT key, arg_max((updated_at, deleted_at), version) AS r FROM rem GROUP BY 1), j AS (SELECT r.r[2] IS NOT NULL AS dead, loc.key IS NOT NULL AS here, loc.deleted_at IS NOT NULL AS gone, r.r[1] > loc.updated_at AS newer FROM r LEFT JOIN loc USING (key)), k AS (SELECT *, here AND (gone OR (NOT dead AND NOT newer)) AS kept FROM j)
SELECT count(*) FILTER (NOT here) AS inserted, count(*) FILTER (here AND NOT kept AND NOT dead) AS updated, count(*) FILTER (here AND NOT kept AND dead) AS tombstoned, count(*) FILTER (kept) AS kept FROM k""")
def lww_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.lww_counters(*_log(spark, sf_dir), "key")


@query("SELECT event_id, user_id FROM events WHERE event_id > 1234 ORDER BY event_id LIMIT 500")
def delta_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.delta_page(table(spark, sf_dir, "events"), (1234, 1 << 62), "event_id", "user_id").select("event_id", "user_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS price FROM part UNION ALL SELECT p_partkey + 1000000000, p_retailprice + 1 FROM part WHERE p_partkey % 2 = 0 AND p_size <= 10")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    new = old.where("p_partkey % 2 = 0").withColumn("price", F.col("price") + 1)
    return relational.upsert(old, new.unionByName(table(spark, sf_dir, "part").where("p_partkey % 2 = 0 and p_size <= 10").select((F.col("p_partkey") + 1000000000).alias("p_partkey"), (F.col("p_retailprice") + 1).alias("price"))), ["p_partkey"], ["price"])


@query("SELECT p_partkey, p_size FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, -1 FROM part WHERE p_size > 25")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return relational.insert_or_ignore(part.where("p_size <= 25"), part.where("p_size > 15").withColumn("p_size", F.lit(-1)), "p_partkey")


# Jobs ------------------------------------------------------------------------------------------------

_STATES = "('pending', 'running', 'done', 'failed', 'dead')"
_JOBS = "j AS (SELECT event_id AS id, event_id % 5 AS state, user_id % 4 AS priority, epoch_us(ts) // 1000 AS next_attempt_at, (event_id % 7)::int AS attempts FROM events)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("id"), (e % 5).cast("int").alias("state"), (F.col("user_id") % 4).alias("priority"), F.unix_millis(F.col("ts").cast("timestamp")).alias("next_attempt_at"), (e % 7).cast("int").alias("attempts"))


@query(f"WITH {_JOBS} SELECT s.state, count(j.id) AS n FROM (VALUES (0), (1), (2), (3), (4), (5)) s(state) LEFT JOIN j ON j.state = s.state GROUP BY 1")
def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.counts_with_zeros(_jobs(spark, sf_dir), "state", range(6))


@query(f"WITH {_JOBS} SELECT id, 1 AS state, priority, 1705363200000 + 60000 AS next_attempt_at, attempts + 1 AS attempts FROM j WHERE next_attempt_at <= 1705363200000 AND (state IN (0, 3) OR (state = 1 AND attempts < 5)) ORDER BY CASE WHEN state IN (0, 3) THEN 0 ELSE 1 END, j.priority, j.next_attempt_at, id LIMIT 20")
def job_claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.claim(_jobs(spark, sf_dir), 1705363200000, 20)


@query(f"WITH {_JOBS} SELECT id, least(300000, 1000 * 2 ** greatest(attempts - 1, 0))::bigint AS ceiling, greatest(1, floor(least(300000, 1000 * 2 ** greatest(attempts - 1, 0)) / 2 * (1 + (id % 10) / 10) + 0.5))::bigint AS delay FROM j")
def job_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("id", expr.backoff_ceiling(F.col("attempts")).cast("long").alias("ceiling"), expr.backoff_delay(F.col("attempts"), (F.col("id") % 10) / 10).alias("delay"))


@query(f"WITH {_JOBS} SELECT id FROM j WHERE state = 4 ORDER BY id LIMIT 50")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.dead_letters(_jobs(spark, sf_dir)).select("id")


@query(f"WITH {_JOBS} SELECT id, CASE WHEN state = 1 AND next_attempt_at <= 1705363200000 AND attempts >= 5 THEN 4 ELSE state END::int AS state FROM j")
def job_reap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reap(_jobs(spark, sf_dir), 1705363200000).select("id", "state")


@query("""WITH e AS (SELECT event_id, event_type AS kind, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS ident FROM events)
SELECT event_id, kind, ident FROM e w WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.event_id % 10 = 0 AND o.kind = w.kind AND o.ident IS NOT DISTINCT FROM w.ident)""")
def enqueue_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("ident"))
    return relational.enqueue_once(e, e.where("event_id % 2 = 1"), ["kind", "ident"], F.col("event_id") % 10 == 0)


@query("WITH m AS (SELECT vec_id // 2 AS hash, label % 2 AS model FROM embeddings) SELECT hash FROM m WHERE model <> 1 EXCEPT SELECT hash FROM m WHERE model = 1")
def model_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("hash"), (F.col("label") % 2).alias("model"))
    return relational.stale_models(m, "hash", "model", 1)


@query("SELECT label % 3 AS model, count(*) AS stale FROM embeddings WHERE label % 3 <> 0 GROUP BY 1")
def stale_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.stale_by_model(table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("model")), "model", 0)


# Lifecycle -------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT event_id AS key, round(value * 100)::bigint AS bytes, epoch_us(ts) AS used FROM events), t AS (SELECT *, (SELECT sum(bytes) FROM c) AS total, coalesce(sum(bytes) OVER (ORDER BY used, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT key FROM t WHERE total - before > (SELECT sum(bytes) // 2 FROM c)""")
def lru_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.round(F.col("value") * 100).cast("long").alias("bytes"), F.unix_micros(F.col("ts").cast("timestamp")).alias("used"))
    return relational.lru_evictions(c, "key", "bytes", "used", (c.agg(F.sum("bytes")).first()[0] or 0) // 2).select("key")


_ASSETS = "a AS (SELECT o_orderkey AS hash, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 3 END AS remote_state, (o_orderkey % 16)::int AS derivative_mask, 1 + (o_orderkey % 3)::int AS local_state, round(o_totalprice)::bigint AS byte_size FROM orders)"


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("hash"), F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(3).alias("remote_state"), (k % 16).cast("int").alias("derivative_mask"), (1 + k % 3).cast("int").alias("local_state"), F.round("o_totalprice").cast("long").alias("byte_size"))


@query(f"WITH {_ASSETS} SELECT hash, remote_state = 2 AND (derivative_mask & 6) = 6 AS eligible, CASE WHEN remote_state <> 2 THEN concat('remote state ', remote_state) WHEN (derivative_mask & 6) <> 6 THEN concat('derivative mask ', derivative_mask) END AS reason, CASE WHEN remote_state = 2 AND (derivative_mask & 6) = 6 AND local_state = 1 THEN 2 ELSE local_state END AS next_local_state FROM a")
def purge_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.purge_eligibility(_assets(spark, sf_dir)).select("hash", "eligible", "reason", "next_local_state")


@query(f"WITH {_ASSETS} SELECT hash % 3 AS outcome, count(*) AS files, sum(byte_size)::bigint AS bytes FROM a WHERE local_state = 2 GROUP BY 1")
def purge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assets(spark, sf_dir)
    audit, _ = lifecycle.purge_batch(a, a.select("hash", (F.col("hash") % 3).alias("outcome")))
    return audit.groupBy("outcome").agg(F.count("*").alias("files"), F.sum("byte_size").alias("bytes"))


@query(f"WITH {_ASSETS} SELECT count(*) AS files, coalesce(sum(byte_size), 0)::bigint AS bytes FROM a WHERE local_state <> 3 AND remote_state = 2")
def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.export_plan(_assets(spark, sf_dir), "byte_size", F.col("local_state") != 3, F.col("remote_state") == 2)


@query(f"WITH {_ASSETS} SELECT sum(byte_size)::bigint AS total_bytes, (sum(byte_size) FILTER (local_state <> 3))::bigint AS local_bytes, (sum(byte_size) FILTER (local_state = 3))::bigint AS reclaimed_bytes, count(*) FILTER (remote_state = 2) AS verified, count(*) FILTER (local_state = 3) AS purged FROM a")
def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.storage_stats(_assets(spark, sf_dir), "byte_size", F.col("local_state") == 3, F.col("remote_state") == 2)


@query(f"""WITH {_ASSETS}, b AS (SELECT sum(byte_size)::bigint AS bytes FROM a), c AS (SELECT bytes, round(bytes / 1073741824 * 0.004, 4) AS storage_cost, round(greatest(0, 80 - 10.0::double) * 0.09, 4) AS egress_cost FROM b)
SELECT bytes, storage_cost, egress_cost, round(storage_cost + egress_cost, 4) AS total_cost, storage_cost + egress_cost <= 3 AS within_ceiling, TRUE AS egress_alarm FROM c""")
def storage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.storage_cost(_assets(spark, sf_dir), "byte_size", 80 << 30)


@query("""WITH o AS (SELECT o_orderkey, round(o_totalprice * 1000)::bigint AS n FROM orders), p AS (SELECT *, greatest(5242880, ceil(ceil(n / 10000) / 1048576) * 1048576)::bigint AS part_size FROM o WHERE n > 0), q AS (SELECT *, ceil(n / part_size)::bigint AS part_count FROM p)
SELECT o_orderkey, part_size, part_count, n - part_size * (part_count - 1) AS last_part_size, n > 8388608 AS multipart FROM q""")
def multipart_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 1000).cast("long").alias("n"))
    return o.select("o_orderkey", expr.multipart(F.col("n")).alias("p"), expr.uses_multipart(F.col("n")).alias("multipart")).where("p is not null").select("o_orderkey", "p.*", "multipart")


@query("""WITH o AS (SELECT o_orderkey, round(o_totalprice * 1000)::bigint AS n FROM orders), p AS (SELECT *, greatest(5242880, ceil(ceil(n / 10000) / 1048576) * 1048576)::bigint AS s FROM o WHERE n > 0)
SELECT o_orderkey, i AS part, (i - 1) * s AS start, least(n, i * s) - 1 AS "end" FROM p, unnest(range(1, ceil(n / s)::bigint + 1)) r(i)""")
def multipart_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.multipart_parts(table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 1000).cast("long").alias("n")), "o_orderkey", "n")


@query("SELECT doc_id, sha256(text) AS actual, doc_id % 5 <> 0 AS verified FROM documents")
def verify_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), F.when(F.col("doc_id") % 5 != 0, F.sha2("text", 256)).otherwise("0").alias("hash"))
    return lifecycle.verify_remote(d).select("doc_id", "actual", "verified")


@query("SELECT event_id, CASE event_id % 3 WHEN 1 THEN 'restore' WHEN 2 THEN 'wait' ELSE 'fetch' END AS action, CASE WHEN event_id % 3 = 1 THEN 2 ELSE event_id % 3 END::int AS next_tier FROM events")
def tier_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.tier_step(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).cast("int").alias("tier_state"))).select("event_id", "action", "next_tier")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM orders")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", expr.iso_utc(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("iso"))


@query("SELECT floor(vec_id / 128)::int AS shard, count(*) AS slots, min(vec_id) AS first_slot FROM embeddings WHERE vec_id % 10 <> 3 GROUP BY 1")
def vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slot"))
    live = vector.live_slots(v, v.where("slot % 10 = 3"))
    return vector.shard_rows(live, per_shard=128).groupBy("shard").agg(F.count("*").alias("slots"), F.min("slot").alias("first_slot"))


@query("""SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(source), 'src1') AND list_contains([source, lang], 'src1') AND n_chars * 1000 >= 200000 AND n_chars * 1000 <= 900000 + 86400000 AND length(trim(text)) > 0""")
def web_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("n_chars") * 1000
    holds = expr.hard_filter(F.col("lang") == "en", (F.col("source"), "SRC1"), (F.array("source", "lang"), "src1"), at, 200_000, 900_000, F.col("text"))
    return table(spark, sf_dir, "documents").where(holds).select("doc_id")


@query("""SELECT p_partkey, 15 * list_sum(list_transform(['steel', 'brass', 'nickel'], lambda c: (contains(lower(p_type), c) OR contains(c, lower(p_type)))::int)) + 10 * contains(lower(p_name), 'steel')::int + 15 * contains(lower(p_brand), 'steel')::int AS score FROM part""")
def concept_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    score = expr.concept_score(["Steel"], {"steel": ("brass", "nickel")}, F.array("p_type"), none, F.col("p_name"), none, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", score.cast("decimal(38,0)").cast("long").alias("score"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderkey % 4 = 1) AS uploading, count(*) FILTER (o_orderkey % 4 = 2) AS verified, count(*) FILTER (o_orderkey % 4 = 3) AS failed, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS unhashed FROM orders WHERE o_orderstatus <> 'P'")
def library_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", 1).alias("deleted_at"), (F.col("o_orderkey") % 4).alias("remote_state"))
    return ingest.library_status(assets, table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).alias("hash_state")))


@query("SELECT r_name, count(n_name) AS items FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def contained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    items = table(spark, sf_dir, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.array("r_name").alias("albums"))
    return relational.contained_counts(region.select("r_name"), items, "r_name", "albums")


@query("SELECT c_custkey AS local_id, CASE WHEN c_acctbal < 4000 THEN 100 ELSE 200 END AS first_seen, CASE WHEN c_nationkey % 2 = 0 THEN 200 ELSE 100 END AS last_seen FROM customer WHERE c_acctbal < 4000 OR c_nationkey % 2 = 0")
def enumerate_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("local_id"), "c_acctbal", "c_nationkey")
    known = c.where("c_acctbal < 4000").select("local_id", F.lit(None).cast("string").alias("hash"), F.lit(0).alias("platform"), F.lit(0).alias("hash_state"), F.lit(100).cast("long").alias("first_seen"), F.lit(100).cast("long").alias("last_seen"))
    out = ingest.enumerate_assets(known, c.where("c_nationkey % 2 = 0").select("local_id", F.lit(1).alias("platform")), 200)
    return out.select("local_id", F.col("first_seen").cast("int"), F.col("last_seen").cast("int"))


@query("SELECT label AS query, count(*) AS items FROM (SELECT label, vec_id FROM embeddings EXCEPT SELECT label, vec_id FROM embeddings WHERE vec_id % 4 = 0) GROUP BY 1")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    return v.subtract(v.where("vec_id % 4 = 0")).groupBy(F.col("label").alias("query")).agg(F.count("*").alias("items"))
