"""Reciprocal rank fusion and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def rrf(lists: Sequence[DataFrame], key: str, weights: Sequence[float] | None = None, k: int = K, scale: float = 1.0) -> DataFrame:
    """(key, score, rank_0, rank_1, ...) from lists of (key, rank): each adds weight / (k + rank)."""
    weights = weights or [1.0] * len(lists)
    every = None
    for i, (one, w) in enumerate(zip(lists, weights, strict=True)):
        rows = one.select(key, "rank", F.lit(i).alias("_list"), F.lit(float(w)).alias("_w"))
        every = rows if every is None else every.unionByName(rows)
    ranks = [F.max(F.when(F.col("_list") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(lists))]
    return every.groupBy(key).agg((F.sum(F.col("_w") / (k + F.col("rank"))) * scale).alias("score"), *ranks)


def weighted_rrf(vector: DataFrame, text: DataFrame, key: str, vector_weight: float = 1.2, text_weight: float = 1.5) -> DataFrame:
    """(key, score): the web variant, times 100 and rounded to 3 places. A document found by text only, by its
    metadata alone (text_score 0), counts as rank 200. ``text`` has (key, rank, text_score)."""
    v = vector.select(key, F.col("rank").alias("_v"))
    t = text.select(key, F.col("rank").alias("_t"), "text_score")
    joined = v.join(t, key, "full_outer")
    place = F.when(F.col("_v").isNull() & (F.col("text_score") <= 0), 200).otherwise(F.col("_t"))
    score = F.coalesce(vector_weight / (K + F.col("_v")), F.lit(0.0)) + F.coalesce(text_weight / (K + place), F.lit(0.0))
    return joined.select(key, F.round(score * 100, 3).alias("score"))


def rank_list(df: DataFrame, order, key: str) -> DataFrame:
    """(key, rank) of a limited result, from 1; ties by key."""
    return df.select(key, F.row_number().over(Window.orderBy(order, key)).alias("rank"))


def hybrid(near: DataFrame, words: DataFrame, key: str, allowed: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """(key, score): a vector list and a text list, both (key, rank), fused; ``allowed`` (key) filters what is fused. To filter before the
    cut, hand in lists of allowed items; this filter comes after it."""
    fused = rrf([near, words], key)
    kept = fused if allowed is None else fused.join(allowed.select(key), key, "left_semi")
    return kept.orderBy(F.desc("score"), key).limit(limit).select(key, "score")


def search_counts(candidates: DataFrame, final: DataFrame) -> DataFrame:
    """(candidates_evaluated, final_ranked) of one search."""
    return candidates.agg(F.count("*").alias("candidates_evaluated")).join(F.broadcast(final.agg(F.count("*").alias("final_ranked"))))


def retrieval_quality(ranked: DataFrame, relevant: DataFrame, query: str, key: str) -> DataFrame:
    """Recall, top-1 and forbidden hits by query; ``relevant`` has (query, key, grade: 1 wanted, -1 forbidden)."""
    joined = relevant.join(ranked.select(query, key, "rank"), [query, key], "left")
    hit = F.col("rank").isNotNull()
    return joined.groupBy(query).agg((F.count_if(hit & (F.col("grade") == 1)) / F.count_if(F.col("grade") == 1)).alias("recall"), F.count_if((F.col("rank") == 1) & (F.col("grade") == 1)).alias("top1"), F.count_if(hit & (F.col("grade") == -1)).alias("forbidden"))


def retrieval_by_label(ranked: DataFrame, asked: DataFrame, labels: DataFrame, query: str, key: str, forbidden) -> DataFrame:
    """Recall, top-1 and forbidden hits by query, where every other item of the query's label is wanted and those of the label
    ``forbidden`` (a function of it) are not. Wanted items are counted per label, not listed. ``asked`` has (query, label), ``labels`` (key, label), ``ranked`` (query, key, rank);
    a query with nothing wanted is left out."""
    sizes = labels.groupBy(F.col("label").alias("_want")).agg(F.count("*").alias("_n"))
    own = asked.join(labels.select(F.col(key).alias(query), F.lit(1).alias("_self")), query, "left")
    wanted = own.join(sizes, F.col("label") == F.col("_want")).select(query, F.col("label").alias("_want"), (F.col("_n") - F.coalesce("_self", F.lit(0))).alias("_n")).where("_n > 0")
    met = ranked.join(labels.select(key, F.col("label").alias("_got")), key)
    hit = F.col("_got") == F.col("_want")
    out = wanted.join(met.select(query, "rank", "_got"), query, "left").groupBy(query, "_n")
    return out.agg((F.count_if(hit) / F.first("_n")).alias("recall"), F.count_if(hit & (F.col("rank") == 1)).alias("top1"), F.count_if(F.col("_got") == forbidden(F.col("_want"))).alias("forbidden")).drop("_n")


def ranking_agreement(a: DataFrame, b: DataFrame, query: str, key: str) -> DataFrame:
    """(query, same_set, same_order) of two engines' (query, key, rank)."""
    lists = [one.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda s: s[key]).alias(name)) for one, name in ((a, "_a"), (b, "_b"))]
    empty = F.array().cast(f"array<{a.schema[key].dataType.simpleString()}>")
    joined = lists[0].join(lists[1], query, "full_outer").select(query, F.coalesce("_a", empty).alias("_a"), F.coalesce("_b", empty).alias("_b"))
    return joined.select(query, (F.array_sort("_a") == F.array_sort("_b")).alias("same_set"), (F.col("_a") == F.col("_b")).alias("same_order"))
