"""Two-stage vector retrieval."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.udf import project


def literal(vector: Sequence[float]) -> Column:
    """An array of doubles, as one parsed expression."""
    return F.expr("array(" + ", ".join(f"double('{float(x)!r}')" for x in vector) + ")")


def vector_of(vectors: DataFrame, key: str, value, column: str) -> list[float]:
    """One vector, by key; an error if there is none."""
    row = vectors.where(F.col(key) == value).select(column).first()
    if row is None:
        raise KeyError(value)
    return list(row[0])


def exact_topk(vectors: DataFrame, key: str, column: str, query: Sequence[float], k: int) -> DataFrame:
    """(key, cosine): the k nearest by cosine; a bounded heap per task, k rows to one."""
    return vectors.select(key, expr.cosine(F.col(column), literal(query)).alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)


def quantized(vectors: DataFrame, key: str, column: str, matrix=None) -> DataFrame:
    """(key, coarse): int8 of the normalised (and projected) vectors; vectors without a direction are left out."""
    unit = expr.normalised(F.col(column)) if matrix is None else project(F.col(column), matrix)
    return vectors.select(key, expr.quantize(unit).alias("coarse")).where("coarse is not null")


def quantize_query(query: Sequence[float], matrix=None) -> list[int]:
    """The query in the same form, on the driver."""
    v = np.asarray(query, np.float64)
    if matrix is not None:
        v = v @ np.asarray(matrix, np.float64)
    n = float(np.sqrt((v * v).sum()))
    v = v / n if n > 1e-12 else v
    return [int(max(-128, min(127, int(x * 128)))) for x in v]


def coarse_topk(coarse: DataFrame, key: str, query: Sequence[int], k: int = 500) -> DataFrame:
    """(key, score): the k greatest int8 dot products; equal ones by key."""
    q = F.expr("array(" + ", ".join(str(int(x)) for x in query) + ")")
    return coarse.select(key, expr.dot_int8(F.col("coarse"), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def two_stage(vectors: DataFrame, key: str, column: str, query: Sequence[float], candidates: int = 500, final: int = 100, matrix=None, predicate: Column | None = None) -> DataFrame:
    """(key, cosine): exact cosines of the best coarse candidates. The candidates number at most
    ``candidates`` and are broadcast; ``predicate`` filters before the cut, so a selective one loses nothing."""
    pool = vectors if predicate is None else vectors.where(predicate)
    best = coarse_topk(quantized(pool, key, column, matrix), key, quantize_query(query, matrix), candidates)
    return vectors.join(F.broadcast(best.select(key)), key).select(key, expr.cosine(F.col(column), literal(query)).alias("cosine")).orderBy(F.desc("cosine"), key).limit(final)


MOST_PROBES = 1024


def similarity_matrix(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, column: str) -> DataFrame:
    """(query, item, cosine) of each query with each item, for at most ``MOST_PROBES`` queries: an error for more, which
    ``batch_topk`` and ``probe_blocks`` answer without the matrix."""
    if queries.limit(MOST_PROBES + 1).count() > MOST_PROBES:
        raise ValueError(f"more than {MOST_PROBES} queries")
    q = queries.select(F.col(query_key).alias("query"), F.col(column).alias("_q"))
    return items.select(F.col(item_key).alias("item"), column).join(F.broadcast(q)).select("query", "item", expr.cosine(F.col(column), F.col("_q")).alias("cosine"))


CHUNK_BYTES = 32 << 20
"""Vectors that one task compares at a time (as doubles)."""
AT_ONCE = 512
"""Queries that meet a chunk at a time."""


def _matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Vectors as rows of doubles. Shorter ones end in zeros; null ones, and those with a component that isn't finite, are zero: they have no direction."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(vectors.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    out[~np.isfinite(out).all(1)] = 0
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _met(queries: DataFrame, items: DataFrame, answer, schema: str, block: int) -> DataFrame:
    """What ``answer`` (query ids, query vectors, query numbers, item ids, item vectors; to a record batch of ``schema``) says of each chunk of ``items`` (id,
    vector) and every block of ``queries`` (id, vector, number).

    Items are dealt to chunks of at most about ``CHUNK_BYTES``; the queries go to every chunk. In a task a chunk's items come first and are held, its queries
    stream past, ``block`` at a time. Nothing goes through the driver but the number of items and their greatest length, and the plan has one size.
    """
    spark = items.sparkSession
    n, width = items.agg(F.count("*"), F.max(F.size("vector"))).first()
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n or 0) * max(width or 0, 1) * 8 // CHUNK_BYTES))
    dealt = items.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("kind"), F.col("id").alias("item"), F.lit(None).cast(queries.schema["id"].dataType).alias("query"), F.col("vector").cast("array<double>").alias("vector"), F.lit(None).cast("double").alias("number"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("kind"), F.lit(None).cast(items.schema["id"].dataType).alias("item"), F.col("id").alias("query"), F.col("vector").cast("array<double>").alias("vector"), F.col("number").cast("double").alias("number"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, held = None, [], [], None
        for batch in batches:
            at = 0
            chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            while at < batch.num_rows:
                end = at + 1
                limit = min(batch.num_rows, at + block)
                while end < limit and chunk[end] == chunk[at] and kind[end] == kind[at]:
                    end += 1
                some = batch.slice(at, end - at)
                if chunk[at] != now:
                    now, ids, parts, held = chunk[at], [], [], None
                if kind[at] == 0:
                    ids.append(some.column(2))
                    parts.append(_matrix(some.column(4)))
                elif ids:
                    if held is None:
                        wide = max(p.shape[1] for p in parts)
                        held = pa.concat_arrays(ids).to_numpy(zero_copy_only=False), np.vstack([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts])
                        parts = []
                    q = _matrix(some.column(4), held[1].shape[1])
                    x = held[1] if held[1].shape[1] == q.shape[1] else np.pad(held[1], ((0, 0), (0, q.shape[1] - held[1].shape[1])))
                    yield answer(some.column(3), q, some.column(5).to_numpy(zero_copy_only=False), held[0], x)
                at = end

    both = dealt.unionByName(asked).repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind")
    return both.mapInArrow(meet, schema)


def batch_topk(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, column: str, k: int, block: int = AT_ONCE, digits: int | None = None, whole: bool = False) -> DataFrame:
    """(query, item, score, rank): the k greatest products of each query with all items, ties by item.

    ``whole`` vectors (int8) give integer products, others cosines (0 without a direction), rounded to ``digits`` before they are
    ranked. A task keeps k items of each query and chunk (``_met``); these meet in a window that is limited to k rows a task before it is shuffled.
    Null vectors, and those with a component that isn't finite, have no direction; vectors of other lengths are compared over the shorter one.
    """

    def best(names: pa.Array, q: np.ndarray, _, own: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        s = q @ x.T if whole else _unit(q) @ _unit(x).T
        s = s if digits is None else np.round(s, digits)
        if s.shape[1] > 4 * k:  # all that reach the k-th score, then those by item
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            keep = np.flatnonzero((s >= least[:, None]).any(0))
            s, own = s[:, keep], own[keep]
        own = np.broadcast_to(own, s.shape)
        at = np.lexsort((own, -s), axis=1)[:, :k]
        n = at.shape[1]
        return pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(names)), n))), pa.array(np.take_along_axis(own, at, 1).ravel()), pa.array(np.take_along_axis(s, at, 1).ravel())], ["query", "item", "score"])

    kinds = queries.schema[query_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    asked = queries.select(F.col(query_key).alias("id"), F.col(column).alias("vector"), F.lit(None).alias("number"))
    out = _met(asked, items.select(F.col(item_key).alias("id"), F.col(column).alias("vector")), best, f"query {kinds[0]}, item {kinds[1]}, score double", block)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def probe_report(matrix: DataFrame) -> DataFrame:
    """Mean matched and mismatched cosine, their gap, top-1 accuracy and chance, where query i belongs to item i."""
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "item")
    ranked = matrix.withColumn("_r", F.row_number().over(best))
    same = F.col("query") == F.col("item")
    return ranked.agg(
        F.avg(F.when(same, F.col("cosine"))).alias("matched"), F.avg(F.when(~same, F.col("cosine"))).alias("mismatched"),
        (F.avg(F.when(same, F.col("cosine"))) - F.avg(F.when(~same, F.col("cosine")))).alias("separation"),
        (F.count_if(same & (F.col("_r") == 1)) / F.countDistinct("query")).alias("top1"), (1 / F.countDistinct("query")).alias("chance"),
    )


def allocate_slots(index: DataFrame, free: Sequence[int], slots: int, wanted: DataFrame, key: str = "hash") -> tuple[DataFrame, list[int], int]:
    """(index, free list, number of slots) after keys of ``wanted`` got slots: a key of the index (slot, key) keeps its own, new ones
    in key order take the free list from its end, then slots behind the last.

    Numbering is by range: rows are sorted in parallel, and one number per partition (its rows) reaches the driver.
    """
    fresh = wanted.select(key).distinct().join(index.select(key), key, "left_anti")
    ranged = fresh.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dict(ranged.groupBy("_part").count().collect())
    starts, at = {}, 0
    for part in sorted(sizes):
        starts[part], at = at, at + sizes[part]
    if not at:
        return index, list(free), slots
    begin = F.expr("map(" + ", ".join(f"{p}, {s}L" for p, s in starts.items()) + ")")
    numbered = ranged.withColumn("_n", F.element_at(begin, F.col("_part")) + F.col("_place"))
    taken = list(free)[::-1]
    reused = F.expr("array(" + ", ".join(f"{s}L" for s in taken) + ")") if taken else F.array().cast("array<long>")
    slot = F.when(F.col("_n") < len(taken), F.get(reused, F.col("_n").cast("int"))).otherwise(F.col("_n") - len(taken) + slots)
    left = list(free)[: max(0, len(taken) - at)]
    return index.unionByName(numbered.select(slot.cast(index.schema["slot"].dataType).alias("slot"), key)), left, slots + max(0, at - len(taken))


def release_slots(index: DataFrame, free: Sequence[int], gone: DataFrame, key: str = "hash") -> tuple[DataFrame, list[int]]:
    """(index, free list) without the keys of ``gone``; their slots join the free list in order."""
    freed = index.join(gone.select(key).distinct(), key, "left_semi").select("slot").orderBy("slot")
    return index.join(gone.select(key).distinct(), key, "left_anti"), [*free, *(r[0] for r in freed.collect())]


def probe_blocks(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, column: str, block: int = AT_ONCE) -> DataFrame:
    """``probe_report`` of many queries against all items: sums and ranks of the query's own item come from chunks of items (``_met``);
    only numbers per query and chunk move, never the matrix. ``query_key`` and ``item_key`` hold integers."""
    own = queries.select(F.col(query_key).alias("id"), F.col(column).alias("vector")).join(items.select(F.col(item_key).alias("id"), F.col(column).alias("_w")), "id", "left").select("id", "vector", F.when(F.col("_w").isNotNull(), expr.cosine(F.col("vector"), F.col("_w"))).alias("number"))

    def measure(names: pa.Array, q: np.ndarray, target: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        c, mine = _unit(q) @ _unit(x).T, names.to_numpy(zero_copy_only=False)[:, None]
        target = target.astype(np.float64)[:, None]
        other = ids[None, :] != mine
        ahead = (c > target + 1e-12) | ((np.abs(c - target) <= 1e-12) & (ids[None, :] < mine))
        return pa.RecordBatch.from_arrays([names, pa.array((c * other).sum(1)), pa.array((ahead & other).sum(1)), pa.array(np.full(len(names), len(ids))), pa.array(target[:, 0], from_pandas=True)], ["query", "total", "better", "n", "own"])

    kind = queries.schema[query_key].dataType.simpleString()
    parts = _met(own, items.select(F.col(item_key).alias("id"), F.col(column).alias("vector")), measure, f"query {kind}, total double, better long, n long, own double", block)
    per = parts.groupBy("query").agg(F.sum("total").alias("total"), F.sum("better").alias("better"), F.sum("n").alias("n"), F.max("own").alias("own"))
    matched, mismatched = F.avg("own"), F.sum("total") / F.sum(F.col("n") - F.when(F.col("own").isNotNull(), 1).otherwise(0))
    return per.agg(matched.alias("matched"), mismatched.alias("mismatched"), (matched - mismatched).alias("separation"), (F.count_if((F.col("better") == 0) & F.col("own").isNotNull()) / F.count("*")).alias("top1"), (1 / F.count("*")).alias("chance"))


def shard_rows(vectors: DataFrame, slot: str = "slot", per_shard: int = 4096) -> DataFrame:
    return vectors.withColumn("shard", F.floor(F.col(slot) / per_shard).cast("int"))


def live_slots(vectors: DataFrame, free: DataFrame, slot: str = "slot") -> DataFrame:
    return vectors.join(free.select(slot), slot, "left_anti")
