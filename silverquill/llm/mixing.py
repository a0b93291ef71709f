"""Mixing sources to target weights, in DataFrame functions only.

Each source's words form a stream cut into blocks of fixed length. The mix is a row of slots in output shards; a slot takes
one block. Each shard draws how many of its slots each source fills, from the multinomial conditioned on the sources' totals: a
pseudorandom permutation of all slots deals them to the shards, so shards vary as independent draws do while every source has
exactly the slots of its target (``exact=False`` draws each shard by itself: a source's total then strays from its target). A source's slots are numbered
through the shards; a slot's number runs through the source's blocks in epochs, each by its own pseudorandom permutation, and blocks are joined by
index. Permutations are swap-or-not networks on 64-bit hashes: a bijection for any number of blocks, computed for a single index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_count, materialize, running_total, table, word_count

WEIGHTS, MOST, BLOCK, SHARD_SLOTS, SEED, ROUNDS = (5, 2, 1), 3, 64, 4096, 20_240_607, 20
CHUNK = 4096
"""Shards that one row of the first step stands for."""
TASK_SLOTS = 50_000


def permuted(x: Column, n: Column, *key: Column, inverse: bool = False, seed: int = SEED) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0..n-1 named by ``key``."""
    rounds = [F.lit(r) for r in range(ROUNDS)]

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, *key), n) + n - at, n)
        return F.when(F.xxhash64(F.lit(seed + 1), r, F.greatest(at, other), *key).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.array(*(rounds[::-1] if inverse else rounds)), x.cast("long"), swap)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, target) from (source, size).

    Sources stand in code-point order, null last, and take the weights in turn. A target is ``weight x
    level``, but at most ``most`` times the source's size; the level makes the targets add up to all
    sizes, which is where resharing the excess by weight until none is above ends. The windows see one
    row per source and run in one task (millions of sources, not more). An empty source has target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("sid", F.row_number().over(every) - 1).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * most).withColumn("_r", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_r", "sid")
    earlier, onwards = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("_r", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = ranked.withColumn("_level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))) / F.sum("_w").over(onwards))
    levelled = levelled.withColumn("_open", F.col("_level") < F.col("_r"))
    level = F.min(F.when(F.col("_open"), F.struct("_r", "sid", "_level"))).over(whole)["_level"]
    target = F.when(F.col("_open"), F.least(level * F.col("_w"), F.col("_cap").cast("double"))).otherwise(F.col("_cap").cast("double"))
    return levelled.withColumn("target", target).select("source", "sid", "source_size", "target")


def shard_counts(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, exact: bool = True) -> DataFrame:
    """(shard, sid, n, count): how many slots of each shard each source fills, for counts above 0; n is the source's blocks.

    A source's slots are its target over the mean length of its blocks, rounded. A shard has ``shard_slots`` slots (at least
    one per source), the last one those that are left.
    """
    s = targets.where("source_size > 0").withColumn("n", F.ceil(F.col("source_size") / block).cast("long")).withColumn("_q", F.round(F.col("target") * F.col("n") / F.col("source_size")).cast("long")).where("_q > 0")
    slots, sources = s.agg(F.sum("_q"), F.count("*")).first()
    if not slots:
        return s.select(F.lit(0).cast("long").alias("shard"), "sid", "n", F.lit(0).cast("long").alias("count")).where("false")
    shard_slots = max(shard_slots, sources)
    earlier = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_from", F.coalesce(F.sum("_q").over(earlier), F.lit(0)))
    return _dealt(s, slots, shard_slots, seed) if exact else _drawn(s, slots, sources, shard_slots, seed)


def _dealt(s: DataFrame, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """Every slot of (sid, n, _q, _from) goes to its place in a permutation of all slots; a shard is a run of places."""
    chunks = s.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_q - 1) div {CHUNK})")))
    each = chunks.repartition(slots // TASK_SLOTS + 1, "sid", "_chunk").select("sid", "n", F.explode(F.expr(f"sequence(_from + _chunk * {CHUNK}, _from + least(_q, (_chunk + 1) * {CHUNK}) - 1)")).alias("_slot"))
    place = permuted(F.col("_slot"), F.lit(slots), F.lit("deal"), seed=seed)
    return each.select(F.call_function("div", place, F.lit(shard_slots)).alias("shard"), "sid", "n").groupBy("shard", "sid", "n").agg(F.count("*").alias("count"))


def _drawn(s: DataFrame, slots: int, sources: int, shard_slots: int, seed: int) -> DataFrame:
    """Every shard draws each of its slots alone: a draw is a point on the line of all sources' shares, and a sort inside the shard finds the source of each point."""
    shards = -(-slots // shard_slots)
    chunks = s.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((shards - 1) // CHUNK).cast("long"))))
    cells = chunks.repartition(max(1, shards * sources // TASK_SLOTS + 1), "_chunk", "sid").withColumn("shard", F.explode(F.expr(f"sequence(_chunk * {CHUNK}, least({shards}L, (_chunk + 1) * {CHUNK}) - 1)")))
    bounds = cells.select("shard", (F.col("_from") / F.lit(float(slots))).alias("_x"), F.lit(0).alias("_drawn"), "sid", "n")
    points = cells.where("_from = 0").withColumn("_j", F.explode(F.expr(f"sequence(1L, least({shard_slots}L, {slots}L - shard * {shard_slots}L))")))
    uniform = F.pmod(F.xxhash64(F.lit(seed + 2), "shard", "_j"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    nothing = lambda kind: F.lit(None).cast(kind)
    line = bounds.unionByName(points.select("shard", uniform.alias("_x"), F.lit(1).alias("_drawn"), nothing("int").alias("sid"), nothing("long").alias("n")))
    along = Window.partitionBy("shard").orderBy("_x", "_drawn", "sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = line.withColumns({"sid": F.last("sid", ignorenulls=True).over(along), "n": F.last("n", ignorenulls=True).over(along)}).where("_drawn = 1")
    return met.groupBy("shard", "sid", "n").agg(F.count("*").alias("count"))


def mix_slots(counts: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: (shard, place, sid, slot, epoch, block): slot ``place`` of ``shard`` takes that block of that source.

    A source's slots are numbered through its ``counts`` in the shards. A slot whose draw goes beyond the source's last whole epoch
    (``MOST`` of them) stays empty, so no block is taken more often.
    """
    inside = Window.partitionBy("shard").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("shard").orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = materialize(counts, "counts")
    rows = counts.withColumns({"_before": F.coalesce(F.sum("count").over(inside), F.lit(0)), "_all": F.sum("count").over(whole)})
    rows = materialize(running_total(rows, "sid", ["shard"], "count", "_start", bucket_count(counts.count())), "shard-counts")
    tasks = (rows.agg(F.sum("count")).first()[0] or 0) // TASK_SLOTS + 1
    slots = rows.repartition(tasks, "shard", "sid").withColumn("_r", F.explode(F.expr("sequence(0L, count - 1)"))).withColumn("slot", F.col("_start") + F.col("_r"))
    slots = slots.withColumn("epoch", F.expr("slot div n")).where(F.col("epoch") < MOST)
    slots = slots.withColumns({"block": permuted(F.expr("slot % n"), F.col("n"), F.col("sid"), F.col("epoch"), seed=seed), "place": permuted(F.col("_before") + F.col("_r"), F.col("_all"), F.lit("place"), F.col("shard"), seed=seed)})
    return slots.select("shard", "place", "sid", "slot", "epoch", "block")


def streams(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The targets of the sources, and (doc_id, text_hash, sid, size, source_size, target, from): where each document's words start in its
    source's stream, laid out by hash buckets of doc_id, so that a source with a third of all rows is spread."""
    sizes = materialize(documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = materialize(source_targets(sizes), "targets")
    keyed = sizes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "text_hash", "sid", "size", "source_size", "target")
    return targets, running_total(keyed, "sid", ["doc_id", "text_hash", "size"], "size", "from", bucket_count(sizes.count()))


def mix(documents: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, exact: bool = True) -> DataFrame:
    """(doc_id, size, source_size, target, taken, text_hash) for every row of ``documents``; the hash is the text's xxhash64.

    Null text has size 0; a document of size 0 takes 0; repeated rows stand in the stream one after
    another; null sources are a source; an empty table gives an empty one. Reruns give equal rows; another ``seed`` another draw.
    Texts are read once and don't move: only ids, sources and sizes do.
    """
    targets, placed = streams(documents)
    placed = materialize(placed, "placed")
    parts = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(from div {block}, (from + size - 1) div {block})")))
    parts = parts.withColumn("_words", F.expr(f"least(from + size, (block + 1) * {block}) - greatest(from, block * {block})"))
    drawn = mix_slots(shard_counts(targets, block, shard_slots, seed, exact), seed).groupBy("sid", "block").agg(F.count("*").alias("_times"))
    words = F.coalesce(F.col("_words") * F.col("_times"), F.lit(0))
    took = parts.join(drawn.hint("merge"), ["sid", "block"], "left").groupBy("sid", "from", "doc_id", "text_hash", "size", "source_size", "target").agg(F.sum(words).cast("long").alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken", "text_hash"]
    return took.select(columns).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
