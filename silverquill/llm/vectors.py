"""Embedding near-dedup by NN-descent.

Equal vectors are one node. Random hyperplanes deal the nodes into blocks, and every block gives each of its nodes the
nearest others, and a spanning forest of all links inside it, however many there are. The number of block tables grows
with the nodes (about as their power 0.15), so that a pair that meets the threshold meets in a block with a fixed
probability at every size. The nearest others start a neighbour graph, which rounds of local joins refine (the neighbours
of a node, forward and reverse, meet one another) until few lists change. A list that is full of links is enlarged. Only
neighbours within twice the threshold's angle stand in lists: no link has a middle farther off, and vectors without a
near one cost nothing after their blocks.

The forests give components, and only neighbourhoods that reach beyond one are joined: a link found there joins its components. An audit then compares sampled nodes that have links, and others, with all
nodes, and deals planted pairs at the threshold through the same hyperplanes; while either recall is too low more tables
and rounds follow, and below ``FLOOR`` the run fails. Links are counted exactly inside each component: all links found lie
there. In a large component, angles to its first vector settle most pairs without comparing them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, components, discard, materialize, scratch_scope, spread_join, table

THRESHOLD, LIST, MOST_LIST, BLOCK, MOST_BLOCK, ROUNDS, ATTEMPTS, BINS = 0.95, 10, 80, 512, 4096, 6, 3, 16
MISS = 0.002
"""The chance at most with which a pair at the threshold meets in no block."""
AUDIT, GOAL, FLOOR = 256, 0.99, 0.9
"""Nodes of each kind that are audited, the recall that ends the search, and the recall below which the run fails."""
PAIR = "id long, cos double, other long"


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows as double-precision vectors of length 1."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(v: Column) -> Column:
    """A vector with finite components only, one of them not 0."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, of batches sorted by them; a run may span batches."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        if not len(t):
            continue
        change = np.zeros(len(t) - 1, bool)
        for k in range(keys):
            x = t.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        cuts = np.flatnonzero(change) + 1
        at = 0
        for cut in cuts:
            yield t.slice(at, cut - at)
            at = cut
        rest = t.slice(at)
    if rest is not None and len(rest):
        yield rest


def pack_vectors(kind: str):
    """array -> bytes of its components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(kind), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()), b.column(2), b.column(3)], ["id", "v", "dims", "copies"])

    return pack


def tables_for(n: int, threshold: float, size: int = BLOCK, miss: float = MISS) -> tuple[int, int]:
    """(hyperplanes of a table, tables) for ``n`` vectors of one length: blocks of about ``size``, and as many tables
    as it takes that two vectors at the threshold's angle meet in none with a chance of ``miss`` at most."""
    planes = max(0, math.ceil(math.log2(max(1, n / size))))
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** planes
    return planes, 1 if meet >= 1 - miss else math.ceil(math.log(miss) / math.log1p(-meet))


def codes_of(x: np.ndarray, seed: int, planes: int) -> np.ndarray:
    """The block of each row in the table ``seed``: the signs of its products with random hyperplanes."""
    normals = np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], planes))
    return (x @ normals > 0).astype(np.int64) @ (1 << np.arange(planes, dtype=np.int64))


def blocks(nodes: DataFrame, kind: str, plan: dict[int, tuple[int, int]], attempt: int) -> DataFrame:
    """(key, dims, part, id, v): each node once per table of its length; a block of more than ``MOST_BLOCK`` nodes (fewer of very
    long vectors: 32 MB) is cut by hash, differently in each table, and a node alone in its block is left out."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                x, (planes, tables) = unit(_matrix(v.take(pa.array(own)), kind)), plan[d]
                for t in range(attempt * tables, (attempt + 1) * tables):
                    key = (codes_of(x, t, planes) << 12) + t
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(own), d, np.int32)), pa.array(ids[own])], ["key", "dims", "id"])

    dealt = materialize(nodes.select("id", "dims", "v").mapInArrow(deal, "key long, dims int, id long"), "dealt")
    parts = dealt.groupBy("key", "dims").agg(F.count("*").alias("_n")).where("_n > 1").select("key", "dims", F.ceil(F.col("_n") / F.greatest(F.lit(256), F.least(F.lit(MOST_BLOCK), F.floor(F.lit(1 << 22) / F.col("dims"))))).cast("int").alias("_parts"))
    placed = spread_join(dealt, parts, ["key", "dims"], ["id"]).select("key", "dims", F.pmod(F.xxhash64("id", "key"), F.col("_parts")).cast("int").alias("part"), "id")
    return placed.join(nodes.select("id", "v").hint("merge"), "id")


def forest(ids: np.ndarray, x: np.ndarray, threshold: float, strip: int = 256) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Edges (id, other, cosine) that join all rows of ``x`` which links join, one fewer than rows in each group."""
    edges, left = [], np.arange(len(x))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            fresh = []
            for i in range(0, len(front), strip):
                some = front[i : i + strip]
                c = x[some] @ x[left].T
                best = c.argmax(0)
                value = c[best, np.arange(len(left))]
                hit = value >= threshold
                if hit.any():
                    edges.append((ids[left[hit]], ids[some[best[hit]]], value[hit]))
                    fresh.append(left[hit])
                    left = left[~hit]
                if not len(left):
                    break
            front = np.concatenate(fresh) if fresh else left[:0]
    return edges


def nearest_in_blocks(dealt: DataFrame, kind: str, threshold: float, floor: float, keep: int = LIST, strip: int = 256) -> DataFrame:
    """(id, cos, other, tree): of each node in each block the ``keep`` nearest others from cosine ``floor`` up, and a
    spanning forest of the block's links, whose rows ``tree`` marks."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, 3):
            if len(g) < 2:
                continue
            ids, x = g.column(3).to_numpy(), unit(_matrix(g.column(4).combine_chunks(), kind))
            linked, found = np.zeros(len(ids), bool), []
            for i in range(0, len(ids), strip):
                c = x[i : i + strip] @ x.T
                c[np.arange(len(c)), np.arange(i, i + len(c))] = -3
                linked[i : i + strip] = (c >= threshold).any(1)
                near = np.flatnonzero((c >= floor).any(1))
                if len(near):
                    c, take = c[near], min(keep, len(ids) - 1)
                    at = np.argpartition(-c, take - 1, axis=1)[:, :take]
                    values = np.take_along_axis(c, at, 1)
                    good = values >= floor
                    found.append((np.repeat(ids[i + near], take)[good.ravel()], ids[at][good], values[good]))
            trees = forest(ids[linked], x[linked], threshold) if linked.any() else []
            for rows, tree in ((found, False), (trees, True)):
                if rows:
                    yield _pairs(*map(np.concatenate, zip(*rows, strict=True)), tree)

    return _sorted(dealt, ["key", "dims", "part"]).mapInArrow(join, f"{PAIR}, tree boolean")


def _pairs(ids: np.ndarray, others: np.ndarray, cosines: np.ndarray, tree: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cosines), pa.array(others), pa.array(np.full(len(ids), tree))], ["id", "cos", "other", "tree"])


def _sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt and sorted by ``keys``, which come first."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(n, *keys).sortWithinPartitions(*keys)


def nearest(ids: np.ndarray, cosines: np.ndarray, others: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` nearest distinct others of each id, ordered by id and nearness."""
    order = np.lexsort((-cosines, others, ids))
    i, o = ids[order], others[order]
    order = order[np.concatenate([[True], (i[1:] != i[:-1]) | (o[1:] != o[:-1])])[: len(order)]]
    order = order[np.lexsort((others[order], -cosines[order], ids[order]))]
    i = ids[order]
    first = np.concatenate([[True], i[1:] != i[:-1]])[: len(i)]
    place = np.arange(len(i))
    return order[place - np.maximum.accumulate(np.where(first, place, 0)) < most] if len(i) else order


def merge_lists(found: DataFrame, old: DataFrame | None, threshold: float, keep: int = LIST, most: int = MOST_LIST) -> DataFrame:
    """(id, cos, other, room): each node's nearest distinct others; ``room`` doubles for a list whose every entry
    is a link. A node's rows come sorted by id, and never more than a batch and ``most`` of them are held."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)]

        def cut(rows: list[np.ndarray]) -> pa.RecordBatch:
            ids, cosines, others, room = rows
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            rooms = np.repeat(np.maximum(np.maximum.reduceat(room, starts), keep), np.diff(np.append(starts, len(ids))))
            at = nearest(ids, cosines, others, most)
            ids, cosines, others, rooms = ids[at], cosines[at], others[at], rooms[at]
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            sizes = np.diff(np.append(starts, len(ids)))
            links = np.repeat(np.add.reduceat((cosines >= threshold).astype(np.int64), starts), sizes)
            rooms = np.where((links >= rooms) & (rooms * 2 <= most), rooms * 2, rooms)
            inside = np.arange(len(ids)) - np.repeat(starts, sizes) < rooms
            return pa.RecordBatch.from_arrays([pa.array(x[inside]) for x in (ids, cosines, others, rooms.astype(np.int32))], ["id", "cos", "other", "room"])

        for b in batches:
            rows = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, b.columns, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield cut([r[:last] for r in rows])
            rest = [r[last:] for r in rows]
            if len(rest[0]) > 4 * most:  # a hub's rows: only its nearest matter
                at, room = nearest(*rest[:3], most), rest[3].max()
                rest = [r[at] for r in rest]
                rest[3] = np.full(len(at), room, np.int32)
        if len(rest[0]):
            yield cut(rest)

    rows = found.select("id", "cos", "other", F.lit(0).alias("room"))
    return _sorted(rows if old is None else rows.unionByName(old), ["id"]).mapInArrow(merge, f"{PAIR}, room int")


def local_joins(graph: DataFrame, nodes: DataFrame, part: DataFrame, kind: str, seed: int, threshold: float, floor: float, group: int = 64) -> DataFrame:
    """(id, cos, other, tree): pairs of different components (``part``; a node in none is its own) that meet at a common neighbour and
    improve the list of ``id``, and with ``tree`` a link for each two components that meet.

    The members of a node's neighbourhood, forward and reverse, are cut by hash into groups of about
    ``group``, so a node with very many reverse neighbours is many small joins; a neighbourhood inside one component has nothing to find.
    A task sends on at most ``MOST_LIST`` of an id's pairs from every few hundred groups.
    """
    members = graph.select(F.col("id").alias("centre"), F.col("other").alias("id")).unionByName(graph.select(F.col("other").alias("centre"), "id")).unionByName(graph.select(F.col("id").alias("centre"), "id")).distinct()
    members = materialize(members.join(part.hint("merge"), "id", "left").select("centre", "id", F.coalesce("component", "id").alias("p")), "members")
    many = members.groupBy("centre").agg(F.count("*").alias("_n"), F.min("p").alias("_lo"), F.max("p").alias("_hi")).where("_lo <> _hi").select("centre", F.ceil(F.col("_n") / group).cast("int").alias("_parts"))
    parts = spread_join(members, many, ["centre"], ["id"]).select("centre", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("_parts")).cast("int").alias("part"), "id", "p")
    limits = graph.groupBy("id").agg(F.when(F.count("*") < F.max("room"), F.lit(floor)).otherwise(F.min("cos")).alias("worst"))
    placed = parts.join(limits.hint("merge"), "id", "left").join(nodes.select("id", "v").hint("merge"), "id").select("centre", "part", "id", "p", F.coalesce("worst", F.lit(floor)).alias("worst"), "v")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        linked: list[tuple] = []

        def send() -> Iterator[pa.RecordBatch]:
            for rows, tree in ((held, False), (linked, True)):
                if rows:
                    ids, others, cosines = map(np.concatenate, zip(*rows, strict=True))
                    rows.clear()
                    at = np.arange(len(ids)) if tree else nearest(ids, cosines, others, MOST_LIST)
                    yield _pairs(ids[at], others[at], cosines[at], tree)

        for g in groups_of(batches, 2):
            if len(g) < 2:
                continue
            ids, p, worst, x = *(g.column(k).to_numpy() for k in (2, 3, 4)), unit(_matrix(g.column(5).combine_chunks(), kind))
            c = x @ x.T
            c[p[:, None] == p[None, :]] = -3
            a, b = np.nonzero((c > worst[:, None] + 1e-12) & (c >= floor))
            if len(a):
                held.append((ids[a], ids[b], c[a, b]))
            a, b = np.nonzero(np.triu(c, 1) >= threshold)
            if len(a):
                _, first = np.unique(np.stack([np.minimum(p[a], p[b]), np.maximum(p[a], p[b])]), axis=1, return_index=True)
                linked.append((ids[a[first]], ids[b[first]], c[a[first], b[first]]))
            if len(held) + len(linked) >= 500:
                yield from send()
        yield from send()

    return _sorted(placed, ["centre", "part"]).mapInArrow(join, f"{PAIR}, tree boolean")


def planted_recall(sample: list[np.ndarray], plan: dict[int, tuple[int, int]], threshold: float, attempts: int) -> float:
    """The share of pairs at the threshold's angle, one of each the given vector, that meet in a block."""
    met, rng = [], np.random.default_rng(97)
    for x in sample:
        planes, tables = plan[len(x)]
        other = rng.normal(size=(4, len(x)))
        other -= (other @ x)[:, None] * x
        size = np.linalg.norm(other, axis=1, keepdims=True)
        pairs = np.vstack([x[None, :], threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * other / np.maximum(size, 1e-300)])
        codes = np.stack([codes_of(pairs, t, planes) for t in range(attempts * tables)])
        met += [bool(m) for m, s in zip((codes[:, 1:] == codes[:, :1]).any(0), size[:, 0], strict=True) if s > 1e-9]
    return float(np.mean(met)) if met else 1.0


def audit(nodes: DataFrame, part: DataFrame, kind: str, threshold: float, sample: int = AUDIT) -> tuple[int, int, list[np.ndarray]]:
    """Links that ``sample`` nodes in components and as many others have with all nodes by brute force, those of them
    inside one component, and the vectors asked."""
    placed = nodes.join(part.hint("merge"), "id", "left").select("id", "dims", "v", F.col("component").isNotNull().alias("linked"), F.coalesce("component", "id").alias("part"))
    asked = [r for linked in (True, False) for r in placed.where(F.col("linked") == linked).orderBy(F.xxhash64("id")).limit(sample).collect()]
    shared = nodes.sparkSession.sparkContext.broadcast([(r["id"], r["part"], r["dims"], bytes(r["v"])) for r in asked])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {}
        for i, p, d, v in shared.value:
            queries.setdefault(d, []).append((i, p, v))
        queries = {d: (np.array([q[0] for q in own], np.int64), np.array([q[1] for q in own], np.int64), unit(np.frombuffer(b"".join(q[2] for q in own), kind).reshape(len(own), -1))) for d, own in queries.items()}
        for b in batches:
            ids, dims, parts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy()
            true = same = 0
            for d, (qi, qp, q) in queries.items():
                own = np.flatnonzero(dims == d)
                if len(own):
                    x = unit(_matrix(b.column(2).take(pa.array(own)), kind))
                    for i in range(0, len(x), 1024):
                        a, z = np.nonzero(x[i : i + 1024] @ q.T >= threshold)
                        at = own[i + a]
                        other = ids[at] != qi[z]
                        true, same = true + int(other.sum()), same + int((other & (parts[at] == qp[z])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([true]), pa.array([same])], ["true", "same"])

    true, same = placed.select("id", "dims", "v", "part").mapInArrow(find, "true long, same long").agg(F.sum("true"), F.sum("same")).first()
    return true or 0, same or 0, [unit(np.frombuffer(v, kind).reshape(1, -1))[0] for _, _, _, v in shared.value]


def count_links(nodes: DataFrame, part: DataFrame, kind: str, threshold: float, whole: int = 512, block: int = 2048) -> DataFrame:
    """(id, links): for every node of ``part`` (id, component) the members of the nodes it links with, exactly.

    A component of up to ``whole`` nodes is one product. In a larger one a node's angle to the component's first
    node puts it into a ring; two rings surely link (angles add up to less than the threshold's), surely
    don't (they differ by more), or are compared in blocks of ``block`` nodes.
    """
    theta = math.acos(threshold)
    width = theta / BINS
    sizes = part.groupBy("component").agg(F.count("*").alias("size"))
    placed = spread_join(part, sizes, ["component"], ["id"])
    sized = materialize(placed.join(nodes.select("id", "copies", "v").hint("merge"), "id").select("component", "id", "copies", "v", "size"), "sized")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, 1):
            x, copies = unit(_matrix(g.column(3).combine_chunks(), kind)), g.column(2).to_numpy()
            links = np.zeros(len(x), np.int64)
            for i in range(0, len(x), 512):
                near = x[i : i + 512] @ x.T >= threshold
                near[np.arange(len(near)), np.arange(i, i + len(near))] = False
                links[i : i + 512] = near @ copies
            yield pa.RecordBatch.from_arrays([g.column(1).combine_chunks(), pa.array(links)], ["id", "links"])

    small = _sorted(sized.where(F.col("size") <= whole).select("component", "id", "copies", "v"), ["component"]).mapInArrow(product, "id long, links long")
    large = sized.where(F.col("size") > whole)
    if large.isEmpty():
        return small

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, p = unit(_matrix(b.column(3), kind)), unit(_matrix(b.column(4), kind))
            angle = np.arccos(np.clip((x * p).sum(1), -1, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((angle / width).astype(np.int32)), *(b.column(k) for k in (1, 2, 3))], ["component", "ring", "id", "copies", "v"])

    first = large.where("id = component").select("component", F.col("v").alias("p"))
    ringed = materialize(spread_join(large.select("component", "id", "copies", "v"), first, ["component"], ["id"]).mapInArrow(ring, "component long, ring int, id long, copies long, v binary"), "rings")
    rings = materialize(ringed.groupBy("component", "ring").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")), "rings")
    other = rings.select(F.col("component").alias("c2"), F.col("ring").alias("ring2"), F.col("copies").alias("copies2"), F.col("n").alias("n2"))
    met = rings.join(other.hint("merge"), F.col("component") == F.col("c2"))
    sure = F.col("ring") + F.col("ring2") + 2 <= BINS - 1e-6  # both angles at their largest
    certain = met.where(sure).groupBy("component", "ring").agg(F.sum("copies2").alias("_sure"), F.max(F.col("ring") == F.col("ring2")).alias("_self"))
    settled = spread_join(ringed, certain, ["component", "ring"], ["id"]).select("id", (F.col("_sure") - F.when(F.col("_self"), F.col("copies")).otherwise(0)).alias("links"))
    open_ = materialize(met.where(~sure & (F.abs(F.col("ring") - F.col("ring2")) <= BINS + 1)).select("component", "ring", "ring2", F.ceil(F.col("n2") / block).cast("int").alias("parts2")), "ring-pairs")
    left = spread_join(ringed, rings.select("component", "ring", F.ceil(F.col("n") / block).cast("int").alias("_parts")), ["component", "ring"], ["id"])
    left = materialize(left.withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts"), "ring-parts")
    asks = spread_join(left, open_, ["component", "ring"], ["id"]).withColumn("part2", F.explode(F.expr("sequence(0, parts2 - 1)"))).select("component", "ring", "part", "ring2", "part2", F.lit(0).alias("side"), "id", "copies", "v")
    back = open_.join(rings.select("component", "ring", F.ceil(F.col("n") / block).cast("int").alias("parts")).hint("merge"), ["component", "ring"]).select("component", "ring", "parts", F.col("ring2").alias("_r"))
    gives = spread_join(left.select("component", F.col("ring").alias("_r"), F.col("part").alias("part2"), "id", "copies", "v"), back, ["component", "_r"], ["id"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("component", "ring", "part", F.col("_r").alias("ring2"), "part2", F.lit(1).alias("side"), "id", "copies", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches, 5):
            side, ids, copies, x = g.column(5).to_numpy(), g.column(6).to_numpy(), g.column(7).to_numpy(), unit(_matrix(g.column(8).combine_chunks(), kind))
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            z = x[a]
            own, theirs, y, times = ids[a], ids[b], x[b], copies[b]
            links = np.zeros(len(own), np.int64)
            for i in range(0, len(own), 512):
                near = (z[i : i + 512] @ y.T >= threshold) & (own[i : i + 512, None] != theirs[None, :])
                links[i : i + 512] = near @ times
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(links)], ["id", "links"])

    compared = _sorted(asks.unionByName(gives), ["component", "ring", "part", "ring2", "part2"]).mapInArrow(compare, "id long, links long")
    return small.unionByName(settled.unionByName(compared).groupBy("id").agg(F.sum("links").alias("links")))


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings`` (vec_id, embedding).

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. Cosines are of
    double precision and taken between vectors of one length; all lengths go through the same passes, and one
    row per distinct length reaches the driver. Repeated rows, and rows with one vec_id or none, are vectors of their own
    that link like any others (a component of null ids alone has a null component_id). An empty table gives an empty one. Raises RuntimeError if the audit finds a recall below ``FLOOR``.
    """
    spark = embeddings.sparkSession
    kind = "<f4" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = materialize(embeddings.select("vec_id", F.when(valid(F.col("embedding")), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")).alias("embedding")).withColumns({"_h1": F.xxhash64("embedding"), "_h2": F.hash("embedding"), "dims": F.size("embedding")}), "vectors")
    every = rows.where("embedding is not null").groupBy("dims", "_h1", "_h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    every = materialize(every.withColumn("id", F.monotonically_increasing_id()), "distinct")
    packed = every.select("id", "embedding", "dims", "copies").mapInArrow(pack_vectors(kind), "id long, v binary, dims int, copies long")
    nodes = materialize(packed, "nodes")
    part = linked_parts(nodes, kind, threshold)
    found = every.select("dims", "_h1", "_h2", "id", "least", "copies")
    if part is None:
        found = found.withColumns({"links": F.lit(0).cast("long"), "name": F.col("least")})
    else:
        placed = materialize(part.join(found.select("id", "least").hint("merge"), "id"), "placed")
        named = spread_join(placed, placed.groupBy("component").agg(F.min("least").alias("name")), ["component"], ["id"]).select("id", "name")
        counted = count_links(nodes, part, kind, threshold)
        found = found.join(named.hint("merge"), "id", "left").join(counted.hint("merge"), "id", "left").withColumn("name", F.coalesce("name", "least"))
    joined = rows.select("vec_id", "dims", "_h1", "_h2", F.col("embedding").isNotNull().alias("_ok")).join(found.hint("merge"), ["dims", "_h1", "_h2"], "left")
    component = F.when(F.col("_ok"), F.coalesce("name", "vec_id")).otherwise(F.col("vec_id"))
    links = F.when(F.col("_ok"), F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).otherwise(F.lit(0))
    return joined.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def joined(part: DataFrame, links: DataFrame) -> DataFrame:
    """``part`` (id, component) after ``links`` (id, other), most of which lead from one component to another, or to a node in none."""
    both = part.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links.select(F.col("id").alias("a"), F.col("other").alias("b")))
    return materialize(components(both, "vectors", few=FEW).select(F.col("node").alias("id"), "component"), "vector-parts")


def linked_parts(nodes: DataFrame, kind: str, threshold: float) -> DataFrame | None:
    """(id, component) of the nodes that have links, by NN-descent; None if no node has any. Its scratch tables go with it."""
    with scratch_scope() as keep:
        part = _descend(nodes, kind, threshold)
        if part is not None:
            keep(part)
        return part


def _descend(nodes: DataFrame, kind: str, threshold: float) -> DataFrame | None:
    plan = {d: tables_for(n, threshold) for d, n in nodes.groupBy("dims").count().collect()}
    if not plan:
        return None
    floor = math.cos(min(math.pi, 2 * math.acos(threshold)))
    graph, part = None, nodes.select("id", F.col("id").alias("component")).limit(0)
    for attempt in range(ATTEMPTS):
        fresh = materialize(nearest_in_blocks(blocks(nodes, kind, plan, attempt), kind, threshold, floor), "fresh")
        part = joined(part, fresh.where("tree"))
        graph = materialize(merge_lists(fresh, graph, threshold), "graph")
        for k in range(ROUNDS):
            entries = graph.count()
            better = materialize(local_joins(graph, nodes, part, kind, 100 * attempt + k, threshold, floor), "better")
            found, linked = better.agg(F.count("*"), F.count_if("tree")).first()
            if linked:
                part = joined(part, better.where("tree"))
            if found:
                old, graph = graph, materialize(merge_lists(better, graph, threshold), "graph")
                discard(old)
            if not linked and found <= 0.02 * entries:
                break
        true, met, asked = audit(nodes, part, kind, threshold)
        recall = min(met / true if true else 1.0, planted_recall(asked, plan, threshold, attempt + 1))
        if recall >= GOAL:
            break
    if recall < FLOOR:
        raise RuntimeError(f"recall {recall:.3f} of audited links after {ATTEMPTS} attempts, {FLOOR} is needed")
    return None if part.isEmpty() else part


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_sql() -> str:
    """By brute force over all pairs."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings),
fine AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(x, y) AS (SELECT vec_id, vec_id FROM fine UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN comp ON vec_id = comp.x LEFT JOIN n ON vec_id = n.x
"""
