"""MinHash near-dedup by Order MinHash and banded alignment.

Texts with the same words are one node. A node's signatures each take two labelled five-word shingles,
the least by one hash, in text order. Nodes that share a signature form a group. Candidates are verified by aligning their words in a
band. Each group is compared with its first member; the members of groups that this leaves in more than one component are joined
by the rare words that similar texts must share, so no link is lost there and no large group is paired out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles as sh
from .common import FEW, components, hot_keys, materialize, pieces_of, scratch_scope, spread_join, table, tidied

BANDS, SAMPLE, THRESHOLD = 24, 2, 0.8
"""Texts with 38 % of their shingles in common, the least that one edit in nine words usually leaves, share one of 24 signatures of two with 0.98."""


def signatures(documents: DataFrame, bands: int = BANDS, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text_hash, node, sigs): the node is a hash of the text's words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces_of(whole):
                words, sizes = sh.word_hashes(b.column(1))
                nodes, sigs, at = [], [], 0
                for n in sizes.tolist():
                    own = words[at : at + n]
                    at += n
                    nodes.append(node_of(own))
                    grams = sh.shingles(own)
                    sigs.append(sh.order_minhash(sh.labelled(grams), bands, sample).view(np.int64) if n else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sigs])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sigs])))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes, pa.int64()), lists], ["doc_id", "text_hash", "node", "sigs"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(tidied(sign), f"doc_id {kind}, text_hash long, node long, sigs array<long>")


def node_of(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def node_words(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words) of the nodes in ``wanted`` (rep, node): the word hashes as packed 32-bit numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces_of(whole):
                words, sizes = sh.word_hashes(b.column(0))
                parts = np.split(words, np.cumsum(sizes)[:-1])
                same = [(n, p.tobytes()) for n, p in zip(b.column(1).to_pylist(), parts, strict=True) if node_of(p) == n]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in same], pa.int64()), pa.array([p for _, p in same], pa.binary())], ["node", "words"])

    asked = wanted.select(F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_hash"), "node")
    texts = documents.select("doc_id", "text").join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))).select("text", "node")
    return texts.mapInArrow(tidied(read), "node long, words binary").dropDuplicates(["node"])


def verify(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity, bound) of ``pairs`` (a, b) by ``word_alignment``: many pairs may share their ``b``."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for b in batches:
            found = []
            for wa, wb in zip(b.column(2), b.column(3), strict=True):
                wa, wb = wa.as_py(), wb.as_py()
                if wb != last:
                    last, kept = wb, sh.Marked(np.frombuffer(wb, np.uint32))
                found.append(sh.word_alignment(sh.Marked(np.frombuffer(wa, np.uint32)), kept, threshold))
            s = np.array(found, np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s[:, 0]), pa.array(s[:, 1])], ["a", "b", "similarity", "bound"])

    left = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "wa", "wb")
    return both.mapInArrow(tidied(align), "a long, b long, similarity double, bound double")


def prefix_keys(nodes: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """(key, node, n, place): each node by its rarest words (repeats told apart), of its n; two similar ones share a key.

    Words are ordered by the number of ``nodes`` that hold them. A text whose words align with another's to ``threshold`` has so many
    in common with it: of its n words they share one of the first n - ceil(threshold n) + 1.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in pieces_of(whole, most_bytes=1 << 20)):
            parts = [(n, sh.labelled(np.frombuffer(w.as_py(), np.uint32).astype(np.uint64))) for n, w in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([n for n, _ in parts], np.int64), [len(g) for _, g in parts])), pa.array(np.concatenate([np.zeros(0, np.int64), *(g.view(np.int64) for _, g in parts)]))], ["node", "key"])

    grams = materialize(words.join(nodes.hint("merge"), "node").select("node", "words").mapInArrow(tidied(spread), "node long, key long"), "grams")
    held = materialize(grams.groupBy("key").agg(F.count("*").alias("_rows")), "held")
    ranked = spread_join(grams, held.withColumnRenamed("_rows", "_n"), ["key"], ["node"], hot=hot_keys(held, ["key"])).groupBy("node").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("_n", "key"))).alias("g"))
    first = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).cast("int")
    rows = ranked.select("node", "n", F.posexplode(F.slice("g", F.lit(1), first)).alias("place", "s"))
    return rows.where("s._n > 1").select(F.col("s.key").alias("key"), "node", "n", "place")


def _reachable(threshold: float) -> Column:
    """Whether two key rows (n, place and m, place2) can be similar: words before the first key they share are not shared."""
    most = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("place2"))
    return most >= threshold * (F.col("n") + F.col("m") - most) - 1e-9


def similar(groups: DataFrame, words: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) over the links of at least ``threshold`` between members of a group in ``groups`` (key, node).

    First every group is compared with its first member only. Members of groups that stay in more than one component
    are then joined by the rare words that two similar texts must share, with what follows
    these as a bound (positional filter), first with the key's most promising member, then across components. No link inside a group is lost.
    """
    with scratch_scope() as keep:
        part = _similar(groups, words, threshold)
        keep(part)
        return part


def _similar(groups: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    seen, part = None, None

    def add(pairs: DataFrame, label: str) -> None:
        nonlocal seen, part
        fresh = pairs if seen is None else pairs.join(seen.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        checked = materialize(verify(fresh, words, threshold), label)
        seen = checked if seen is None else seen.unionByName(checked)
        links = checked.where(F.col("similarity") >= threshold).select("a", "b")
        if part is None or not links.isEmpty():
            known = links if part is None else links.unionByName(part.select(F.col("node").alias("a"), F.col("component").alias("b")))
            part = materialize(components(known, "near", few=FEW), "near-part")

    def place(members: DataFrame) -> DataFrame:
        return members.join(part.hint("merge"), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")

    def pair(x: str, y: str) -> list[Column]:
        return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]

    once = groups.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("_sum"))
    once = materialize(once.groupBy("head", "size", "_sum").agg(F.min("key").alias("key")).select("key", "head", "size"), "once")  # one of several groups with the same members
    hot = hot_keys(once.select("key", F.col("size").alias("_rows")), ["key"])
    members = materialize(spread_join(groups, once.select("key", "head"), ["key"], ["node"], hot=hot), "members")
    add(members.where("node <> head").select(*pair("node", "head")).distinct(), "star")
    placed = place(members)
    open_ = placed.groupBy("key").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")).where("_lo <> _hi").select("key")
    # Beside its head, a member far from the head can only be similar to members nearly as far (metric bound).
    far = spread_join(placed, open_, ["key"], ["node"], hot=hot).where("node <> head").select("key", "node", *pair("node", "head"))
    far = far.join(seen.select("a", "b", (1 - F.col("bound")).alias("d"), (F.col("similarity") >= threshold).alias("near")).hint("merge"), ["a", "b"])
    reach = far.where("not near").groupBy("key").agg(F.min("d").alias("_closest"))
    again = spread_join(far, reach, ["key"], ["node"], hot=hot).where(F.expr(f"not near or d >= _closest - {1 - threshold} - 1e-9"))
    pool = materialize(again.select("node").distinct(), "pool")
    if pool.isEmpty():
        return part

    keys = materialize(prefix_keys(pool, words, threshold), "prefix")
    common = hot_keys(keys.groupBy("key").agg(F.count("*").alias("_rows")), ["key"])
    best = keys.groupBy("key").agg(F.min_by(F.struct("node", "n", "place"), F.struct(F.col("place") / F.col("n"), "node")).alias("_h"), F.count("*").alias("_c")).where("_c > 1")
    best = best.select("key", F.col("_h.node").alias("head"), F.col("_h.n").alias("m"), F.col("_h.place").alias("place2"))
    led = place(spread_join(keys, best, ["key"], ["node"], hot=common)).join(part.select(F.col("node").alias("head"), F.col("component").alias("_hp")).hint("merge"), "head", "left")
    add(led.where((F.col("node") != F.col("head")) & (F.col("part") != F.coalesce("_hp", "head")) & _reachable(threshold)).select(*pair("node", "head")).distinct(), "lead")

    left = place(keys)
    parts = left.groupBy("key", "part").agg(F.count("*").alias("_c")).groupBy("key").agg(F.count("*").alias("_p"), F.max_by("part", F.struct("_c", "part")).alias("main")).where("_p > 1").select("key", "main")
    left = materialize(spread_join(left, parts, ["key"], ["node"], hot=common), "left")
    x = left.where("part <> main").drop("main")
    y = left.select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("place").alias("place2"), F.col("part").alias("part2"))
    cross = spread_join(x, y, ["key"], ["node"], hot=common).where((F.col("part") != F.col("part2")) & _reachable(threshold)).select(*pair("node", "other")).distinct()
    add(cross, "cross")
    return part


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, class_id, kept, text_hash): class_id is the least doc_id of the documents linked with this one,
    directly or through others; kept marks the document that stands for its class.

    Documents with the same words (ASCII case and white space aside) are copies; null and empty texts are copies of
    one another. Others link if their aligned words are ``threshold`` of all their words or more; five-word shingles find
    the candidates, and a text of fewer words is one shingle. Repeated rows are answered each; of rows with one doc_id in a class those with the
    least ``text_hash`` (xxhash64 of the text) are kept. A null doc_id is least.
    """
    signed = materialize(signatures(documents, bands, sample), "signatures")
    nodes = materialize(signed.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("sigs").alias("sigs")), "nodes")
    buckets = nodes.select("node", F.explode("sigs").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    groups = materialize(buckets.join(shared.hint("merge"), "key"), "groups")
    wanted = nodes.select("node", "rep").join(groups.select("node").distinct().hint("merge"), "node")
    words = materialize(node_words(documents, wanted), "words")
    part = similar(groups, words, threshold)
    least = nodes.select("node", "rep").join(part.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("part"), "rep")
    first = least.groupBy("part").agg(F.min("rep").alias("first"))
    named = least.select("node", "part").join(first.hint("merge"), "part").select("node", "first")
    joined = signed.select("doc_id", "text_hash", "node").join(named.hint("merge"), "node")
    return joined.select("doc_id", F.col("first.doc_id").alias("class_id"), F.struct("doc_id", "text_hash").eqNullSafe(F.col("first")).alias("kept"), "text_hash")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
